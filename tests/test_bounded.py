"""Bounded matching against a comparison of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moltabula.functions.edits import character_features, edit_bound, edit_distance, edit_similarity
from moltabula.operators import bounded, overlap

LETTERS = "abcde"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def own(text):
    return np.array([len(text), *[text.count(c) for c in LETTERS]], float)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé😀", max_size=80), st.text("abcé😀", max_size=80))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == plain_distance(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefg", max_size=9), st.lists(st.text("abcdefg", max_size=9), min_size=1, max_size=5))
def test_edit_bound_holds_for_every_text_of_a_box(a, others):
    rows = np.array([own(o) for o in others])
    most = edit_bound(own(a), rows.min(axis=0)[None], rows.max(axis=0)[None])[0]
    assert most >= max(edit_similarity(a, o) for o in others)


def _texts(n, seed):
    rng = random.Random(seed)
    hot = "abcabcabcabc"
    out = []
    for i in range(n):
        kind = rng.random()
        text = hot if kind < 0.2 else hot[:-1] + rng.choice("abc") if kind < 0.35 else "" if kind < 0.4 else None if kind < 0.43 else "".join(
            rng.choice("aabbcde") for _ in range(rng.randint(0, 40)))
        out.append((i, rng.randint(0, 1), text))
    return out


@pytest.mark.parametrize("limit, least", [(2048, 4), (7, 1), (50, 10**6)])
def test_same_rows_as_best_match_with_fewer_calls(spark, monkeypatch, limit, least):
    monkeypatch.setattr(bounded, "LEAST_ROWS", least)
    schema = "ordinal long, label int, v string, id int, features int"
    test, train = (spark.createDataFrame([(*r, 1, 2) for r in _texts(n, n)], schema) for n in (60, 400))
    features = character_features(F.col("v"), LETTERS)
    seen = {}
    got = overlap.best_match_bounded(test, train, edit_similarity, "v", features, edit_bound, cell_rows=limit, seen=seen)
    want = overlap.best_match(test, train, edit_similarity, "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pairs = len({r[2] for r in _texts(60, 60)} - {None}) * len({r[2] for r in _texts(400, 400)} - {None})
    assert 0 < seen["calls"] < pairs / 2
    if least == 4:
        assert seen["groups"] > 30 and seen["meetings"] < pairs / 4


def test_no_targets_failures_and_null_features(spark):
    schema = "ordinal long, label int, v string"
    test = spark.createDataFrame([(1, 0, "ab"), (2, 0, None)], schema)
    features = character_features(F.col("v"), "ab")
    for train in (spark.createDataFrame([], schema), spark.createDataFrame([(5, 1, None)], schema)):
        got = overlap.best_match_bounded(test, train, edit_similarity, "v", features, edit_bound).collect()
        assert {(r.ordinal, r.pred_label, r.score, r.nn_text) for r in got} == {(1, 0, 0.0, ""), (2, 0, 0.0, "")}

    def fails(a, b):
        raise RuntimeError

    train = spark.createDataFrame([(7, 1, "ab"), (5, 1, "b"), (6, 1, "abc")], schema)
    got = {r.ordinal: (r.score, r.nn_text) for r in overlap.best_match_bounded(test, train, fails, "v", features, edit_bound).collect()}
    assert got == {1: (0.0, "b"), 2: (0.0, "")}
    with pytest.raises(Exception, match="feature is null"):
        overlap.best_match_bounded(test, train, edit_similarity, "v", [F.lit(None)], edit_bound).collect()


@pytest.mark.parametrize("buckets", [1, 16])
def test_bags_in_groups(spark, monkeypatch, buckets):
    monkeypatch.setattr(bounded, "LEAST_ROWS", 4)
    rng = random.Random(3)
    words = [[f"{k}{i}" for i in range(30)] for k in "abcd"]
    bags = []
    for i in range(300):
        topic = rng.choice(words)
        bags.append(words[0][:6] if rng.random() < 0.3 else None if i % 50 == 7 else [rng.choice(topic) for _ in range(rng.randint(0, 25))])
    df = spark.createDataFrame([(i, i % 2, b, f"t{i}") for i, b in enumerate(bags)], "ordinal long, label int, tokens array<string>, smiles string")
    test, train = df.filter("ordinal < 80"), df.filter("ordinal >= 80")
    seen = {}
    got = overlap.overlap_nn(test, train, buckets=buckets, cell_rows=40, seen=seen)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, overlap.overlap_nn(test, train).collect()))
    if buckets == 16:
        different = [len({tuple(sorted(b)) for b in part if b is not None}) for part in (bags[:80], bags[80:])]
        assert seen["calls"] < different[0] * different[1] / 2


def test_cuts_of_equal_rows():
    feature, value = bounded._cuts(np.zeros((50, 3)), 4)
    assert set(bounded._leaves(np.zeros((9, 3)), feature, value, 4)) == {0}
    rows = np.array([[0.0], [1.0], [1.0], [1.0]])
    feature, value = bounded._cuts(rows, 2)
    assert len(set(bounded._leaves(rows, feature, value, 2))) == 2


def test_meetings_are_numbers_and_bags_few_bytes(spark):
    """A query meets up to 256 groups, so what is written for a meeting must not hold its tokens."""
    words = [f"word{i % 180}" for i in range(600)]
    assert len(overlap._pack_bag(words)) < len(" ".join(words)) / 4
    codes = overlap._codes(pa.chunked_array([pa.array([overlap._pack_bag(["a", "b", "a"]), overlap._pack_bag([])], pa.binary())]), {"b": 0})
    assert [list(c) for c in codes] == [[0, 0], [1, 0], [2, 1]]
    sets = spark.createDataFrame([(i, b"x", [float(i), 1.0]) for i in range(8)], "id long, bag binary, features array<double>")
    boxes = bounded._Boxes(bounded._grouped(sets, 2), 2)
    state = sets.select("id", "features", F.lit(-1.0).alias("best"), F.lit(2**62).alias("nn"))
    dealt = bounded._dealt(state, boxes, overlap.overlap_bound, 2, 0, 1)
    assert dealt.columns == ["id", "best", "nn", "key"] and dealt.count() == 8


def test_few_candidates_for_the_sample_reach_the_driver(spark, monkeypatch):
    """The targets of the least hashes, of which no task sends all it has; with ids that repeat too."""
    monkeypatch.setattr(bounded, "SAMPLE", 50)
    for ids in (F.col("id"), F.col("id") % 3):
        rows = spark.range(5000, numPartitions=4).select(ids.alias("id"), F.array(F.col("id").cast("double")).alias("features"))
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        want = {r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(50).select(F.xxhash64("id")).collect()}
        got = spark.createDataFrame([(float(v),) for v in bounded._sample(rows, 5000, 1).ravel()], "v double")
        assert got.count() == 50
        id_of = F.col("v").cast("bigint") if str(ids) == str(F.col("id")) else F.col("v").cast("bigint") % 3
        assert {r[0] for r in got.select(F.xxhash64(id_of)).collect()} == want
