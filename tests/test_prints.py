"""Fingerprints of words, packed and dense forms: the same as plain ones, each word hashed once, each row read once."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from moltabula.functions import bits
from moltabula.functions.text import spaced_tokens, tokens
from moltabula.operators import fingerprint
from moltabula.plans.table_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_words_fingerprint_equals_token_fingerprint(spark):
    texts = ["One two, one TWO three!", "", " ", "...", None, "İstanbul ẞ Ǆ ß", "日本語 123 ²³ ½ x_y", "a" * 300, " tab wide\x85next\x1cmore", "é é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    for n_bits in (64, 100, 2048):
        rows = df.select("t", bits.token_fingerprint(tokens(F.col("t")), n_bits).alias("a"), bits.words_fingerprint(spaced_tokens(F.col("t")), n_bits).alias("b")).collect()
        assert len(rows) == len(texts) and all(r.a == r.b for r in rows)
        assert any(r.a is None for r in rows) and any(r.a == [] for r in rows)


def test_each_word_is_hashed_once(monkeypatch):
    seen = []
    real = hashlib.md5
    monkeypatch.setattr(bits.hashlib, "md5", lambda word, **more: seen.append(word) or real(word))
    made = bits._bits_of_words(pa.array(["a b a", "b  c ", None, "a b c"]), 2048).to_pylist()
    assert sorted(w for w in seen if w) == [b"a", b"b", b"c"]
    place = {w: int(real(w.encode()).hexdigest()[:8], 16) % 2048 for w in "abc"}
    assert made == [sorted({place[w] for w in ws}) if ws is not None else None for ws in ("ab", "bc", None, "abc")]


def test_packed_and_dense_forms(spark):
    data = [(0, [0, 63, 64, 2047]), (1, []), (2, None), (3, [5, 5, 1]), (4, [-1, 2048, 7, None])]
    df = spark.createDataFrame(data, "id int, b array<int>").repartition(2)
    got = {r.id: r for r in df.select("id", bits.pack_words(F.col("b")).alias("w"), bits.dense_bits(F.col("b")).alias("d"), bits.dense_bits(F.col("b"), 70).alias("s")).collect()}
    for i, b in data:
        if b is None:
            assert got[i].w == [None] * 32 and got[i].d == [None] * 2048 and got[i].s == [None] * 70
            continue
        inside = {x for x in b if x is not None and 0 <= x < 2048}
        assert [w & (1 << 64) - 1 for w in got[i].w] == [sum(1 << x - 64 * k for x in inside if x >> 6 == k) for k in range(32)]
        assert got[i].d == [float(x in inside) for x in range(2048)] and got[i].s == [float(x in inside) for x in range(70)]


def test_export_is_described_in_one_pass(spark):
    plan = QUERIES["ml_export"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "scalar-subquery" not in plan


def test_whole_graphs_equal_joined_graphs(spark):
    rng = random.Random(5)
    vertices, edges = [], []
    for g in range(40):
        n = rng.randint(1, 60 if g == 7 else 9)
        vertices += [(g, v, rng.choice("CNOS")) for v in range(n)]
        for _ in range(rng.randint(0, 3 * n)):
            x, y, bond = rng.randrange(n + 1), rng.randrange(n + 1), rng.choice("-=")  # some ends have no vertex
            edges += [(g, x, y, bond), (g, y, x, bond)]
    vertices += [(11, 0, "N"), (50, 0, None), (51, None, "C"), (None, 0, "C"), (52, 0, "C"), (52, 1, "O")]
    edges += [(52, 0, 1, None), (52, 1, 0, None), (99, 0, 1, "-")]
    for kind in ("bigint", "string"):
        v = spark.createDataFrame(vertices, "graph bigint, vertex bigint, label string").selectExpr(f"cast(graph as {kind}) graph", f"cast(vertex as {kind}) vertex", "label").repartition(3)
        e = spark.createDataFrame(edges, "graph bigint, src bigint, dst bigint, bond string").selectExpr(f"cast(graph as {kind}) graph", f"cast(src as {kind}) src", f"cast(dst as {kind}) dst", "bond").repartition(3)
        want = sorted(map(tuple, fingerprint._joined_bits(v, e, "graph", "vertex", "label", "src", "dst", "bond", 2, 2048).collect()), key=repr)
        for slot_rows, large in ((20, 100), (20, 1 << 20)):
            got = fingerprint.graph_fingerprint(v, e, slot_rows=slot_rows, large=large).collect()
            assert sorted(map(tuple, got), key=repr) == want
        sets = {r.graph: (r.on_bits, r.n_on) for r in fingerprint.graph_sets(v, e, slot_rows=20, large=100).collect()}
        plain = {g: sorted(b for h, b in want if h == g and b is not None) for g, _ in want}
        assert sets == {g: (b, len(b)) for g, b in plain.items()}


def test_small_graphs_are_shuffled_once(spark):
    v = spark.createDataFrame([(1, 1, "C"), (1, 2, "O")], "graph bigint, vertex bigint, label string")
    e = spark.createDataFrame([(1, 1, 2, "-"), (1, 2, 1, "-")], "graph bigint, src bigint, dst bigint, bond string")
    plan = fingerprint.graph_fingerprint(v, e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_bit_vectors_of_odd_lists(spark):
    lists = [[5, 1, 5, 0], [], None, [63, 64, -1, None, 2], [7]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, on_bits array<int>").coalesce(1)
    made = fingerprint.bit_vectors(df, n_bits=64)
    found = {r["id"]: r["features"] for r in made.collect()}
    for i, want in enumerate(lists):
        places = None if want is None else sorted({b for b in want if b is not None and 0 <= b < 64})
        assert found[i] is None if places is None else (found[i].size, found[i].indices.tolist(), found[i].values.tolist()) == (64, places, [1.0] * len(places))
    assert "as array<string>" not in made._jdf.queryExecution().executedPlan().toString()
