"""A caller's own aggregate: states, merges and hot keys."""

import math
import random
from collections import defaultdict

import pytest

from moltabula.operators.aggregate import Aggregate, aggregate, geometric_mean, greatest


def rows():
    rng = random.Random(4)
    out = [(rng.choice(["hot"] * 6 + ["a", "b", None, ""]), i % 3 or None, rng.choice([None, -1.0, 0.5, 2.0, 7.0, float(i)]), i) for i in range(900)]
    return [*out, out[0], ("alone", 1, None, 5)]


@pytest.mark.parametrize("held", [10_000, 1, 2])
def test_against_plain_groups(spark, held):
    df = spark.createDataFrame(rows(), "k string, j int, x double, i bigint").repartition(5)
    groups = defaultdict(list)
    for k, j, x, i in rows():
        groups[(k, j)].append((x, i))
    means = {(r["k"], r["j"]): (r["geometric_mean"], r["n"]) for r in aggregate(df, ["k", "j"], ["x"], geometric_mean("x"), "geometric_mean double, n bigint", held).collect()}
    best = aggregate(df, ["k", "j"], ["x", "i"], greatest(3, "x", "i"), "carried array<bigint>", held)
    lists = {(r["k"], r["j"]): r["carried"] for r in best.collect()}
    assert best.columns == ["k", "j", "carried"] and set(means) == set(lists) == set(groups)
    for key, held_rows in groups.items():
        good = [x for x, _ in held_rows if x is not None and x > 0]
        assert means[key][1] == len(good)
        assert means[key][0] is None if not good else abs(means[key][0] - math.exp(sum(map(math.log, good)) / len(good))) < 1e-9
        assert lists[key] == [i for _, i in sorted(((x, i) for x, i in held_rows if x is not None), key=lambda r: (-r[0], r[1]))[:3]]


def test_a_hot_key_is_one_state_for_each_task(spark):
    df = spark.range(5000).selectExpr("1 as k", "id").repartition(7)
    merges = Aggregate(lambda: (0, 1), lambda s, r: (s[0] + r["id"], s[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: {"total": s[0], "states": s[1]})
    row = aggregate(df, ["k"], ["id"], merges, "total bigint, states bigint").first()
    assert row["total"] == 4999 * 2500 and row["states"] <= 7


def test_no_rows_and_no_key(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert aggregate(df, ["k"], ["x"], geometric_mean("x"), "geometric_mean double, n bigint").collect() == []
    with pytest.raises(ValueError):
        aggregate(df, [], ["x"], geometric_mean("x"), "geometric_mean double, n bigint")
