"""Positions, splits, samples and the checks on splits."""

import pytest
from pyspark.sql import functions as F

from moltabula.operators import quality, sampling, split
from moltabula.operators.rank import rank_by_hash, rank_by_value


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_label_any(spark):
    df = spark.createDataFrame([("a", "PKS"), ("a", "bio"), ("b", "chem"), (None, "PKS")], "k string, s string")
    assert rows(split.label_any(df, "k", F.col("s") == "PKS")) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_split_sizes_do_not_depend_on_partitions(spark, parts):
    keys = spark.range(100).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") < 50).cast("int").alias("y"))
    got = split.stratified_split(keys.repartition(parts), "k", "y")
    assert dict(got.groupBy("split").count().collect()) == {"train": 80, "val": 10, "test": 10}
    assert got.filter("y = 1").groupBy("split").count().filter("split = 'train'").first()["count"] == 40
    assert got.select("k").distinct().count() == 100
    first = rows(split.stratified_split(keys, "k", "y"))
    assert rows(got) == first


def test_stratify_fallback(spark):
    keys = spark.range(109).select("id", (F.col("id") < 9).cast("int").alias("label"))
    got = split.stratified_split(keys, "id")
    assert dict(got.groupBy("split").count().collect()) == {"train": 87, "val": 11, "test": 11}
    assert not split.can_stratify(keys) and split.can_stratify(keys.filter("label = 0"))


def test_copies_stay_together(spark):
    copies = spark.range(400).select((F.col("id") % 7).cast("string").alias("smiles"), F.lit(1).alias("label"))
    keys = copies.distinct()
    got = split.assign_splits(copies, split.stratified_split(keys))
    assert got.count() == 400
    assert {r["n_shared"] for r in quality.split_leakage(got, "smiles").collect()} == {0}
    leaky = got.withColumn("split", F.when(F.rand(1) < 0.5, "train").otherwise("test"))
    assert quality.leaked_keys(leaky, "smiles").count() == 7


def test_ranks_match_a_global_window(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v"), (F.col("id") % 3).alias("g"))
    one = rank_by_value(df.repartition(5), "v", levels=4)
    ordered = sorted(r["v"] for r in df.collect())
    assert {r["v"]: r["rank"] for r in one.collect()} == {v: i + 1 for i, v in enumerate(ordered)}
    grouped = rank_by_value(df, "v", ["g"], levels=3).collect()
    for g in range(3):
        mine = sorted((r["v"], r["rank"], r["n"]) for r in grouped if r["g"] == g)
        assert [m[1] for m in mine] == list(range(1, len(mine) + 1)) and {m[2] for m in mine} == {len(mine)}
    null_group = df.withColumn("g", F.when(F.col("g") == 0, None).otherwise(F.col("g")))
    assert rank_by_hash(null_group, "v", ["g"]).count() == 1000


def test_even_chunks(spark):
    sizes = lambda n, parts: [r["count"] for r in sampling.even_chunks(spark.range(n), "id", parts)
                              .groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes(10, 4) == [3, 3, 2, 2]
    assert sizes(2, 4) == [1, 1]


def test_batches(spark):
    counts = lambda df: sorted(r["count"] for r in df.groupBy("batch").count().collect())
    assert counts(sampling.fixed_batches(spark.range(10), "id", 4)) == [2, 4, 4]
    assert counts(sampling.fixed_batches(spark.range(10), "id", 4, drop_last=True)) == [4, 4]
    a, b = (rows(sampling.epoch_batches(spark.range(40), "id", 4, epoch=e)) for e in (1, 2))
    assert a != b and a == rows(sampling.epoch_batches(spark.range(40).repartition(9), "id", 4, epoch=1))


def test_caps_and_samples(spark):
    df = spark.range(50)
    assert rows(sampling.head_cap(df, "id", 3)) == [(0,), (1,), (2,)]
    assert sampling.head_cap(df, "id", 500).count() == 50 and sampling.head_cap(df, "id", None).count() == 50
    assert sampling.sample_exact(df, "id", 7).distinct().count() == 7
    assert sampling.sample_exact(df, "id", 70).count() == 50
    classes = df.withColumn("y", (F.col("id") < 5).cast("int"))
    assert dict(sampling.stratified_cap(classes, "id", "y", 20).groupBy("y").count().collect()) == {0: 18, 1: 2}


def test_resample_balances(spark):
    df = spark.range(4000).select("id", (F.col("id") < 40).cast("int").alias("label"))
    got = sampling.weighted_resample(df, "id")
    assert got.count() == 4000
    assert 0.45 < got.agg(F.avg("label")).first()[0] < 0.55
    assert got.filter("label = 1").select("id").distinct().count() == 40
    one_class = df.withColumn("label", F.lit(0))
    assert sampling.weighted_resample(one_class, "id").count() == 4000


def test_class_weights(spark):
    df = spark.range(12).select((F.col("id") < 3).cast("int").alias("label"))
    got = {r["label"]: r for r in split.class_weights(df).collect()}
    assert got[1]["balanced"] == 2.0 and round(got[0]["balanced"], 4) == 0.6667
    assert got[1]["positive_weight"] == 3.0
    assert {r["weight"] for r in split.with_balanced_weight(df).filter("label = 1").collect()} == {2.0}
    none = split.class_weights(df.filter("label = 0")).collect()
    assert {r["positive_weight"] for r in none} == {9.0}


def test_domain_counts(spark):
    df = spark.createDataFrame([("PKS",), ("chem",), ("chem",)], "source string")
    assert rows(split.domain_counts(df, "source", ("PKS", "bio", "chem"))) == [("PKS", 1), ("bio", 0), ("chem", 2)]


def test_ratio_check(spark):
    shares = {"train": 10, "val": 12, "test": 16}
    data = [(s, int(i < n)) for s, n in shares.items() for i in range(100)]
    got = quality.split_ratio_check(spark.createDataFrame(data, "split string, y int"), "y").collect()
    assert {(r["left"], r["right"]): r["within"] for r in got} == {
        ("train", "val"): True, ("train", "test"): False, ("val", "test"): True}


def test_first_offenders(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).cast("string").alias("split"))
    got = quality.first_offenders(df, "split", "id", 10)
    assert got.count() == 20 and got.agg(F.max("id")).first()[0] == 19
