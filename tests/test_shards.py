"""Shards in every state, and what a merge and a removal leave."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from moltabula.sources import shards


def _make(spark, folder, n=6000):
    df = spark.range(n).select(F.col("id").alias("index"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    schema = df.schema
    for name, rows in (("a b", df.filter("index % 3 = 0")), ("c%20", df.filter("index % 3 = 1")), ("hurt", df.filter("index % 3 = 2"))):
        rows.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size", 2_000).option("compression", "none").parquet(f"{folder}/{name}")
    df.filter("index < 0").coalesce(1).write.parquet(f"{folder}/empty")
    df.withColumn("x", F.lit(1)).coalesce(1).write.parquet(f"{folder}/other")
    os.makedirs(f"{folder}/text")
    with open(f"{folder}/text/part.parquet", "w") as f:
        f.write("no table")
    open(f"{folder}/nothing", "w").close()
    return schema


def _hurt(folder):
    """Damage in the last part of the data, with the footer left whole."""
    (path,) = glob.glob(f"{folder}/hurt/*.parquet")
    data = bytearray(open(path, "rb").read())
    footer = int.from_bytes(data[-8:-4], "little") + 8
    for i in range(int((len(data) - footer) * 0.7), len(data) - footer):
        data[i] = 0xFF
    with open(path, "wb") as f:
        f.write(data)
    for crc in glob.glob(f"{folder}/hurt/.*.crc"):
        os.unlink(crc)


def _states(spark, folder, schema, *rest, **named):
    return {r.shard: (r.state, r.rows) for r in shards.shard_states(spark, folder, schema, *rest, **named).collect()}


def test_states_merge_and_removal(spark, tmp_path):
    folder, target = str(tmp_path / "in put"), str(tmp_path / "out")
    schema = _make(spark, folder)
    _hurt(folder)
    got = _states(spark, folder, schema, ["a b", "gone", "gone"])
    assert {s: v[0] for s, v in got.items()} == {
        "a b": "good", "c%20": "good", "hurt": "broken", "empty": "empty", "other": "broken", "text": "broken", "nothing": "broken", "gone": "missing"}
    assert got["a b"][1] == got["c%20"][1] == 2000 and got["gone"][1] == 0
    assert _states(spark, folder, schema, deep=False)["hurt"] == ("good", 2000)  # its footer is sound
    states = shards.merge_good(spark, folder, schema, target)
    want = [r.x for r in spark.range(6000).filter("id % 3 < 2").orderBy("id").select(F.sha2(F.col("id").cast("string"), 256).alias("x")).collect()]
    assert [r.x for r in spark.read.parquet(target).collect()] == want and spark.read.parquet(target).columns == ["x"]
    with pytest.raises(FileExistsError):
        shards.merge_good(spark, folder, schema, target)
    assert shards.remove_merged(spark, folder, states, target) == 3
    assert sorted(os.listdir(folder)) == ["hurt", "nothing", "other", "text"]
    assert shards.remove_merged(spark, folder, states, target) == 0
    with pytest.raises(ValueError, match="no shard"):
        shards.merge_good(spark, folder, schema, str(tmp_path / "out2"))


def test_nothing_goes_before_all_rows_are_there(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(10).select(F.col("id").alias("index"), F.col("id").alias("x"))
    df.write.parquet(f"{folder}/one")
    states = shards.merge_good(spark, folder, df.schema, target)
    df.limit(3).select("x").write.mode("overwrite").parquet(target)
    with pytest.raises(RuntimeError, match="holds 3 rows, the shards 10"):
        shards.remove_merged(spark, folder, states, target)
    os.unlink(f"{target}/_SUCCESS")
    with pytest.raises(RuntimeError, match="committed"):
        shards.remove_merged(spark, folder, states, target)
    assert os.listdir(folder) == ["one"]


def test_no_folder_and_only_empty_shards(spark, tmp_path):
    df = spark.range(0).select(F.col("id").alias("index"), F.col("id").alias("x"))
    assert _states(spark, str(tmp_path / "no"), df.schema) == {}
    assert _states(spark, str(tmp_path / "no"), df.schema, ["s"]) == {"s": ("missing", 0)}
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    states = shards.merge_good(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    assert shards.remove_merged(spark, str(tmp_path / "in"), states, str(tmp_path / "out")) == 1
