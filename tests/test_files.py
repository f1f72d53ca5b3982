"""Sources, sinks, fingerprint forms and the whole pipeline on files."""

import json

import pytest
from pyspark.sql import functions as F

from moltabula.functions import bits
from moltabula.operators import fingerprint
from moltabula.operators.rank import rank_by_value
from moltabula.plans import pipelines
from moltabula.sources import readers, resolve, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_resolution_order(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([("C", "PKS")], "smiles string, source string")
    with pytest.raises(FileNotFoundError):
        resolve.load_split(spark, base, "train")
    writers.write_table(df, f"{base}/train/baseline_train.csv", "csv")
    assert rows(resolve.load_split(spark, base, "train", schema=df.schema)) == [("C", "PKS")]
    assert resolve.column_names(spark, f"{base}/train/baseline_train.csv") == ["smiles", "source"]
    writers.write_table(df.withColumn("fp_0", F.lit(1)), f"{base}/train/baseline_train_ecfp4.parquet")
    assert resolve.load_split(spark, base, "train").columns == ["smiles", "source", "fp_0"]
    assert resolve.load_split(spark, base, "train", columns=["smiles", "source"]).columns == ["smiles", "source"]
    with pytest.raises(FileNotFoundError):
        resolve.load_split(spark, base, "val", features=True)
    with pytest.raises(ValueError, match="source"):
        resolve.require_columns(df.drop("source"), ["smiles", "source"])
    with pytest.warns(UserWarning):
        assert {r["split"] for r in readers.load_splits(spark, base).collect()} == {"train"}


def test_lines(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert readers.read_lines(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "a.txt").write_text(" C \n\n\t\nCC\nC\n")
    got = readers.read_lines(spark, str(tmp_path / "a.txt"))
    assert rows(got) == [("C",), ("C",), ("CC",)]
    writers.write_distinct_lines(got, "value", str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out"))) == [("C",), ("CC",)]


def test_record_has_null_for_nan(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), 0.5, 3)], "auroc double, acc double, n int")
    writers.write_record(df, str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("part-*")).read_text()
    assert json.loads(text) == {"auroc": None, "acc": 0.5, "n": 3}


def test_empty_shards_are_no_error(spark, tmp_path):
    path = str(tmp_path / "e")
    df = spark.createDataFrame([], "index bigint, v string")
    for i in range(3):
        df.coalesce(1).write.parquet(f"{path}/shard={i}")
    assert readers.merge_shards(spark, f"{path}/shard=*", df.schema).collect() == []
    (tmp_path / "e" / "shard=9").mkdir()
    (tmp_path / "e" / "shard=9" / "part.parquet").write_text("not a table")
    with pytest.raises(ValueError):
        readers.read_shards(spark, f"{path}/shard=9", df.schema)


def test_shards_survive_a_broken_file(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("index"), (F.col("id") * 2).alias("v"))
    path = str(tmp_path / "s")
    writers.write_shards(df, path, 4, "index")
    broken = tmp_path / "s" / "shard=9"
    broken.mkdir()
    (broken / "part-x.parquet").write_text("not parquet")
    got = readers.merge_shards(spark, f"{path}/shard=*", df.schema)
    assert [r["v"] for r in got.collect()] == [2 * i for i in range(20)]
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, f"{path}/none*", df.schema)


def test_fingerprint_forms(spark):
    df = spark.createDataFrame([("a", "PKS", [0, 63, 64, 2047]), ("b", "bio", [])], "smiles string, source string, on_bits array<int>")
    packed = df.select("smiles", "on_bits", bits.pack_words(F.col("on_bits")).alias("w"))
    for r in packed.select("*", bits.unpack_words(F.col("w")).alias("u"), bits.popcount(F.col("w")).alias("n")).collect():
        assert r["u"] == r["on_bits"] and r["n"] == len(r["on_bits"]) and len(r["w"]) == 32
    small = df.withColumn("on_bits", F.filter("on_bits", lambda b: b < 70))
    wide = bits.to_wide(small, n_bits=70)
    assert bits.feature_columns(wide)[:3] == ["fp_0", "fp_1", "fp_2"] and len(bits.feature_columns(wide)) == 70
    assert rows(bits.from_wide(wide).select("smiles", "n_on")) == [("a", 3), ("b", 0)]
    with pytest.raises(ValueError):
        bits.feature_columns(df)
    with pytest.raises(ValueError, match="fp_99"):
        bits.require_features(wide, ["fp_0", "fp_99"])
    arrays = writers.training_arrays(df)
    assert tuple(writers.describe_training_arrays(arrays).first()) == (2, 2048, 1, 1)
    vectors = fingerprint.bit_vectors(df).orderBy("smiles").collect()
    assert list(vectors[0]["features"].indices) == [0, 63, 64, 2047] and vectors[1]["features"].numNonzeros() == 0


def test_graph_fingerprint_ignores_order_and_names(spark):
    def graph(name, labels, links):
        v = [(name, k, label) for k, label in labels.items()]
        e = [(name, a, b, bond) for a, b, bond in links] + [(name, b, a, bond) for a, b, bond in links]
        return v, e

    one = graph("g1", {"x": "C", "y": "O", "z": "C"}, [("x", "y", "1"), ("y", "z", "2")])
    same = graph("g2", {"q": "C", "a": "C", "m": "O"}, [("m", "a", "2"), ("q", "m", "1")])
    other = graph("g3", {"x": "C", "y": "O", "z": "C"}, [("x", "y", "1"), ("y", "z", "1")])
    alone = graph("g4", {"x": "N"}, [])
    v = spark.createDataFrame(sum((g[0] for g in (one, same, other, alone)), []), "graph string, vertex string, label string")
    e = spark.createDataFrame(sum((g[1] for g in (one, same, other, alone)), []), "graph string, src string, dst string, bond string")
    got = {r["graph"]: r["on_bits"] for r in fingerprint.graph_bits(fingerprint.graph_fingerprint(v, e)).collect()}
    assert got["g1"] == got["g2"] != got["g3"] and len(got["g4"]) == 3


def test_pipeline_on_files(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "bio.txt").write_text("\n".join(f"n {i} c{i % 3}" for i in range(60)))
    (tmp_path / "chem.txt").write_text("\n".join(f"k {i} c{i % 3}" for i in range(60)) + "\nn 1 c1\n@\n")
    products = spark.range(40).select(F.concat(F.lit("pks "), "id", F.lit(" unit")).alias("smiles"))
    molecules = pipelines.compile_from_files(spark, products, f"{base}/bio.txt", f"{base}/chem.txt")
    assert dict(molecules.groupBy("source").count().collect()) == {"PKS": 40, "bio": 60, "chem": 60}
    parts = pipelines.split_molecules(molecules)
    pipelines.write_splits(parts, base)
    pipelines.write_fingerprints(parts, base)
    assert resolve.load_split(spark, base, "test").columns == ["smiles", "source", "on_bits", "n_on"]
    assert resolve.load_split(spark, base, "test", features=False).columns == ["smiles", "source"]
    prints = readers.load_splits(spark, base)
    numbered = rank_by_value(prints.withColumn("h", F.xxhash64("smiles")), "h", out="ordinal")
    predictions, report = pipelines.neighbour_baseline(numbered)
    assert report.first()["acc"] == 1.0 and predictions.count() == report.first()["n_rows"]
    scored, metrics = pipelines.linear_baseline(prints, f"{base}/model")
    assert metrics.first()["roc_auc"] == 1.0 and (tmp_path / "model" / "report").exists()
