"""Rows, values and differences between keys that must not get lost."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from moltabula import scratch
from moltabula.functions.text import char_grams, tokens
from moltabula.operators import contrastive, dedup, fingerprint, metrics, models, rank, rowfn, rules
from moltabula.sources import readers, resolve, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_linear_models_after_an_observation(spark, tmp_path):
    df = spark.createDataFrame([(i, [i % 5, 5 + i % 3], int(i % 5 < 2)) for i in range(60)], "id int, on_bits array<int>, label int")
    seen = Observation("seen")
    assert dedup.drop_failed(df, "label", seen).count() == 60 and seen.get["n_seen"] == 60
    ready = fingerprint.bit_vectors(df, n_bits=8)
    model = models.train_linear(ready)
    scored = models.score_linear(model, ready).select("label", "score").collect()
    assert all((r.score > 0.5) == (r.label == 1) for r in scored)
    probe = models.linear_probe(df.select(F.array(F.col("on_bits")[0].cast("double")).alias("v"), "label"), "v")
    assert probe.first().average_precision > 0.5
    models.save_model(model, models.model_metadata(df, "label", ["a"]), str(tmp_path / "m"))
    loaded, _ = models.load_linear(spark, str(tmp_path / "m"))
    assert models.score_linear(loaded, ready).select("score").collect() == [(r.score,) for r in scored]


def test_tokens_of_any_script(spark):
    df = spark.createDataFrame([("Привет мир, größe 9x",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["привет", "мир", "größe", "9x"]


def test_grams_tell_structures_apart(spark):
    pairs = [("c1ccccc1", "C1CCCCC1"), ("CC", "cc"), ("C=C", "C#C"), ("=", "#")]
    df = spark.createDataFrame([(x,) for p in pairs for x in p] + [("",), (None,)], "t string")
    bits = {r.t: r.on_bits for r in fingerprint.hash_fingerprint(df, "t", grams=3).collect()}
    assert all(bits[a] != bits[b] and bits[a] and bits[b] for a, b in pairs) and bits[""] == [] and None not in bits
    assert df.select(char_grams(F.lit("añb😀c"), 3)).first()[0] == ["añb", "ñb😀", "b😀c"]


def test_unlisted_sources_stay(spark):
    df = spark.createDataFrame(
        [("a", "PKS"), ("a", "npc"), ("b", "npc"), ("b", "chem"), ("c", None), ("d", None), ("d", "zzz"), ("d", "npc")], "smiles string, source string")
    got = dedup.compile_dedup(df, priority=("PKS", "bio", "chem")).collect()
    assert {(r.smiles, r.source) for r in got} == {("a", "PKS"), ("a", "npc"), ("b", "chem"), ("c", None), ("d", "npc")} and len(got) == 5


def test_lost_shards_are_told(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("index"))
    writers.write_shards(df, str(tmp_path / "s"), 4, "index")
    (tmp_path / "s" / "shard=x").mkdir()
    (tmp_path / "s" / "shard=x" / "a.parquet").write_text("no")
    with pytest.warns(UserWarning, match="1 of"):
        assert readers.merge_shards(spark, str(tmp_path / "s" / "shard=*"), df.schema, "index").count() == 20
    with pytest.raises(ValueError, match="could be read"):
        readers.read_shards(spark, str(tmp_path / "s" / "shard=x"), df.schema)


def test_csv_keeps_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a\nb, "c"\n\n d '), (2, " x"), (3, None)], "i int, t string")
    writers.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert rows(resolve.read_table(spark, str(tmp_path / "t.csv"), schema=df.schema)) == rows(df)


def test_row_functions_see_whole_numbers_and_none(spark):
    df = spark.createDataFrame([(9007199254740993,), (None,)], "n long").coalesce(1)
    got = rowfn.map_rows(df, lambda r: {"n": r["n"], "none": r["n"] is None}, "n long, none boolean").collect()
    assert {tuple(r) for r in got} == {(9007199254740993, False), (None, True)}


def test_many_rules_in_one_plan(spark):
    df = spark.createDataFrame([("abc abd",)], "t string")
    many = [rules.Rule(f"r{i}", "b" if i % 1000 == 7 else f"q{i}", "x") for i in range(5000)]
    got = rules.apply_rules(df, "t", many).collect()
    assert sorted((r.rule_order, r.site, r["product"]) for r in got) == sorted(
        (i, s, p) for i in range(7, 5000, 1000) for s, p in ((0, "axc abd"), (1, "abc axd")))
    table = rules.rule_table(spark, many[:8])
    assert rules.apply_rules(df, "t", table).count() == 2
    chained = [rules.Rule("a", "a", "x"), rules.Rule("none", "z", "x"), rules.Rule("b", "b", "x")]
    assert {r.rule for r in rules.apply_rules(df, "t", chained, chain=True).collect()} == {"a"}


def test_contrastive_batches_of_any_size(spark, monkeypatch):
    df = spark.range(90).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"), (F.col("id") % 4).alias("y"))
    whole = contrastive.supcon_loss(df, "v", "y", "id", 90).first()
    monkeypatch.setattr(contrastive, "ANCHOR_ROWS", 7)
    import numpy as np

    data = sorted((r.id, r.v, r.y) for r in df.collect())
    loss, anchors = contrastive._loss(np.array([v for _, v, _ in data]), np.array([y for *_, y in data]), 0.1)
    assert anchors == whole.n_anchors == 90 and abs(loss - whole.loss) < 1e-9
    assert contrastive.supcon_loss(df, "v", "y", "id", 10_000).first().n == 90


@pytest.mark.parametrize("size, block", [(None, 7), (None, 500), (37, 5), (1, 3), (2, 1)])
def test_batches_spread_over_tasks(spark, size, block):
    df = spark.range(90).select(
        (F.col("id") * 3 % 97).alias("o"), F.array(20 * F.sin("id"), 20 * F.cos("id")).alias("v"), (F.col("id") % 40).alias("y"), F.lit("x").alias("batch"), F.lit(0).alias("id"))
    got = {r.batch: (r.n, r.n_anchors, r.loss) for r in contrastive.supcon_loss_spread(df, "v", "y", "o", size, 0.05, block).collect()}
    want = {r.batch: (r.n, r.n_anchors, r.loss) for r in contrastive.supcon_loss(df, "v", "y", "o", size or 1000, 0.05).collect()}
    assert got.keys() == want.keys()
    for batch, (n, anchors, loss) in want.items():
        assert got[batch][:2] == (n, anchors)
        assert got[batch][2] is None if loss is None else abs(got[batch][2] - loss) < 1e-9 * max(1, abs(loss))


def test_spread_batches_without_rows_labels_or_vectors(spark):
    schema = "o long, v array<double>, y int"
    assert contrastive.supcon_loss_spread(spark.createDataFrame([], schema), "v", "y", "o").collect() == []
    some = spark.createDataFrame([(1, [1.0], None), (2, [2.0], None), (3, None, 1), (None, [1.0], 1)], schema)
    assert [tuple(r) for r in contrastive.supcon_loss_spread(some, "v", "y", "o").collect()] == [(0, 2, 0, 0.0)]
    with pytest.raises(ValueError):
        contrastive.supcon_loss_spread(some, "v", "y", "o", 0)


def test_rows_without_a_score_are_in_no_count(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, None)], "label int, score double")
    got = metrics.eval_report(df).first()
    assert got.n_samples == 2 and got.roc_auc == 1.0 and got.accuracy == 1.0


def test_buckets_follow_the_shuffle_width(spark):
    df = spark.range(10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        small = rank._levels(df)
        spark.conf.set("spark.sql.shuffle.partitions", "20000")
        assert rank._levels(df) > small == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class _Far:
    """A session on a cluster without a shared folder."""

    class sparkContext:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                return type("Context", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))})

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_no_machine_local_scratch_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(_Far)


def test_slow_and_failing_pairs_score_zero(spark):
    import time

    from moltabula.operators import overlap

    def score(a, b):
        if b == 1:
            time.sleep(30)
        if b == 2:
            raise ValueError
        return b / 10

    test = spark.createDataFrame([(0, 1, 5)], "ordinal long, label int, size int")
    train = spark.createDataFrame([(i, i % 2, i) for i in range(1, 5)], "ordinal long, label int, size int")
    found = overlap.best_match(test, train, score, "size", seconds=0.2).first()
    assert found.score == 0.4 and found.nn_text == "4"
    alone = overlap.best_match(test, train.filter("size < 3"), score, "size", seconds=0.2).first()
    assert alone.score == 0.0


def test_every_row_gets_all_its_neighbours(spark):
    from moltabula.operators import similarity

    data = [(i, [i * 20, i * 20 + 1]) for i in range(40)] + [(100, []), (101, [])]
    df = spark.createDataFrame(data, "ordinal long, on_bits array<int>")
    counts = similarity.knn_lsh(df, k=5).groupBy("ordinal").count().collect()
    assert len(counts) == 42 and {r["count"] for r in counts} == {5}


def test_size_classes_lose_no_near_neighbour(spark):
    import random

    from moltabula.operators import similarity

    rng = random.Random(9)
    base = sorted(rng.sample(range(2048), 200))
    rows = [(i, sorted(rng.sample(base, n))) for i, n in enumerate(rng.choices(range(1, 201), k=120))]
    sets = spark.createDataFrame([(i, b, [i]) for i, b in rows], "id long, on_bits array<smallint>, ordinals array<long>")
    queries, targets = sets.filter("id % 2 = 0"), sets.filter("id % 2 = 1")
    full = {r["id"]: (round(r["score"], 9), r["nn"]) for r in similarity.nearest_sets(queries, targets, ()).collect()}
    for thresholds in ((0.95,), (0.8, 0.5), (0.3,)):
        got = {r["id"]: (round(r["score"], 9), r["nn"]) for r in similarity.nearest_sets(queries, targets, thresholds, keyed=True).collect()}
        assert got == full


def test_saved_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([("PKS", [0, 5]), ("bio", [])], "source string, on_bits array<int>")
    writers.write_training_arrays(df, str(tmp_path / "x"))
    back = spark.read.parquet(str(tmp_path / "x" / "arrays")).collect()
    assert sorted((sum(r.fps), r.label) for r in back) == [(0.0, 0), (2.0, 1)]
    weights = spark.createDataFrame([(-1, 0.5), (3, 1.0)], "feature int, weight double")
    models.save_weights(weights, df.limit(1), str(tmp_path / "w"))
    assert rows(models.load_weights(spark, str(tmp_path / "w"))[0]) == [(-1, 0.5), (3, 1.0)]


def test_blocks_grow_with_the_batch(spark, monkeypatch):
    """Each row is copied once for every block of its batch, so blocks of a large batch must not stay small."""
    taken = {}

    def spy(*args, **options):
        taken.update(options)
        return match_keyed(*args, **options)

    match_keyed = contrastive.match_keyed
    monkeypatch.setattr(contrastive, "match_keyed", spy)
    df = spark.range(3000).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"), (F.col("id") % 4).alias("y"))
    got = contrastive.supcon_loss_spread(df, "v", "y", "id", block_rows=10).first()
    want = contrastive.supcon_loss(df, "v", "y", "id", 3000).first()
    assert taken["limit"] >= 300 and abs(got.loss - want.loss) < 1e-9
    monkeypatch.setattr(contrastive, "CELL_BYTES", 16 * 50)
    contrastive.supcon_loss_spread(df, "v", "y", "id", block_rows=10)
    assert taken["limit"] == 50


def test_alike_rows_are_not_copied_for_each_band(spark, monkeypatch):
    """Where bands move more rows than a comparison of all, each pair is compared once, and the result is that of the exact graph."""
    from moltabula.operators import similarity

    keyed = []

    def spy(*args, **options):
        keyed.append(1)
        return match_keyed(*args, **options)

    match_keyed = similarity.match_keyed
    monkeypatch.setattr(similarity, "match_keyed", spy)
    alike = spark.createDataFrame([(i, [*range(30), 30 + i % 40, 80 + i]) for i in range(120)], "ordinal long, on_bits array<int>")
    got = {tuple(r) for r in similarity.knn_lsh(alike, k=3).collect()}
    assert not keyed and got == {tuple(r) for r in similarity.knn_graph(alike, k=3).collect()}
    apart = spark.createDataFrame([(i, [12 * (i // 2) + j for j in range(10 + i % 2)]) for i in range(300)], "ordinal long, on_bits array<int>")
    assert {(r["ordinal"], r["neighbour"]) for r in similarity.knn_lsh(apart, k=1, keyed=True).collect()} == {(i, i ^ 1) for i in range(300)} and keyed
