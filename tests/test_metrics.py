"""Metrics, vectors, losses and models."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from moltabula.functions.vectors import l2_normalize
from moltabula.operators import contrastive, features, fingerprint, metrics, models


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_confusion_without_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    r = metrics.confusion_report(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 0.5)
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["n_samples"]) == (1, 0, 1, 0, 2)


def test_ranking_edge_cases(spark):
    assert metrics.roc_auc(scored(spark, [(1, 0.5), (0, 0.5)])).first()[0] == 0.5
    assert metrics.roc_auc(scored(spark, [(0, 0.5), (0, 0.4)])).first()[0] is None
    assert metrics.average_precision(scored(spark, [(0, 0.5), (0, 0.4)])).first()[0] == 0.0
    ap = metrics.average_precision(scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7)])).first()[0]
    assert abs(ap - 5 / 6) < 1e-12


def test_ranking_against_brute_force(spark):
    rng = random.Random(1)
    pairs = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    got = metrics.ranking_metrics(scored(spark, pairs).repartition(7)).first()
    pos, neg = ([s for y, s in pairs if y == v] for v in (1, 0))
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted(set(pos + neg), reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap += (tp / len(pos) - seen) * tp / (tp + fp)
        seen = tp / len(pos)
    assert abs(got["roc_auc"] - auc) < 1e-12 and abs(got["average_precision"] - ap) < 1e-12
    flipped = metrics.roc_auc(scored(spark, [(y, -s) for y, s in pairs])).first()[0]
    assert abs(flipped + auc - 1) < 1e-12
    report = metrics.eval_report(scored(spark, pairs), model_path="m").first()
    assert report["n_samples"] == 400 and report["model_path"] == "m"
    assert report["tp"] == sum(y == 1 and s >= 0.5 for y, s in pairs)


def test_best_epoch(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.5), (3, 0.5), (4, None)], "epoch int, ap double")
    assert metrics.best_epoch(df, "epoch", "ap").first()["best_epoch"] == 2


def test_feature_stats_and_scaling(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {r["feature"]: r for r in features.feature_stats(df, "v").collect()}
    for i in range(4):
        assert abs(got[i]["mean"] - x[:, i].mean()) < 1e-12 and abs(got[i]["std"] - x[:, i].std() - 1e-8) < 1e-12
    train = df.filter("id < 30")
    want = (x - x[:30].mean(0)) / (x[:30].std(0) + 1e-8)
    out = features.standardize_with(df, train, "v").orderBy("id").collect()
    assert np.allclose([r["scaled"] for r in out], want)
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalize(F.col("v")))
    assert [r[0] for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_supcon_loss(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = [0, 0, 1, 1, 1, 2, 0]
    df = spark.createDataFrame([(i, v.tolist(), y[i]) for i, v in enumerate(x)], "id int, v array<double>, y int")
    got = contrastive.supcon_loss(df, "v", "y", "id", 7, temperature=0.5).first()
    terms = []
    for i in range(7):
        same = [j for j in range(7) if j != i and y[j] == y[i]]
        if same:
            log_sum = math.log(sum(math.exp(x[i] @ x[k] / 0.5) for k in range(7) if k != i))
            terms.append(-np.mean([x[i] @ x[j] / 0.5 - log_sum for j in same]))
    assert got["n_anchors"] == len(terms) == 6 and abs(got["loss"] - np.mean(terms)) < 1e-12
    short = contrastive.supcon_loss(df, "v", "y", "id", 3, drop_last=True)
    assert contrastive.epoch_mean(short).first()["n_batches"] == 2
    with pytest.raises(ValueError):
        contrastive.supcon_loss(df, "v", "y", "id", 0)


def test_train_linear_matches_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 1.2).astype(int)
    rows = [(x[i].tolist(), int(y[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "v array<double>, label int").withColumn("features", array_to_vector("v"))
    model = models.train_linear(df, tol=1e-10)
    w = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (1 - y).sum()))
    z, beta = np.c_[x, np.ones(120)], np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + np.r_[beta[:3], 0]
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 1, 0])
        beta -= np.linalg.solve(hess, grad)
    assert np.allclose(np.r_[model.coefficients.toArray(), model.intercept], beta, atol=1e-4)
    table = {r["feature"]: r["weight"] for r in models.coefficients(model, spark).collect()}
    assert abs(table[-1] - model.intercept) < 1e-12 and len(table) == 4


def bit_rows(spark, n=400):
    """Positives carry bit 3, negatives bit 5, both with noise."""
    rng = random.Random(3)
    data = []
    for i in range(n):
        y = int(i % 4 == 0)
        data.append((i, y, sorted({3 if y else 5, *rng.sample(range(8, 64), 6)})))
    return spark.createDataFrame(data, "ordinal bigint, label int, on_bits array<int>")


def test_linear_scores_and_weight_table_agree(spark):
    rows = fingerprint.bit_vectors(bit_rows(spark), n_bits=64)
    model = models.train_linear(rows)
    by_model = models.score_linear(model, rows).select("ordinal", "label", F.col("score").alias("a"))
    by_table = models.score_from_weights(rows, models.coefficients(model, spark), n_bits=64)
    both = by_model.join(by_table.select("ordinal", F.col("score").alias("b")), "ordinal")
    assert both.filter(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0
    assert metrics.roc_auc(both, score="a").first()[0] == 1.0


def test_incremental_learns(spark):
    rows = bit_rows(spark)
    weights = models.train_incremental(rows, "ordinal", n_bits=64, chunks=5)
    got = models.score_from_weights(rows, weights, n_bits=64)
    assert metrics.roc_auc(got).first()[0] > 0.95


def test_mlp_probe_and_persistence(spark, tmp_path):
    rows = fingerprint.bit_vectors(bit_rows(spark, 120), n_bits=64)
    model, history = models.train_mlp(rows, rows, width=64, hidden=(8,), iterations=(2, 20))
    assert history.count() == 2 and metrics.roc_auc(models.score_linear(model, rows)).first()[0] > 0.9
    vectors = spark.createDataFrame([([float(i), 1.0], int(i > 10)) for i in range(20)], "v array<double>, label int")
    assert models.linear_probe(vectors, "v").first()[0] > 0.99
    assert models.linear_probe(vectors.filter("label = 0"), "v").first()[0] is None
    linear = models.train_linear(rows)
    models.save_model(linear, models.model_metadata(rows, "label", ["fp_0", "fp_1"], solver="l-bfgs"), str(tmp_path))
    back, meta = models.load_linear(spark, str(tmp_path))
    assert back.coefficients == linear.coefficients
    row = meta.first()
    assert row["class_counts"] == {"PKS": 30, "non-PKS": 90} and row["train_rows"] == 120
    assert row["label_mapping"] == {"PKS": 1, "non-PKS": 0} and row["feature_columns"] == ["fp_0", "fp_1"]


@pytest.mark.parametrize("pairs", [
    [(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], [(1, 0), (0, 0)], [(1, 1), (0, 1)], [(0, 1), (0, 0)], [(1, 1)],
])
def test_hard_predictions_rank_like_any_score(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, pred_label int")
    short, full = metrics.neighbour_report(df).first(), metrics.neighbour_report(df, score="pred_label").first()
    for name in ("auroc", "auprc"):
        assert short[name] == full[name] or abs(short[name] - full[name]) < 1e-12
