"""What models return, against plain computations on the same rows."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from moltabula.operators import metrics, models
from moltabula.plans.table_queries import QUERIES, training_rows

FOLDER = "/root/testdata/sf0.001"


def plain_ap(rows):
    """Average precision of (label, score) pairs; equal scores are one threshold."""
    total, hits, seen, before = sum(y for y, _ in rows), 0, 0, 0
    value = 0.0
    for score in sorted({s for _, s in rows}, reverse=True):
        group = [y for y, s in rows if s == score]
        hits, seen = hits + sum(group), seen + len(group)
        value += (hits - before) / total * hits / seen
        before = hits
    return value


def test_weights_are_the_optimum_and_give_the_scores(spark):
    weights = {r.feature: r.weight for r in QUERIES["linear_weights"](spark, FOLDER).collect()}
    rows = training_rows(spark, FOLDER).select("ordinal", "split", "label", "on_bits").collect()
    train = [r for r in rows if r.split == "train"]
    n, pos = len(train), sum(r.label for r in train)
    balance = {1: n / (2 * pos), 0: n / (2 * (n - pos))}

    def score(r):
        return 1 / (1 + math.exp(-(weights[-1] + sum(weights[b] for b in r.on_bits))))

    slope = np.zeros(2049)
    for r in train:
        pull = (score(r) - r.label) * balance[r.label]
        slope[list(r.on_bits)] += pull
        slope[2048] += pull
    slope[:2048] += [weights[i] for i in range(2048)]
    assert len(weights) == 2049 and np.abs(slope).max() < 5e-3
    assert max(abs(w) for w in weights.values()) > 0.05
    want = {r.ordinal: (r.label, score(r)) for r in rows if r.split == "test"}
    got = {r.ordinal: (r.label, r.score) for r in QUERIES["linear_scores"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in got)


def test_coordinates_are_the_principal_ones(spark):
    vectors = {str(r.vec_id): r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()}
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names], float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    placed = {r.smiles: (r.component_1, r.component_2) for r in QUERIES["coordinates_2d"](spark, FOLDER).collect()}
    got = np.array([placed[n] for n in names])
    want = x @ axes[:2].T
    for j in range(2):
        assert min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 1e-4


def test_epochs_go_on_from_each_other(spark):
    data = [(array, int(array[0] * array[1] > 0)) for array in np.random.default_rng(5).normal(size=(300, 4)).tolist()]
    rows = spark.createDataFrame(data, "v array<double>, label int").select(array_to_vector("v").alias("features"), "label")
    model, history = models.train_mlp_epochs(rows, rows, width=4, hidden=(16,), epochs=12, steps=3)
    told = [tuple(r) for r in history.orderBy("epoch").collect()]
    losses, aps = [h[1] for h in told], [h[2] for h in told]
    assert [h[0] for h in told] == list(range(1, 13)) and losses[-1] < losses[0] * 0.8
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    scored = [(r.label, r.score) for r in models.score_linear(model, rows).collect()]
    assert abs(plain_ap(scored) - max(aps)) < 1e-9
    assert metrics.best_epoch(history, "epoch", "val_ap").first().best_epoch == aps.index(max(aps)) + 1
    with pytest.raises(ValueError):
        models.train_mlp_epochs(rows, rows, width=4, epochs=0)


def test_no_validation_rows_keep_the_last_epoch(spark):
    rows = spark.createDataFrame([([float(i), 1.0], i % 2) for i in range(20)], "v array<double>, label int").select(array_to_vector("v").alias("features"), "label")
    model, history = models.train_mlp_epochs(rows, rows.limit(0), width=2, hidden=(3,), epochs=2, steps=1)
    assert model is not None and [r.val_ap for r in history.collect()] == [None, None]


def test_query_of_epochs(spark):
    got = QUERIES["mlp_epochs"](spark, FOLDER).collect()
    (told,) = {(r.best_epoch, r.best_val_ap) for r in got}
    assert 1 <= told[0] <= 25 and abs(plain_ap([(r.label, r.score) for r in got]) - told[1]) < 1e-6
