"""Corrected chunk steps against a plain optimum."""

import numpy as np
import pytest

from moltabula.operators import corrected
from moltabula.plans.table_queries import QUERIES, split_prints

FOLDER = "/root/testdata/sf0.001"


def plain_fit(rows, width, c=1.0):
    """Newton's method on dense rows, with balanced weights."""
    n, y = len(rows), np.array([r[1] for r in rows], float)
    x = np.zeros((n, width + 1))
    x[:, -1] = 1.0
    for i, (bits, _) in enumerate(rows):
        for b in bits or []:
            x[i, b] += 1.0
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    penalty = np.append(np.full(width, 1 / c), 0.0)
    w = np.zeros(width + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + penalty * w
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(penalty), slope)
    margin = x @ w
    return w, ((weight * (np.logaddexp(0, margin) - y * margin)).sum() + 0.5 * penalty @ w**2) / n


def made_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        bits = sorted(set(rng.integers(0, 12, rng.integers(0, 6)).tolist()))
        rows.append((bits, int(rng.random() < (0.8 if 3 in bits else 0.25))))
    return rows


@pytest.mark.parametrize("chunk_rows", [17, 100, 50_000])
def test_chunks_of_any_size_reach_the_optimum(spark, chunk_rows):
    rows = made_rows(400)
    rows += [([1, 2, 3], 1)] * 200  # a third of all rows are copies
    want, loss = plain_fit(rows, 12)
    df = spark.createDataFrame(rows, "on_bits array<int>, label int")
    weights, history = corrected.train_corrected(df, n_bits=12, chunk_rows=chunk_rows)
    got = {r.feature: r.weight for r in weights.collect()}
    assert sorted(got) == list(range(-1, 12))
    told = history.orderBy("round").collect()
    assert all(b.loss < a.loss for a, b in zip(told, told[1:])) and abs(told[-1].loss - loss) < 1e-6
    assert max(abs(got[i] - want[i]) for i in range(-1, 12)) < 5e-3


def test_nulls_repeated_bits_and_other_columns(spark):
    rows = made_rows(120) + [(None, 0), ([], 1), ([4, 4], 1)]
    want, _ = plain_fit(rows, 12)
    mixed = [(b, y, 1.0, 7) for b, y in rows] + [([1], None, 2.0, 8)] * 5
    df = spark.createDataFrame(mixed, "on_bits array<int>, label int, weight double, at int")
    got = {r.feature: r.weight for r in corrected.train_corrected(df, n_bits=12, chunk_rows=40)[0].collect()}
    assert max(abs(got[i] - want[i]) for i in range(-1, 12)) < 5e-3


@pytest.mark.parametrize("rows", [[], [([1], 1), ([2], 1)], [([1], None)]])
def test_one_class_is_an_error(spark, rows):
    with pytest.raises(ValueError):
        corrected.train_corrected(spark.createDataFrame(rows, "on_bits array<int>, label int"), n_bits=4)


def test_chunks_are_cut_exactly():
    import pyarrow as pa

    schema = pa.schema([("on_bits", pa.list_(pa.int32())), ("label", pa.int32()), ("weight", pa.float64())])
    batches = [pa.record_batch([[[i] for i in range(n)], [0] * n, [1.0] * n], schema=schema) for n in (3, 0, 9, 1)]
    assert [len(c.label) for c in corrected._chunks(iter(batches), 10, 5)] == [5, 5, 3]
    assert list(corrected._chunks(iter([]), 10, 5)) == []


def test_queries_agree_with_the_solver(spark):
    want = {r.feature: r.weight for r in QUERIES["linear_weights"](spark, FOLDER).collect()}
    got = {r.feature: r.weight for r in QUERIES["corrected_weights"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 3e-3
    linear = {r.ordinal: r.score for r in QUERIES["linear_scores"](spark, FOLDER).collect()}
    scored = {r.ordinal: r for r in QUERIES["corrected_scores"](spark, FOLDER).collect()}
    assert scored.keys() == linear.keys() and all(abs(scored[k].score - linear[k]) < 2e-3 for k in linear)
    train = split_prints(spark, FOLDER).filter("split = 'train'").select("on_bits", "label").collect()
    n, pos = len(train), sum(r.label for r in train)
    total = 0.5 * sum(w * w for f, w in want.items() if f >= 0)
    for r in train:
        margin = want[-1] + sum(want[b] for b in r.on_bits)
        total += n / (2 * (pos if r.label else n - pos)) * (np.logaddexp(0, margin) - r.label * margin)
    (loss,) = {r.train_loss for r in scored.values()}
    assert abs(loss - total / n) < 0.01 * total / n


def test_a_chunk_takes_little_more_than_its_bits():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, each, width = 10_000, 250, 2048
    bits = rng.integers(0, width, n * each, dtype=np.int32)
    table = pa.table({"on_bits": pa.ListArray.from_arrays(np.arange(0, n * each + 1, each, dtype=np.int32), pa.array(bits)),
                      "label": pa.array(np.arange(n) % 2), "weight": pa.array(np.ones(n))})
    w, values = rng.normal(size=width + 1), rng.normal(size=n)
    tracemalloc.start()
    chunk = corrected.Chunk(table, width)
    margins, sums = chunk.margins(w), chunk.collect(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * n * each
    assert np.allclose(margins, w[bits].reshape(n, each).sum(axis=1) + w[-1])
    assert np.allclose(sums[:-1], np.bincount(bits, weights=np.repeat(values, each), minlength=width)) and np.isclose(sums[-1], values.sum())
