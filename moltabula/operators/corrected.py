"""Logistic fits by corrected chunk steps: full gradients, and chunks that go on from them on their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.constants import N_BITS
from moltabula.operators.split import with_balanced_weight
from moltabula.scratch import written

STEP_SIZES = tuple(2.0**-i for i in range(10))
NEWTON_STEPS = 3
INNER_STEPS = 15
BLOCK_ROWS = 2048


class Chunk:
    """Rows of set bits as flat arrays. The last place of every vector of weights is the intercept."""

    def __init__(self, table: pa.Table, width: int):
        lists = table["on_bits"].combine_chunks()
        self.bits = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int16 if width < 1 << 15 else np.int32)
        self.starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
        self.label = table["label"].to_numpy().astype(float)
        self.weight = table["weight"].to_numpy().astype(float)
        self.width = width

    def _blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some rows at a time, with the row and the number of each of their bits: these take many times the memory of the bits."""
        for at in range(0, len(self.label), BLOCK_ROWS):
            rows = slice(at, min(at + BLOCK_ROWS, len(self.label)))
            starts = self.starts[rows.start:rows.stop + 1]
            yield rows, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), self.bits[starts[0]:starts[-1]]

    def margins(self, w: np.ndarray) -> np.ndarray:
        made = [np.bincount(own, weights=w[bits], minlength=rows.stop - rows.start) for rows, own, bits in self._blocks()]
        return np.concatenate([np.zeros(0), *made]) + w[-1]

    def collect(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(self.width)
        for rows, own, bits in self._blocks():
            sums += np.bincount(bits, weights=values[rows][own], minlength=self.width)
        return np.append(sums, values.sum())

    def loss(self, margin: np.ndarray) -> float:
        return float((self.weight * (np.logaddexp(0.0, margin) - self.label * margin)).sum())

    def pulls(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slope and curvature of the loss of each row."""
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))
        return self.weight * (p - self.label), self.weight * p * (1.0 - p)


def _chunks(batches: Iterator[pa.RecordBatch], width: int, chunk_rows: int) -> Iterator[Chunk]:
    """Chunks of exactly ``chunk_rows`` rows, and one for the rest."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, chunk_rows - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == chunk_rows:
                table, held, rows = pa.Table.from_batches(held), [], 0
                made, table = Chunk(table, width), None
                yield made
                made = None
    if rows:
        yield Chunk(pa.Table.from_batches(held), width)


def _sums(rows: DataFrame, per_chunk, width: int, chunk_rows: int) -> np.ndarray:
    """Sum of the vectors that ``per_chunk`` makes. A task adds up its own chunks; the driver gets one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for chunk in _chunks(batches, width, chunk_rows):
            made = per_chunk(chunk)
            del chunk  # before the next one is built
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"at": np.arange(len(total), dtype=np.int32), "v": total}))

    found = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    result = np.zeros(len(found))
    for row in found:
        result[row["at"]] = row["v"]
    return result


def _solve(curvature, slope: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """About the step that takes a quadratic to its minimum: conjugate gradients, scaled by the diagonal."""
    step, rest = np.zeros_like(slope), -slope
    towards = scaled = rest / scale
    size = first = rest @ scaled
    for _ in range(INNER_STEPS):
        if size <= 1e-4 * first:
            break
        bent = curvature(towards)
        length = size / (towards @ bent)
        step, rest = step + length * towards, rest - length * bent
        scaled = rest / scale
        size, before = rest @ scaled, size
        towards = scaled + size / before * towards
    return step


def _corrected(chunk: Chunk, start: np.ndarray, slope: np.ndarray, bend: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Where a chunk comes from ``start`` when its own gradient is corrected by the difference to that of all rows.

    A feature that bends the loss less in this chunk than in all rows is held back by the difference, since the chunk knows little of it.
    """
    mass = chunk.weight.sum()
    pull, curve = chunk.pulls(chunk.margins(start))
    correction = slope - chunk.collect(pull) / mass
    hold = np.maximum(bend - chunk.collect(curve) / mass, 0.0) + 1e-12

    def value(w: np.ndarray, margin: np.ndarray) -> float:
        away = w - start
        return chunk.loss(margin) / mass + correction @ away + 0.5 * (hold @ away**2 + penalty @ w**2)

    w, margin = start, chunk.margins(start)
    for _ in range(NEWTON_STEPS):
        pull, curve = chunk.pulls(margin)
        g = chunk.collect(pull) / mass + correction + hold * (w - start) + penalty * w
        flat = hold + penalty
        scale = chunk.collect(curve) / mass + flat

        def bent(v: np.ndarray) -> np.ndarray:
            return chunk.collect(curve * chunk.margins(v)) / mass + flat * v

        step = _solve(bent, g, scale)
        now, t = value(w, margin), 1.0
        while t > 1e-4:
            ahead = w + t * step
            ahead_margin = chunk.margins(ahead)
            if value(ahead, ahead_margin) <= now:
                break
            t /= 2
        else:
            break
        w, margin = ahead, ahead_margin
    return w


def train_corrected(df: DataFrame, on_bits: str = "on_bits", label: str = "label", n_bits: int = N_BITS, c: float = 1.0, chunk_rows: int = 50_000,
                    max_rounds: int = 30, tol: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """The optimum of ``train_linear`` by few passes: ``(feature, weight)`` with intercept -1, and the history ``(round, loss, slope)``.

    A round takes the gradient over all rows at the present weights, as a snapshot. Then every chunk of ``chunk_rows`` rows goes on from there by
    itself, its gradient corrected by the difference between snapshot and own gradient, so that all chunks agree at the optimum of all rows. Their mean is the
    direction, along which the loss of all rows chooses the length. The number of chunk steps follows the rows; no chunk waits for another.

    Rows are dealt evenly, whatever their keys, and stored once. A task holds one chunk, the driver three vectors as long as the features.
    ``loss`` is the mean over balanced weights with the penalty, ``slope`` the greatest part of its gradient; rounds end when the slope is under
    ``tol`` of the first one, or when no length lowers the loss. Rows without label are left out, null bits count as none set. Without rows of both labels there is no
    optimum, which is an error.
    """
    labelled = df.select(F.coalesce(F.col(on_bits), F.array()).cast("array<int>").alias("on_bits"), F.col(label).cast("int").alias("label"))
    labelled = labelled.filter("label is not null")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError("training needs rows of both labels, 0 and 1")
    n = sum(counts.values())
    dealt = with_balanced_weight(labelled, "label", "weight").repartition(-(-n // chunk_rows))
    rows = written(dealt.select("on_bits", "label", "weight"), "corrected")
    penalty = np.append(np.full(n_bits, 1.0 / (c * n)), 0.0)
    w, history, first = np.zeros(n_bits + 1), [], None
    for turn in range(max_rounds + 1):
        def snapshot(chunk: Chunk, w=w) -> np.ndarray:
            margin = chunk.margins(w)
            pull, curve = chunk.pulls(margin)
            return np.concatenate([chunk.collect(pull), chunk.collect(curve), [chunk.loss(margin), chunk.weight.sum()]])

        made = _sums(rows, snapshot, n_bits, chunk_rows)
        mass = made[-1]
        slope, bend = made[: n_bits + 1] / mass, made[n_bits + 1 : -2] / mass
        loss = made[-2] / mass + 0.5 * penalty @ w**2
        steep = float(np.abs(slope + penalty * w).max())
        history.append((turn, float(loss), steep))
        first = steep if first is None else first
        if steep <= tol * first or turn == max_rounds:
            break

        def local(chunk: Chunk, w=w, slope=slope, bend=bend) -> np.ndarray:
            return chunk.weight.sum() * _corrected(chunk, w, slope, bend, penalty)

        direction = _sums(rows, local, n_bits, chunk_rows) / mass - w

        def ahead(chunk: Chunk, w=w, direction=direction) -> np.ndarray:
            at, along = chunk.margins(w), chunk.margins(direction)
            return np.array([chunk.loss(at + t * along) for t in STEP_SIZES])

        losses = _sums(rows, ahead, n_bits, chunk_rows) / mass
        losses += [0.5 * penalty @ (w + t * direction) ** 2 for t in STEP_SIZES]
        best = int(np.argmin(losses))
        if losses[best] >= loss:
            break
        w = w + STEP_SIZES[best] * direction
    spark = df.sparkSession
    table = [(-1, float(w[-1]))] + [(i, float(v)) for i, v in enumerate(w[:-1])]
    return spark.createDataFrame(table, "feature int, weight double"), spark.createDataFrame(history, "round int, loss double, slope double")
