"""Supervised contrastive loss per batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltabula.operators.cells import CELLS_PER_CORE, match_keyed
from moltabula.operators.rank import rank_by_value
from moltabula.operators.sampling import epoch_batches, fixed_batches
from moltabula.scratch import written

ANCHOR_ROWS = 1024  # anchors that meet the batch at once
PAIRS = 1 << 20  # logits at once in a cell
CELL_BYTES = 1 << 25  # vectors on one side of a cell
STATE = "id bigint, top double, scaled double, same double, positives bigint"


def _loss(vectors: np.ndarray, labels: np.ndarray, temperature: float) -> tuple[float | None, int]:
    """Mean over anchors with a positive of the mean -log softmax of their positives, self left out.

    Anchors go in blocks, so memory grows with the batch and not with its square.
    """
    n = len(labels)
    if n < 2:
        return None, 0
    parts = []
    for first in range(0, n, ANCHOR_ROWS):
        rows = np.arange(first, min(first + ANCHOR_ROWS, n))
        logits = vectors[rows] @ vectors.T / temperature
        logits[np.arange(len(rows)), rows] = -np.inf
        top = logits.max(axis=1, keepdims=True)
        log_sum = top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))
        same = labels[rows, None] == labels[None, :]
        same[np.arange(len(rows)), rows] = False
        positives = same.sum(axis=1)
        anchors = positives > 0
        total = np.where(same, logits, 0.0).sum(axis=1)
        parts.append(total[anchors] / positives[anchors] - log_sum[anchors])
    per_anchor = np.concatenate(parts)
    return (float(-per_anchor.mean()), len(per_anchor)) if len(per_anchor) else (0.0, 0)


def supcon_loss(df: DataFrame, vector: str, label: str, order: str, batch_size: int, temperature: float = 0.1,
                epoch: int | None = None, drop_last: bool = False) -> DataFrame:
    """``(batch, n, n_anchors, loss)``.

    The operator makes the batches itself, by ordinal or by a shuffled epoch, so a batch never
    exceeds ``batch_size`` rows, and its pairs live only as blocks of a matrix inside one task.
    """
    if batch_size < 1:
        raise ValueError("batch size must be at least 1")
    rows = df.select(
        F.col(order), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("bigint").alias("y")
    )
    if epoch is None:
        batched = fixed_batches(rows, order, batch_size, drop_last)
    else:
        batched = epoch_batches(rows, order, batch_size, epoch, drop_last=drop_last)

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by(order)
        vectors = np.stack(batch["v"].to_numpy())
        value, anchors = _loss(vectors, batch["y"].to_numpy(), temperature)
        return pa.table({
            "batch": pa.array([batch["batch"][0].as_py()], pa.int64()),
            "n": pa.array([batch.num_rows], pa.int64()),
            "n_anchors": pa.array([anchors], pa.int64()),
            "loss": pa.array([value], pa.float64()),
        })

    return batched.groupBy("batch").applyInArrow(run, "batch bigint, n bigint, n_anchors bigint, loss double")


def _state_matcher(temperature: float):
    """Softmax states of the anchors of a cell against its rows: greatest logit, sum of the exponentials relative to it, sum and number of the positives.

    An anchor that meets only itself has no greatest logit.
    """

    def match(anchors: pa.Table, others: pa.Table, spans: pd.DataFrame) -> pa.Table:
        q_id, t_id = anchors["id"].to_numpy(), others["id"].to_numpy()
        q_y, t_y = anchors["y"].to_numpy(), others["y"].to_numpy()
        q_v, t_v = (np.stack(side["v"].to_numpy()) for side in (anchors, others))
        parts = []
        for cell in spans.itertuples():
            there = slice(cell.t, cell.t + cell.nt)
            step = max(1, min(ANCHOR_ROWS, PAIRS // cell.nt))
            for first in range(cell.q, cell.q + cell.nq, step):
                here = slice(first, min(first + step, cell.q + cell.nq))
                own = q_id[here, None] == t_id[None, there]
                logits = q_v[here] @ t_v[there].T / temperature
                logits[own] = -np.inf
                top = logits.max(axis=1)
                met = np.isfinite(top)
                scaled = np.exp(logits[met] - top[met, None]).sum(axis=1)
                same = (q_y[here, None] == t_y[None, there]) & ~own
                total = np.where(same, logits, 0.0).sum(axis=1)
                parts.append((q_id[here][met], top[met], scaled, total[met], same.sum(axis=1)[met]))
        ids, top, scaled, total, positives = (np.concatenate(column) for column in zip(*parts))
        return pa.table({"id": ids, "top": top, "scaled": scaled, "same": total, "positives": positives.astype(np.int64)})

    return match


def supcon_loss_spread(df: DataFrame, vector: str, label: str, order: str, batch_size: int | None = None, temperature: float = 0.1,
                       block_rows: int = 4096) -> DataFrame:
    """The results of ``supcon_loss`` for batches that no task could hold; without ``batch_size`` all rows are one batch.

    A batch is cut into blocks of at least about ``block_rows`` rows, and a task compares a block of anchors with a block of the batch. Every row is copied for each block of
    its batch, so blocks of a large batch grow to ``CELL_BYTES`` of vectors, as long as there are enough of them for all cores. A task returns a state for each anchor, and
    states merge exactly: sums are brought to the greatest logit of all blocks before they are added. Rows with a null vector or a null ``order`` take no part; a null
    label is equal to none.
    """
    if batch_size is not None and batch_size < 1:
        raise ValueError("batch size must be at least 1")
    rows = df.select(F.col(order).alias("_order"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"))
    ranked = rank_by_value(rows.dropna(subset=["_order", "v"]), "_order", out="id", total="_n")
    batch = F.lit(0) if batch_size is None else F.floor((F.col("id") - 1) / batch_size)
    # both sides of the cells and the counts must see the same positions
    placed = written(ranked.select("id", batch.cast("bigint").alias("batch"), "v", F.coalesce("y", F.lit(float("nan"))).alias("y")), "batches")
    whole = placed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    met = whole["n"] * min(whole["n"], batch_size or whole["n"])
    even = math.isqrt(met // (CELLS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)) + 1
    limit = max(block_rows, min(even, CELL_BYTES // (8 * max(1, whole["width"] or 1))))
    states = match_keyed(placed, placed, _state_matcher(temperature), STATE, key="batch", limit=limit, slot_rows=max(8 * block_rows, 2 * limit))
    top = F.max("top").over(Window.partitionBy("id"))
    merged = states.withColumn("_top", top).groupBy("id").agg(
        (F.max("_top") + F.log(F.sum(F.col("scaled") * F.exp(F.col("top") - F.col("_top"))))).alias("log_sum"),
        F.sum("same").alias("same"), F.sum("positives").alias("positives"),
    )
    each = F.when(F.col("positives") > 0, F.col("same") / F.col("positives") - F.col("log_sum"))
    per_batch = placed.select("id", "batch").join(merged, "id", "left").groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.count(each).alias("n_anchors"), F.avg(each).alias("_mean"))
    loss = F.when(F.col("n") > 1, F.coalesce(-F.col("_mean"), F.lit(0.0)))
    return per_batch.select("batch", "n", "n_anchors", loss.alias("loss"))


def epoch_mean(losses: DataFrame) -> DataFrame:
    return losses.agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))
