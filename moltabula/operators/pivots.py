"""Exact nearest sets without the full grid: distances to a few pivots bound all others.

One minus the Tanimoto similarity is a metric. Targets are grouped by their nearest pivot and their size, and for each group the least and
greatest distance to every pivot is known. For a query, the triangle inequality and the ratio of sizes bound its distance to each group from below. It first meets
the group of the least bound, and afterwards only groups whose bound does not exceed the distance that it found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.constants import N_BITS
from moltabula.operators.cells import match_keyed
from moltabula.operators.similarity import CELL_ROWS, FOUND, _best, _packed, _scores, _words_of, tanimoto_matcher, with_words
from moltabula.scratch import written

PIVOTS = 16
SIZE_STEP = 4  # size classes for each doubling
EDGE = 1e-9  # rounding of a bound


def _pivots(targets: DataFrame, n: int, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of ``n`` targets that have any, the first by hash."""
    rows = targets.filter(F.size("on_bits") > 0).orderBy(F.xxhash64("id"), "id").limit(n).select(F.col("on_bits").cast("array<int>").alias("b")).collect()
    return _packed(pa.chunked_array([pa.array([r["b"] for r in rows], pa.list_(pa.int32()))]), n_bits)


def _measured(sets: DataFrame, pivots: tuple[np.ndarray, np.ndarray], n_bits: int, extra: str = "") -> DataFrame:
    """The sets with their size, their distances to the pivots and their group."""
    words, counts = pivots
    names = sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = _words_of(pa.table(batch), n_bits)
            away = 1 - np.stack([_scores(own, n, words[:, [j]], counts[[j]]) for j in range(len(counts))], axis=1)
            step = np.floor(np.log2(np.maximum(n, 0.5)) * SIZE_STEP).astype(np.int64) + SIZE_STEP
            group = away.argmin(axis=1) * 1000 + step
            offsets = pa.array(np.arange(0, away.size + 1, len(counts), dtype=np.int32))
            columns = [pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(away.ravel())), pa.array(group)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "n_on", "away", "group"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema.fields)
    return sets.mapInArrow(run, f"{schema}, n_on bigint, away array<double>, group bigint")


class _Groups:
    """Bounds of all groups: a table of at most pivots x size classes rows."""

    def __init__(self, targets: DataFrame, n_pivots: int):
        ends = [f(F.get("away", F.lit(j))).alias(f"{name}{j}") for j in range(n_pivots) for name, f in (("lo", F.min), ("hi", F.max))]
        rows = targets.groupBy("group").agg(F.min("n_on").alias("least"), F.max("n_on").alias("most"), *ends).orderBy("group").collect()
        self.group = np.array([r["group"] for r in rows], np.int64)
        self.least, self.most = (np.array([r[c] for r in rows], float) for c in ("least", "most"))
        self.low, self.high = (np.array([[r[f"{c}{j}"] for j in range(n_pivots)] for r in rows]) for c in ("lo", "hi"))

    def bounds(self, away: np.ndarray, n_on: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of each query (rows) to each group (columns)."""
        out = np.zeros((len(away), len(self.group)))
        for j in range(away.shape[1]):
            d = away[:, [j]]
            np.maximum(out, np.maximum(d - self.high[None, :, j], self.low[None, :, j] - d), out=out)
        n = n_on[:, None].astype(float)
        small, large = np.minimum(n, self.most[None]), np.maximum(n, self.least[None])
        return np.maximum(out, 1 - small / np.maximum(large, 1))


def _dealt(queries: DataFrame, groups: _Groups, others: bool, counted: bool = False) -> DataFrame:
    """Each query with the groups it has to meet: the nearest by its bound, or the ``others`` that may hold a better set than ``best`` tells.

    With ``counted`` only how many they are, as numbers ``n`` to be added up.
    """
    queries = queries.drop("words")
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                away = np.stack(batch.column(names.index("away")).to_numpy(zero_copy_only=False))
                bound = groups.bounds(away, batch.column(names.index("n_on")).to_numpy())
                home = bound.argmin(axis=1)
                if others:
                    best = batch.column(names.index("best")).to_numpy()
                    meets = bound <= 1 - best[:, None] + EDGE
                    meets[np.arange(len(home)), home] = False
                    row, column = np.nonzero(meets)
                else:
                    row, column = np.arange(len(home)), home
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([len(row)], pa.int64())], ["n"])
                    continue
                taken = batch.select(["id"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(groups.group[column])], ["id", "key"])

    return queries.mapInArrow(run, "n bigint" if counted else "id bigint, key bigint")


def nearest_by_pivots(queries: DataFrame, targets: DataFrame, n_bits: int = N_BITS, n_pivots: int = PIVOTS, cell_rows: int = CELL_ROWS,
                      seen: dict | None = None, fewer: bool = False) -> DataFrame | tuple[DataFrame | None, DataFrame | None]:
    """``(id, score, nn)`` of every query set, the same as a comparison with all targets gives.

    With ``fewer`` it gives the result, or None where the groups left over move more rows than the full grid of cells, and besides what the first groups held, if it got there. ``seen``, if given, takes the number of groups and of meetings of a query with a group, first and later ones.
    """
    queries, targets = (with_words(side, n_bits) for side in (queries, targets))
    pivots = _pivots(targets, n_pivots, n_bits)
    if not len(pivots[1]):  # all targets are empty: score 0 with the lowest
        lowest = targets.agg(F.min(F.col("ordinals")[0]).alias("nn"))
        found = queries.select("id", F.lit(0.0).alias("score")).join(F.broadcast(lowest), F.col("nn").isNotNull())
        return (found, None) if fewer else found
    near = written(_measured(targets.drop("on_bits"), pivots, n_bits), "measured")
    groups = _Groups(near, len(pivots[1]))
    keyed = near.select("id", "words", "ordinals", F.col("group").alias("key"))
    asked = written(_measured(queries.select("id", "words"), pivots, n_bits).drop("group"), "asked")
    match = tanimoto_matcher(1, n_bits)
    own = asked.select("id", "words")
    # the meetings are pairs of numbers; the sets join them on the way into their cells
    home = written(_dealt(asked, groups, False), "home")
    first = written(_best(match_keyed(home.join(own, "id"), keyed, match, FOUND, limit=cell_rows)), "first")
    open_ = asked.join(first.select("id", F.col("score").alias("best")), "id")
    if fewer:
        n_q, n_t = asked.count(), near.count()
        later = _dealt(open_, groups, True, counted=True).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if later > n_q * -(-n_t // cell_rows) + n_t * (-(-n_q // cell_rows) - 1):
            return None, first
    rest = written(_dealt(open_, groups, True), "rest")
    if seen is not None:
        seen.update(groups=len(groups.group), first=home.count(), later=rest.count())
    later = match_keyed(rest.join(own, "id"), keyed, match, FOUND, limit=cell_rows)
    found = first.select("id", "score", F.array("nn").alias("ordinals")).unionByName(later)
    return (_best(found), first) if fewer else _best(found)
