"""Links between components inside groups, in cells of bounded size.

Rows of a group that belong to different components have to be compared, whatever the size of the group. They are dealt to cells: components of more
than a cell's mass get chunks of their own, the others share chunks, and each pair of chunks is a cell, save two chunks of one component. A cell
returns only links that join two of its components for the first time, so at most one link less than it has components, and never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ODD = np.uint64(int("01" * 32, 2))


def deal(rows: DataFrame, group: str, limit: float) -> DataFrame:
    """``group, cell_a, cell_b, side, doc_id, component``: the cells of each row of ``group, doc_id, component, mass``."""
    per = rows.groupBy(group, "component").agg(F.sum("mass").alias("m"))
    per = per.withColumn("own", F.when(F.col("m") > limit, F.col("component")))
    lots = per.groupBy(group, "own").agg(F.greatest(F.lit(1), F.ceil(F.sum("m") / limit)).cast("int").alias("n"))
    number = F.when(F.col("own").isNull(), F.col("r").cast("long")).otherwise(F.xxhash64("own", "r").bitwiseOR(F.lit(-(1 << 63))))
    chunks = lots.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(group, "own", number.alias("chunk"))
    a = chunks.select(group, F.col("own").alias("own_a"), F.col("chunk").alias("cell_a"))
    b = chunks.select(group, F.col("own").alias("own_b"), F.col("chunk").alias("cell_b"))
    cells = a.join(b, group).where("cell_a <= cell_b and (own_a is null or own_b is null or own_a <> own_b)").select(group, "cell_a", "cell_b")
    lots = lots.select(F.col(group).alias("_g"), F.col("own").alias("_own"), "n")
    placed = rows.join(per.select(group, "component", "own"), [group, "component"])
    placed = placed.join(lots, (F.col(group) == F.col("_g")) & F.col("own").eqNullSafe(F.col("_own")))
    placed = placed.withColumn("r", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")).select(group, "doc_id", "component", number.alias("chunk"))
    left = placed.join(cells, [F.expr("chunk = cell_a"), placed[group] == cells[group]]).select(placed[group], "cell_a", "cell_b", F.lit(0).alias("side"), "doc_id", "component")
    right = placed.join(cells.where("cell_a < cell_b"), [F.expr("chunk = cell_b"), placed[group] == cells[group]])
    return left.unionByName(right.select(placed[group], "cell_a", "cell_b", F.lit(1).alias("side"), "doc_id", "component"))


def forest(components: np.ndarray, sides: np.ndarray, partners: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows that join components; ``partners`` picks from some rows those linked with a row. Rows of different sides meet, or all if there is one side."""
    label = np.unique(components, return_inverse=True)[1]
    two = sides.any() and not sides.all()
    found = []
    for i in range(len(label)):
        if two and sides[i]:
            continue
        other = np.flatnonzero((label != label[i]) & (sides == 1) if two else label != label[i])
        if len(other) == 0:
            continue
        linked = partners(i, other)
        new, first = np.unique(label[linked], return_index=True)
        found += [(i, j) for j in linked[first].tolist()]
        if len(new):
            label[np.isin(label, new)] = label[i]
    return found


def alike(signs: np.ndarray, most: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Partners whose packed signatures differ in at most ``most`` of the two-bit minima."""

    def partners(i: int, other: np.ndarray) -> np.ndarray:
        z = signs[other] ^ signs[i]
        return other[np.bitwise_count((z | (z >> np.uint64(1))) & ODD).sum(axis=1, dtype=np.int64) <= most]

    return partners


def overlapping(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Partners whose sets reach the similarity; all sets are indexed by member once, so a row's overlaps with all others are one count."""
    sizes = np.array([len(s) for s in sets], np.int64)
    members = np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    keys, first = np.unique(members[order], return_index=True)
    ends = np.append(first[1:], len(members))

    def partners(i: int, other: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, sets[i])
        width = ends[at] - first[at]
        place = np.repeat(first[at] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        both = np.bincount(owner[place], minlength=len(sets))[other]
        return other[(both > 0) & (100 * both >= percent * (sizes[i] + sizes[other] - both))]

    return partners


def links(cells: DataFrame, group: str, payload: list[str], judge: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """``a, b, a_component, b_component``: a forest of links of each cell. ``judge`` gets a cell's rows and says which partners a row is linked with.

    Cells come sorted to a task, which holds one at a time.
    """
    keys = [group, "cell_a", "cell_b"]
    rows = cells.select(*keys, "side", "doc_id", "component", *payload).repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    def cell(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        doc, component, side = (table[c].to_numpy() for c in ("doc_id", "component", "side"))
        pairs = np.array(forest(component, side, judge(table)), np.int64).reshape(-1, 2)
        columns = [doc[pairs[:, 0]], doc[pairs[:, 1]], component[pairs[:, 0]], component[pairs[:, 1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "a_component", "b_component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(3)]
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            edges = [0, *changes.tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                key = tuple(c[start] for c in columns)
                if key != current and held:
                    yield cell(held)
                    held = []
                current = key
                held.append(batch.slice(start, stop - start))
        if held:
            yield cell(held)

    return rows.mapInArrow(run, "a long, b long, a_component long, b_component long")
