"""Centroid clustering with n-simplex projection.

A few pivots stay the same through all rounds, and the squared distances of each vector to them are computed once. With the
distances among the pivots they give the apex of a simplex over the pivots: coordinates in as many dimensions as there are pivots, the last of them the height above the
pivots' plane. The distance of two apexes is a lower bound of the distance of the vectors, and with one height turned over an upper bound. A centroid whose
lower bound is above the least upper bound cannot be the nearest; the others are compared in exact integers.

Vectors are spread over tasks and never move: a round sends the centroids, a table of ``n_clusters`` rows, and gets back sums by cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.scratch import written

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
PIVOTS = 8
LIMIT = 1 << 26  # squared distances of greater components might not fit a long
SLACK = 1e-9  # rounding of a squared bound against the squared distances it comes from
FLAT = 1e-2  # a pivot nearer to the plane of the others than this share of its distance would make the coordinates inexact
PART_ROWS = 4096


class Simplex:
    """Apex coordinates over pivots; pivots that lie in the plane of the earlier ones are left out."""

    def __init__(self, candidates: np.ndarray, n_pivots: int = PIVOTS):
        chosen, rows = [0], []
        squares = ((candidates[:, None, :] - candidates[None]) ** 2).sum(axis=2).astype(float)
        for i in range(1, len(candidates)):
            if len(chosen) == n_pivots:
                break
            y = self._solve(np.array(rows), squares[chosen, 0], squares[[i], :][:, chosen])[0]
            height = squares[i, 0] - (y * y).sum()
            if height > FLAT * max(squares[i, 0], 1e-300):
                rows = [np.append(r, 0.0) for r in rows] + [np.append(y, np.sqrt(height))]
                chosen.append(i)
        self.pivots = candidates[chosen]
        self.rows = np.array(rows).reshape(len(rows), len(rows))
        self.norms = squares[chosen, 0]

    @staticmethod
    def _solve(rows: np.ndarray, norms: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' plane from squared distances (vectors x pivots), by forward substitution."""
        out = np.zeros((len(squares), len(norms) - 1))
        for j in range(len(norms) - 1):
            product = (squares[:, 0] + norms[j + 1] - squares[:, j + 1]) / 2
            out[:, j] = (product - out[:, :j] @ rows[j, :j]) / rows[j, j]
        return out

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Exact squared distances to the pivots."""
        return np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Coordinates in the pivots' plane and, last, the height above it."""
        squares = squares.astype(float)
        flat = self._solve(self.rows, self.norms, squares)
        height = np.sqrt(np.maximum(squares[:, 0] - (flat * flat).sum(axis=1), 0))
        return np.column_stack([flat, height])


def nearest(vectors: np.ndarray, squares: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), exact squared distance, and how many exact distances it took."""
    own, other = simplex.apexes(squares), simplex.apexes(simplex.distances(centroids))
    low, high = (np.zeros((len(own), len(other))) for _ in range(2))
    for j in range(own.shape[1] - 1):
        low += (own[:, None, j] - other[None, :, j]) ** 2
    high += low + (own[:, None, -1] + other[None, :, -1]) ** 2
    low += (own[:, None, -1] - other[None, :, -1]) ** 2
    slack = SLACK * (1 / FLAT) ** 2 * (squares.max(axis=1, initial=0).astype(float)[:, None] + simplex.distances(centroids).max(axis=1)[None].astype(float) + 1)
    row, column = np.nonzero(low - slack <= (high + slack).min(axis=1)[:, None])
    exact = ((vectors[row] - centroids[column]) ** 2).sum(axis=1)
    order = np.lexsort((column, exact, row))
    first = order[np.concatenate([[True], np.diff(row[order]) > 0])] if len(order) else order
    return column[first].astype(np.int32), exact[first], len(exact)


def whole_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: floor(scale * component) of the vectors with exactly ``dims`` components, none null or non-finite."""
    c = F.col(vector_col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = table.where(c.isNotNull() & (F.size(c) == dims) & finite)
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(x.cast("double") * scale)).cast("array<long>").alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _measured(vectors: DataFrame, simplex: Simplex, dims: int) -> DataFrame:
    """The vectors with their squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                x = _matrix(batch.column(1), dims)
                if np.abs(x).max(initial=0) > LIMIT:
                    raise ArithmeticError(f"a component is beyond {LIMIT}: squared distances would not fit a long")
                d = simplex.distances(x)
                offsets = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], ["vec_id", "x", "squares"])

    return vectors.mapInArrow(run, "vec_id long, x array<long>, squares array<long>")


def _assigned(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    dims, n_pivots = centroids.shape[1], len(simplex.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                cluster, distance, _ = nearest(_matrix(batch.column(1), dims), _matrix(batch.column(2), n_pivots), centroids, simplex)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _moved(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays. Tasks send sums, at most one row for each cluster and component."""
    k, dims = centroids.shape
    n_pivots = len(simplex.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        seen = 0
        for whole in batches:
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                x = _matrix(batch.column(1), dims)
                cluster, _, _ = nearest(x, _matrix(batch.column(2), n_pivots), centroids, simplex)
                for j in range(k):
                    total[j] += x[cluster == j].sum(axis=0)
                count += np.bincount(cluster, minlength=k)
                seen += len(x)
                if seen > 1 << 34:  # sums of more might not fit 64 bits
                    yield _sums(count, total)
                    count[:], total[:], seen = 0, 0, 0
        yield _sums(count, total)

    sums = vectors.mapInArrow(run, "cluster int, dim int, n long, total long").where("n > 0")
    sums = sums.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # n_clusters x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // int(r["n"])
    return out


def _sums(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    k, dims = total.shape
    columns = [np.repeat(np.arange(k, dtype=np.int32), dims), np.tile(np.arange(dims, dtype=np.int32), k), np.repeat(count, dims), total.ravel().copy()]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "dim", "n", "total"])


def cluster(table: DataFrame, n_clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, n_pivots: int = PIVOTS,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row for each vector that takes part.

    Vectors that are null, of another length, or hold null or non-finite components are left out. The first centroids are the vectors with the least hash of seed and id,
    equal hashes (repeated ids) by their components; a null id has no hash and comes last, but takes part. With fewer vectors than clusters there are as many clusters as
    vectors; equal centroids leave all but the first without vectors. An empty table gives no rows. Components beyond ``LIMIT`` after scaling are an error, since
    their squared distances do not fit a long. Other columns do not matter.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, dims, scale, id_col, vector_col)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(place.asc_nulls_last(), "x").limit(n_clusters).collect()
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], names)
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dims)
    if np.abs(centroids).max(initial=0) > LIMIT:
        raise ArithmeticError(f"a component is beyond {LIMIT}: squared distances would not fit a long")
    simplex = Simplex(centroids, n_pivots)
    measured = written(_measured(vectors, simplex, dims), "vectors")
    centroids = reduce(lambda c, _: _moved(measured, c, simplex), range(rounds), centroids)
    found = written(_assigned(measured, centroids, simplex), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # n_clusters rows
    inertia = sum(int(r["s"]) for r in sums)
    rows = [(r["cluster"], int(r["s"]), inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select(*[c.split()[0] for c in names.split(", ")])
