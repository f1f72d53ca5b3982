"""Exact top-k by inner product.

Vectors are sorted by length, longest first, and dealt in blocks. Both sides are rotated by the singular vectors of the
collection, so that the first coordinates carry most of a product. For a block of queries, candidate blocks pass in order of
length: the product of the first coordinates plus the product of the lengths of the rest (Cauchy-Schwarz) bounds the score, and
only pairs whose bound reaches the query's k-th best score so far are scored in full. A block whose longest vector cannot
reach it is skipped whole.

The vectors are numbers without fractions, so a score is an exact sum in double precision (below 2^53).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltabula.llm.common import arrow_map
from moltabula.scratch import written

QUERY_ROWS = 4096  # queries in a block
CANDIDATE_ROWS = 8192  # candidates in a block
RUN_BLOCKS = 16  # candidate blocks that one task passes for one block of queries
HEAD_SHARE = 0.25  # coordinates in the partial sum
TILE = 512  # queries whose scores with a block are held at once
SCALE = 256.0


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, norm2, vec``: each component as floor(256 x); rows that are null or hold null or non-finite components are left out.

    Rows without id, and vectors without components, take no part either. Vectors may differ in length.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where("vec_id is not null and size(vec) > 0").where(finite)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.floor(SCALE * batch.column(1).flatten().to_numpy(zero_copy_only=False))
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        vecs = np.split(flat, ends[:-1])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([float(v @ v) for v in vecs], pa.float64()), pa.array([v.tobytes() for v in vecs], pa.binary())], ["vec_id", "norm2", "vec"])

    return arrow_map(rows, run, "vec_id long, norm2 double, vec binary")


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of the collection, strongest first, from the sums of products of coordinates."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            i = np.repeat(np.arange(d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())], ["i", "j", "s"])

    # dimensions squared rows, whatever the number of vectors
    cells = vectors.select("vec").mapInArrow(gram, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    d = int(round(len(cells) ** 0.5))
    matrix = np.zeros((d, d))
    matrix[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["s"].to_numpy()
    values, basis = np.linalg.eigh(matrix)
    return basis[:, np.argsort(-values)]


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """``top, ids, vecs``: runs of sorted rows of each partition as arrays in binary form."""
    schema = "top double, ids binary, vecs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, norms, vecs = (t.column(c).combine_chunks() for c in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array([max(norms.to_pylist()) ** 0.5]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vecs.to_pylist())], pa.binary())],
                ["top", "ids", "vecs"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == rows:
                    yield out()
                    held.clear()
                    n = 0
        if n:
            yield out()

    return vectors.select("vec_id", "norm2", "vec").sortWithinPartitions(F.desc("norm2"), "vec_id").mapInArrow(run, schema)


class _Best:
    """The k best of each query of a block so far, and the score that a new candidate must reach."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, basis: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.head = max(1, int(basis.shape[1] * HEAD_SHARE))
        self.basis = basis
        self.rotated = vecs @ basis
        self.rest = np.sqrt((self.rotated[:, self.head:] ** 2).sum(axis=1))
        self.norm = np.sqrt((vecs ** 2).sum(axis=1))
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def meet(self, ids: np.ndarray, vecs: np.ndarray, top: float) -> None:
        slack = 1e-6
        busy = np.flatnonzero(self.norm * top * (1 + slack) + slack >= self.least)
        if not len(busy):
            return
        rotated = vecs @ self.basis
        rest = np.sqrt((rotated[:, self.head:] ** 2).sum(axis=1))
        for i in range(0, len(busy), TILE):
            rows = busy[i:i + TILE]
            bound = self.rotated[rows, :self.head] @ rotated[:, :self.head].T
            bound += np.outer(self.rest[rows], rest)
            bound += slack * np.outer(self.norm[rows], np.full(len(ids), top)) + slack
            q, c = np.nonzero(bound >= self.least[rows][:, None])
            del bound
            if len(q) * 8 > len(rows) * len(ids):  # most pairs stay: one matrix product is cheaper than gathering
                score = (self.vecs[rows] @ vecs.T)[q, c]
            else:
                score = np.concatenate([(self.vecs[rows[q[j:j + 65536]]] * vecs[c[j:j + 65536]]).sum(axis=1) for j in range(0, len(q), 65536)] or [np.zeros(0)])
            q = rows[q]
            good = (score >= self.least[q]) & (ids[c] != self.ids[q])
            self._merge(q[good], score[good], ids[c[good]])

    def _merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate([a, b]) for a, b in zip(self.found, (q, score, ids)))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        keep = place < self.k
        self.found = (q[keep], score[keep], ids[keep])
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[last])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` highest inner products with other rows.

    Both tables as ``whole_vectors`` gives them. Ties go to the smaller id; a query with fewer candidates has fewer rows. A row is
    never its own answer, nor is another row with the same id; repeated candidate rows count one by one, repeated query
    ids are asked once, with the least vector. Vectors of different lengths have no product, so each length is searched apart (a repeated query id once in each).
    Empty tables give no rows.
    """
    vectors = written(vectors, "vectors")
    lengths = [r[0] for r in vectors.select(F.octet_length("vec").alias("n")).distinct().orderBy("n").collect()]
    if len(lengths) > 1:
        return reduce(DataFrame.unionByName, [_top_k(vectors.where(F.octet_length("vec") == n), queries.where(F.octet_length("vec") == n), k) for n in lengths])
    return _top_k(vectors, queries, k)


def _top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The search among vectors of one length."""
    schema = "query_id long, vec_id long, score double"
    basis = rotation(vectors)
    if not basis.size:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = written(_blocks(vectors.repartitionByRange(F.desc("norm2")), CANDIDATE_ROWS), "candidates")
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("vec", "norm2")).alias("v")).select("vec_id", "v.norm2", "v.vec")
    n_asked = asked.count()
    n_groups = max(1, -(-n_asked // QUERY_ROWS))
    groups = written(
        _blocks(asked.repartition(n_groups, F.xxhash64("vec_id")), QUERY_ROWS)
        .withColumn("group", F.monotonically_increasing_id()).select("group", "ids", "vecs"), "queries")

    # scores of the longest block first, so that every task starts with a bound
    first = blocks.orderBy(F.desc("top"), "ids").limit(1).select("top", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, ids, vecs, top, c_ids, c_vecs in zip(*[c.to_pylist() for c in batch.columns]):
                best = _Best(np.frombuffer(ids, np.int64), np.frombuffer(vecs).reshape(len(ids) // 8, -1), basis, k)
                best.meet(np.frombuffer(c_ids, np.int64), np.frombuffer(c_vecs).reshape(len(c_ids) // 8, -1), top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group]), pa.array([ids], pa.binary()), pa.array([vecs], pa.binary()), pa.array([best.least.tobytes()], pa.binary())], ["group", "ids", "vecs", "least"])

    # every block of queries meets this one row, which holds at most CANDIDATE_ROWS vectors
    seeded = groups.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one").select("group", "ids", "vecs", "top", "c_ids", "c_vecs")
    seeded = written(seeded.mapInArrow(seed, "group long, ids binary, vecs binary, least binary"), "seeded")

    # a block of candidates goes to each block of queries, in runs of blocks by length
    position = Window.orderBy(F.desc("top"), "ids")
    numbered = blocks.select("top", "ids").withColumn("run", F.floor((F.row_number().over(position) - 1) / RUN_BLOCKS))
    runs = numbered.agg(F.max("run")).first()[0] + 1
    numbers = [r["group"] for r in groups.select("group").collect()]
    dealt = (
        blocks.join(numbered.select("ids", "run"), "ids").withColumn("group", F.explode(F.array(*[F.lit(g) for g in numbers])))
        .select("group", "run", F.col("top").alias("bound"), "ids", "vecs", F.lit(None).cast("binary").alias("least")))
    heads = seeded.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))).select(
        "group", "run", F.lit(float("inf")).alias("bound"), "ids", "vecs", "least")
    together = heads.unionByName(dealt).repartition(max(1, runs * len(numbers)), "group", "run").sortWithinPartitions("group", "run", F.desc("bound"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None

        def out() -> pa.RecordBatch:
            q, score, ids = best.found
            return pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for _, _, bound, ids, vecs, least in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(ids, np.int64)
                vecs = np.frombuffer(vecs).reshape(len(ids), -1)
                if least is not None:
                    if best is not None:
                        yield out()
                    best = _Best(ids, vecs, basis, k, np.frombuffer(least))
                else:
                    best.meet(ids, vecs, bound)
        if best is not None:
            yield out()

    found = together.mapInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
