"""Two-dimensional layout of a neighbour graph: eigenvectors of its normalised operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltabula.constants import SEED
from moltabula.scratch import written

BLOCK = 8  # vectors followed at once; two are asked for, the others speed them up
POWERS = 3  # powers of the operator in a round
SLICE_NODES = 1 << 12  # nodes whose entries lie in one row
BLOCK_EDGES = 1 << 19  # edges multiplied in one task call, about
EDGES = 1 << 15  # edges multiplied at once
SLICES = "slice int, ids binary, d binary, m binary"


def symmetric_edges(edges: DataFrame, source: str = "ordinal", target: str = "neighbour", weight: str = "score") -> DataFrame:
    """``(a, b, w)`` in both directions: the probabilistic union ``p + q - p q`` of the two directed weights of a pair.

    Weights are taken within 0 and 1; null and zero weights, null ends and loops make no edge; of repeated edges the greatest weight counts.
    """
    ends = edges.select(F.col(source).cast("bigint").alias("a"), F.col(target).cast("bigint").alias("b"), F.col(weight).cast("double").alias("w"))
    ends = ends.filter("a <> b AND w > 0 AND NOT isnan(w)").withColumn("w", F.least("w", F.lit(1.0)))
    there = F.max(F.when(F.col("up"), F.col("w")))
    back = F.max(F.when(~F.col("up"), F.col("w")))
    pairs = ends.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") < F.col("b")).alias("up"), "w").groupBy("x", "y")
    p, q = F.coalesce(F.col("p"), F.lit(0.0)), F.coalesce(F.col("q"), F.lit(0.0))
    united = pairs.agg(there.alias("p"), back.alias("q")).select("x", "y", (p + q - p * q).alias("w"))
    return united.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "w"), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), "w"))).alias("e")).select("e.*")


def _data(column: pa.ChunkedArray | pa.Array, at: int = 0, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), kind)


def _numbered(degrees: DataFrame, nodes: int, slice_nodes: int) -> tuple[DataFrame, int]:
    """Each node with its slice and its place there, and the length of the longest slice."""
    count = max(1, -(-nodes // slice_nodes))
    dealt = degrees.withColumn("slice", F.pmod(F.xxhash64("a"), F.lit(count)).cast("int"))
    dealt = written(dealt.withColumn("idx", F.row_number().over(Window.partitionBy("slice").orderBy("a")) - 1), "numbered")
    return dealt, int(dealt.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]) + 1


def _edge_blocks(edges: DataFrame, numbered: DataFrame, parts: int, stride: int) -> DataFrame:
    """The operator, cut into blocks of edges from part ``pb`` to part ``pa`` of the nodes. Every ``parts``-th slice is of one part."""
    part = F.pmod("slice", F.lit(parts)).cast("int")
    place = (F.floor(F.col("slice") / parts) * stride + F.col("idx")).cast("int")
    to, come = (numbered.select(F.col("a").alias(end), F.col("d").alias(f"d{end}"), part.alias(f"p{end}"), place.alias(f"i{end}")) for end in ("a", "b"))
    scaled = edges.join(to, "a").join(come, "b").select("pa", "pb", "ia", "ib", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))

    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by([("ia", "ascending"), ("ib", "ascending")])
        packed = {c: pa.array([np.ascontiguousarray(block[c].to_numpy()).tobytes()], pa.binary()) for c in ("ia", "ib", "w")}
        return pa.table({"pa": block["pa"].slice(0, 1), "pb": block["pb"].slice(0, 1), **packed})

    return written(scaled.groupBy("pa", "pb").applyInArrow(pack, "pa int, pb int, ia binary, ib binary, w binary"), "operator")


def _slices(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes ``(a, slice, d)`` with some columns as one row for each slice: its nodes by number, and a matrix with a line for each of them."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("a")
        matrix = np.stack([rows[c].to_numpy() for c in columns], axis=1)
        made = {"ids": rows["a"].to_numpy(), "d": rows["d"].to_numpy(), "m": matrix}
        return pa.table({"slice": rows["slice"].slice(0, 1), **{c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in made.items()}})

    return nodes.groupBy("slice").applyInArrow(pack, SLICES)


def _multiplied(to: np.ndarray, come: np.ndarray, w: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """The product of a block, whose edges are ordered by ``to``, with the vectors ``x``; some edges at a time."""
    y = np.zeros((rows, x.shape[1]))
    for at in range(0, len(to), EDGES):
        own = to[at:at + EDGES]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        y[own[starts]] += np.add.reduceat(w[at:at + EDGES, None] * x[come[at:at + EDGES]], starts, axis=0)
    return y


def _apply(blocks: DataFrame, slices: DataFrame, parts: int, stride: int) -> DataFrame:
    """Appends the next power of the last vectors: half of a vector and half of what its neighbours hold, so that no eigenvalue is below 0.

    The last vectors of a slice go to each block that starts in its part; a block gives sums for each slice of the part where it ends.
    """

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_data(batch["m"], i).reshape(len(_data(batch["d"], i)), -1)[:, -BLOCK:] for i in range(batch.num_rows)]
            x = pa.array([np.ascontiguousarray(f).tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["slice"], x], ["slice", "x"])

    def block(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        if not edges.num_rows or not vectors.num_rows:
            return pa.table({"slice": pa.array([], pa.int32()), "y": pa.array([], pa.binary())})
        to, come, w = _data(edges["ia"], 0, np.int32), _data(edges["ib"], 0, np.int32), _data(edges["w"])
        held = vectors["slice"].to_numpy()
        x = np.zeros(((held.max() // parts + 1) * stride, BLOCK))
        for i, number in enumerate(held):
            own = _data(vectors["x"], i).reshape(-1, BLOCK)
            x[number // parts * stride:][:len(own)] = own
        end, lines = edges["pa"][0].as_py(), to[-1] // stride + 1
        y = _multiplied(to, come, w, x, lines * stride).reshape(lines, stride, BLOCK)
        return pa.table({"slice": pa.array([end + parts * i for i in range(lines)], pa.int32()), "y": pa.array([e.tobytes() for e in y], pa.binary())})

    def appended(sums: pa.Table, own: pa.Table) -> pa.Table:
        m = _data(own["m"]).reshape(len(_data(own["d"])), -1)
        y = np.zeros((len(m), BLOCK))
        for i in range(sums.num_rows):
            y += _data(sums["y"], i).reshape(-1, BLOCK)[:len(m)]
        more = np.hstack([m, (m[:, -BLOCK:] + y) / 2])
        return own.set_column(own.schema.get_field_index("m"), "m", pa.array([more.tobytes()], pa.binary()))

    told = slices.mapInArrow(last, "slice int, x binary").withColumn("pb", F.pmod("slice", F.lit(parts)).cast("int"))
    told = told.withColumn("pa", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sums = blocks.groupBy("pa", "pb").cogroup(told.groupBy("pa", "pb")).applyInArrow(block, "slice int, y binary")
    return sums.groupBy("slice").cogroup(slices.groupBy("slice")).applyInArrow(appended, SLICES)


def _products(slices: DataFrame, total: float) -> np.ndarray:
    """Inner products of the top vector and all columns: numbers as many as the square of the columns, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0.0
        for batch in batches:
            for i in range(batch.num_rows):
                d = _data(batch["d"], i)
                m = np.hstack([np.sqrt(d / total)[:, None], _data(batch["m"], i).reshape(len(d), -1)])
                made = made + m.T @ m
        if np.ndim(made):
            yield pa.RecordBatch.from_arrays([pa.array([made.ravel()], pa.list_(pa.float64()))], ["s"])

    parts = slices.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s"))
    found = np.array([r["s"] for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])
    width = int(round(np.sqrt(len(found))))
    return found.reshape(width, width)


def _ritz(products: np.ndarray, basis: np.ndarray, image: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, combinations and residuals of the best vectors in the span of the columns ``basis``, whose images are the columns ``image``.

    Column 0 is the known top vector; it is taken out of all others. The product of a column and an image is the operator's own form.
    Columns of which nothing is left, next to their vector among ``own``, are passed over.
    """
    rest = products - np.outer(products[0], products[0])
    left = np.diag(rest)[basis]
    kept = np.flatnonzero(left > 1e-12 * np.tile(np.diag(products)[own], len(basis) // BLOCK))
    lengths = np.sqrt(left[kept])
    v, t = basis[kept], image[kept]
    gram, form, square = (rest[np.ix_(x, y)] / np.outer(lengths, lengths) for x, y in ((v, v), (v, t), (t, t)))
    sizes, turns = np.linalg.eigh(gram)
    good = sizes > 1e-9 * sizes.max()
    frame = turns[:, good] / np.sqrt(sizes[good])
    values, inner = np.linalg.eigh(frame.T @ (form + form.T) / 2 @ frame)
    order = np.argsort(-values)[:BLOCK]
    values, made = values[order], frame @ inner[:, order]
    squares = np.einsum("ij,ik,kj->j", made, square, made) - values**2
    combined = np.zeros((len(basis), len(order)))
    combined[kept] = made / lengths[:, None]
    return values, combined, np.sqrt(np.maximum(squares, 0.0))


def _combined(slices: DataFrame, total: float, turn: np.ndarray) -> DataFrame:
    """New columns as sums of the top vector and the old columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                d = _data(batch["d"], i)
                m = np.hstack([np.sqrt(d / total)[:, None], _data(batch["m"], i).reshape(len(d), -1)])
                made.append(np.ascontiguousarray(m @ turn).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("slice", "ids", "d")), pa.array(made, pa.binary())], ["slice", "ids", "d", "m"])

    return slices.mapInArrow(run, SLICES)


def _turn(products: np.ndarray, basis: np.ndarray, image: np.ndarray, own: np.ndarray, combined: np.ndarray) -> np.ndarray:
    """The combinations that give the way a round went with its image, and the found vectors with theirs; the top vector is taken out of all."""
    whole = np.zeros((len(basis), BLOCK))
    whole[:, :combined.shape[1]] = combined
    way = np.where(np.isin(basis, own)[:, None], 0.0, whole)
    turn = np.zeros((len(products), 4 * BLOCK))
    for i, (columns, parts) in enumerate(((basis, way), (image, way), (basis, whole), (image, whole))):
        here = slice(i * BLOCK, (i + 1) * BLOCK)
        turn[columns, here] = parts
        turn[0, here] = -products[0, columns] @ parts
    return turn


def _first_two(slices: DataFrame, at: int) -> DataFrame:
    """``(a, d, v0, v1)``: a row for each node, with its entries of two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = _data(batch["d"], i)
                m = _data(batch["m"], i).reshape(len(d), -1)
                columns = [_data(batch["ids"], i, np.int64), d, np.ascontiguousarray(m[:, at]), np.ascontiguousarray(m[:, at + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "d", "v0", "v1"])

    return slices.mapInArrow(run, "a bigint, d double, v0 double, v1 double")


def graph_layout(edges: DataFrame, start: DataFrame | None = None, max_rounds: int = 20, tol: float = 1e-3, seed: int = SEED,
                 slice_nodes: int = SLICE_NODES, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``(a, component_1, component_2, eigenvalue_1, eigenvalue_2, residual_1, residual_2)`` for every end ``a`` of symmetric ``edges`` ``(a, b, w)``.

    The coordinates are the two eigenvectors of ``D^-1/2 W D^-1/2`` next to the known top one, which says nothing, over the root of the degree: nodes with
    strong edges lie close together. Each has the length 1 before that division, and its entry of greatest size (the lowest node on ties) is positive. A graph in
    several parts has the value 1 several times; the coordinates then tell the parts apart.

    A round raises a block of vectors to ``POWERS`` powers of the operator and combines all powers, and the way that the round before went, to the best vectors of
    their span. Their first power is the same combination of what is there, so a later round multiplies once less. The operator lies in blocks of about
    ``block_edges`` edges between two parts of the nodes, vectors in slices of about ``slice_nodes`` nodes. The driver sees inner products only. ``start`` has
    ``(a, x, y)``, such as principal components, for any of the nodes; the others, and the rest of the block, start from seeded numbers. Rounds end when both
    residuals ``|S v - value v|`` are at most ``tol``. Without edges there are no rows.
    A graph of two nodes has one coordinate: the other is 0, and its value and residual are null.
    """
    degrees = edges.groupBy("a").agg(F.sum("w").alias("d"), F.count(F.lit(1)).alias("m"))
    degrees = written(degrees, "degrees")
    size = degrees.agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), F.sum("m").alias("m")).first()
    if not size["n"]:
        return degrees.select("a", *[F.lit(0.0).alias(f"{c}_{j}") for c in ("component", "eigenvalue", "residual") for j in (1, 2)])
    total = size["d"]
    numbered, stride = _numbered(degrees.drop("m"), size["n"], slice_nodes)
    parts = min(-(-size["n"] // slice_nodes), int(np.ceil(np.sqrt(size["m"] / block_edges))))
    blocks = _edge_blocks(edges, numbered, parts, stride)
    names = [f"v{j}" for j in range(BLOCK)]
    numbers = [(F.pmod(F.xxhash64("a", F.lit(seed + j)), F.lit(1 << 20)) / float(1 << 19) - 1.0) for j in range(BLOCK)]
    vectors = numbered.select("a", "slice", "d", *[c.alias(v) for c, v in zip(numbers, names)])
    if start is not None:
        given = start.groupBy(F.col("a").cast("bigint").alias("a")).agg(*[F.avg(F.col(c).cast("double")).alias(f"_{c}") for c in ("x", "y")])
        vectors = vectors.join(given, "a", "left")
        for name, own in zip(names, ("_x", "_y")):
            usable = F.col(own).isNotNull() & ~F.isnan(own) & (F.abs(own) < 1e100)
            vectors = vectors.withColumn(name, F.when(usable, F.col(own)).otherwise(F.col(name) * 1e-3))
        vectors = vectors.drop("_x", "_y")
    slices = written(_slices(vectors, names), "block")
    for turn in range(max_rounds):
        # vectors, powers; later the way and its image, vectors, their first power, further powers
        for _ in range(POWERS if turn == 0 else POWERS - 1):
            slices = written(_apply(blocks, slices, parts, stride), "powers")
        products = _products(slices, total)
        column = 1 + np.arange(len(products) - 1).reshape(-1, BLOCK)
        powers = column if turn == 0 else column[2:]
        basis, image = (np.concatenate(c) for c in ((powers[:-1], powers[1:]) if turn == 0 else ([column[0], *powers[:-1]], [column[1], *powers[1:]])))
        halves, combined, off = _ritz(products, basis, image, powers[0])
        slices = _combined(slices, total, _turn(products, basis, image, powers[0], combined))
        values, residuals = 2 * halves - 1, 2 * off
        if residuals[:2].max() <= tol:
            break
    placed = written(_first_two(slices, 2 * BLOCK), "placed")
    wanted = min(len(values), 2, size["n"] - 1)
    signs = placed.agg(*[F.max(F.struct(F.abs(F.col(v)).alias("m"), (-F.col("a")).alias("o"), F.signum(v).alias("s")))["s"].alias(v) for v in names[:2]]).first()
    out = []
    for j in range(2):
        there = j < wanted
        place = F.col(names[j]) / F.sqrt("d") * F.lit(float(signs[j])) if there else F.lit(0.0)
        told = {"eigenvalue": values, "residual": residuals}
        out += [place.alias(f"component_{j + 1}")]
        out += [F.lit(float(told[c][j]) if there else None).cast("double").alias(f"{c}_{j + 1}") for c in told]
    return placed.select("a", *out)
