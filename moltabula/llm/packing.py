"""Packing of documents into fixed windows by non-negative least squares on the length histogram.

A document's tokens are cut into full windows and a tail. Full windows are sequences of their own. Tails are packed:

1. An eighth of them, chosen by hash, is set aside as filler; the rest is counted by length class.
2. Combinations of one to three classes that fill a window are enumerated; non-negative least squares finds how often to
   repeat each so that they use up the histogram; counts are rounded within what is left.
3. What remains is packed greedily, from the largest class that still fits.
4. Filler tails, laid end to end, fill the gaps of all sequences, and then windows of their own.

Steps 2 and 3 work on at most ``window / CLASS`` counts, whatever the number of documents. Placing is done by Spark:
ranks within a class meet the intervals of ranks that each combination takes; filler meets gaps by prefix
sums, joined in blocks of positions.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltabula.llm import bpe
from moltabula.llm.common import arrow_map, id_and_text, slices
from moltabula.operators.rank import bucket_offsets
from moltabula.scratch import written

WINDOW = 2048
CLASS = 16  # tails are counted by length in steps of so many tokens
FILLER = 8  # one tail in so many is filler
BLOCK = 1 << 16  # positions in a block of the overlay join
BUCKET_ROWS = 20_000  # rows that one task numbers


# -- lengths: small arrays on the driver ---------------------------------------------------------


def combinations(slots: int) -> list[tuple[int, ...]]:
    """Classes (as multiples of the step, descending) whose sum fills ``slots`` exactly, one to three at a time."""
    out = [(slots,)] + [(slots - a, a) for a in range(1, slots // 2 + 1)]
    out += [(slots - a - b, a, b) for b in range(1, slots // 3 + 1) for a in range(b, (slots - b) // 2 + 1)]
    return out


def nonnegative_least_squares(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x >= 0`` with least ``|a x - y|`` by an active set: columns join while they lower the error."""
    n = a.shape[1]
    x, chosen = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ y
    for _ in range(3 * n):
        slope[chosen] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(y).max(initial=0))):
            break
        chosen[best] = True
        while True:
            idx = np.flatnonzero(chosen)
            full = np.linalg.lstsq(a[:, idx], y, rcond=None)[0]
            if (full > 0).all():
                x[:] = 0
                x[idx] = full
                break
            falling = full <= 0
            ratio = x[idx][falling] / np.maximum(x[idx][falling] - full[falling], 1e-300)
            x[idx] += ratio.min() * (full - x[idx])
            dropped = idx[falling & (x[idx] <= 1e-12)]
            if not len(dropped):
                dropped = idx[falling][np.argmin(ratio)][None]
            chosen[dropped] = False
            x[dropped] = 0
            if not chosen.any():
                break
        slope = a.T @ (y - a @ x)
    return x


def plan(histogram: dict[int, int], slots: int) -> list[tuple[Counter, int]]:
    """Combinations with repeat counts that use every tail of the histogram exactly once."""
    left = np.zeros(slots + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    out: list[tuple[Counter, int]] = []

    def take(parts: Counter, wanted: int | None = None) -> None:
        n = min(int(left[s]) // m for s, m in parts.items())
        n = n if wanted is None else min(n, wanted)
        if n > 0:
            for s, m in parts.items():
                left[s] -= n * m
            out.append((parts, n))

    if left.sum():
        shapes = [Counter(c) for c in combinations(slots) if all(left[s] for s in c)]
        if shapes:
            a = np.zeros((slots + 1, len(shapes)))
            for j, shape in enumerate(shapes):
                for s, m in shape.items():
                    a[s, j] = m
            repeats = nonnegative_least_squares(a, left.astype(float))
            for j in np.argsort(-repeats, kind="stable"):
                if repeats[j] >= 0.5:
                    take(shapes[j], int(round(repeats[j])))
    while left.any():  # each turn uses up a class or leaves less of it than one sequence takes
        parts, room, rest = Counter(), slots, left.copy()
        while room and rest[1:room + 1].any():
            size = int(np.flatnonzero(rest[:room + 1])[-1])
            n = min(room // size, int(rest[size]))
            parts[size] += n
            rest[size] -= n
            room -= n * size
        take(parts)
    return out


# -- prefix sums -----------------------------------------------------------------------------------


def with_prefix(df: DataFrame, value: str, order: list[str], groups: list[str], out: str, n_rows: int) -> DataFrame:
    """The sum of ``value`` over earlier rows of the group; any fixed order by hash and ``order``. No task numbers all rows."""
    n = max(1, n_rows // BUCKET_ROWS)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    keys = [*groups, "_bucket"]
    sizes = df.groupBy(*keys).agg(F.sum(value).alias("_size"))
    offsets = bucket_offsets(sizes, groups, "_bucket", {"n": "_size"}).drop("_all_n")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, keys).withColumn(out, F.col("_inside") + F.col("_before_n")).drop("_inside", "_before_n", "_bucket"))


# -- the operator ------------------------------------------------------------------------------------


def tails(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, doc_tokens, full_crcs, tail, tail_crc, filler, ids``: windows and tail of each document; ``ids`` for filler only."""

    def run(batch: pa.RecordBatch, encoder: bpe.Bpe) -> pa.RecordBatch:
        width = 4 * window
        end = np.array([end_id], "<u4").tobytes()
        rows = []
        for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist())):
            raw += end
            cut = len(raw) // width * width
            filler = cut < len(raw) and zlib.crc32(f"{doc}|{len(raw)}".encode()) % FILLER == 0
            rows.append((len(raw) // 4, [zlib.crc32(raw[i:i + width]) for i in range(0, cut, width)], (len(raw) - cut) // 4,
                         zlib.crc32(raw[cut:]), filler, raw[cut:] if filler else None))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "doc_tokens", "full_crcs", "tail", "tail_crc", "filler", "ids"])

    def parts(batch: pa.RecordBatch, encoder: bpe.Bpe) -> pa.Table:
        return pa.Table.from_batches([run(part, encoder) for part in slices(batch, 1)])

    schema = "doc_id long, doc_tokens long, full_crcs array<long>, tail long, tail_crc long, filler boolean, ids binary"
    return arrow_map(id_and_text(docs, id_col, text_col), parts, schema, lambda: bpe.load(tokenizer))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row for each piece of a document.

    Null text counts as empty: such a document is its end id alone. Null and repeated ids are packed row by row. Other
    columns are left out; an empty table gives no pieces. Within a sequence pieces follow each other without gaps, from offset 0.
    """
    spark = docs.sparkSession
    rows = written(tails(docs, tokenizer, end_id, window, id_col, text_col), "tails")
    order = ["doc_id", "doc_tokens", "tail_crc"]
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    whole = rows.where("tail > 0 and not filler").withColumn("size", F.ceil(F.col("tail") / CLASS).cast("int"))
    histogram = {r["size"]: r["n"] for r in whole.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, n_packed = [], 0
    taken: Counter = Counter()
    for parts, n in plan(histogram, window // CLASS):
        slot = 0
        for size, times in sorted(parts.items(), reverse=True):
            for _ in range(times):
                slots.append((size, taken[size], taken[size] + n, n_packed - taken[size], slot))
                taken[size] += n
                slot += 1
        n_packed += n
    # intervals of ranks for each class: as many rows as combinations have parts, not as documents
    intervals = spark.createDataFrame(slots, "size int, low long, high long, shift long, slot int")
    ranked = with_prefix(whole.withColumn("one", F.lit(1)), "one", order, ["size"], "rank", sum(histogram.values()))
    placed = ranked.join(intervals, "size").where("rank >= low and rank < high").withColumn("sequence_id", F.col("rank") + F.col("shift"))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(placed.select(
        "doc_id", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"),
        "doc_tokens", "sequence_id", F.coalesce(F.sum("tail").over(inside), F.lit(0)).alias("offset")), "placed")

    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("gap", window - F.col("used")).where("gap > 0")
    gaps = written(with_prefix(used, "gap", ["sequence_id"], [], "low", n_packed), "gaps")
    filler = rows.where("filler")
    totals = filler.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tail"), F.lit(0)).alias("f")).first()
    room = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("g")).first()["g"]
    filler = written(with_prefix(filler, "tail", order, [], "at", totals["n"]), "filler")
    n_over = -(-max(0, totals["f"] - room) // window)

    laid = filler.select("at", (F.col("at") + F.col("tail")).alias("till"))
    in_gaps = _blocks(laid, "at", "till").join(_blocks(gaps.withColumn("high", F.col("low") + F.col("gap")), "low", "high"), "block")
    in_gaps = in_gaps.withColumn("from", F.greatest("at", "low")).withColumn("to", F.least("till", "high"))
    in_gaps = in_gaps.where(f"`from` < `to` and `from` div {BLOCK} = block").select(
        "at", "from", "to", "sequence_id", (F.col("used") + F.col("from") - F.col("low")).alias("offset"))
    over = laid.where(F.col("till") > room).withColumn("first", F.greatest(F.col("at"), F.lit(room)) - room).withColumn("last", F.col("till") - room - 1)
    over = over.withColumn("w", F.explode(F.sequence(F.expr(f"first div {window}"), F.expr(f"last div {window}"))))
    over = over.select(
        "at", (F.greatest("first", F.col("w") * window) + room).alias("from"), (F.least(F.col("last") + 1, (F.col("w") + 1) * window) + room).alias("to"),
        (F.col("w") + n_packed).alias("sequence_id"), (F.greatest("first", F.col("w") * window) - F.col("w") * window).alias("offset"))
    # a document has at most one piece for each of its tail's tokens, fewer than ``window``
    cuts = in_gaps.unionByName(over).groupBy("at").agg(F.collect_list(F.struct("from", "to", "sequence_id", "offset")).alias("cuts"))
    cut = filler.join(cuts, "at").select("doc_id", "doc_tokens", "tail", "at", "ids", "cuts")

    n_full = rows.agg(F.coalesce(F.sum(F.size("full_crcs")), F.lit(0)).alias("n")).first()["n"]
    full = with_prefix(rows.where("size(full_crcs) > 0").withColumn("n_full", F.size("full_crcs")), "n_full", order, [], "before", n_full)
    full = full.select("doc_id", "doc_tokens", "before", F.posexplode("full_crcs").alias("i", "ids_crc32"))
    full = full.select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("before") + F.col("i") + n_packed + n_over).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.select(pieces).unionByName(placed.select(pieces)).unionByName(_cut_pieces(cut).select(pieces))


def _blocks(df: DataFrame, low: str, high: str) -> DataFrame:
    return df.withColumn("block", F.explode(F.sequence(F.expr(f"{low} div {BLOCK}"), F.expr(f"({high} - 1) div {BLOCK}"))))


def _cut_pieces(cut: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, tokens, tail, at, ids, cuts in zip(*[c.to_pylist() for c in batch.columns]):
            for c in cuts:
                a, b = c["from"] - at, c["to"] - at
                rows.append((doc, tokens - tail + a, b - a, zlib.crc32(ids[4 * a:4 * b]), tokens, c["sequence_id"], c["offset"]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return arrow_map(cut, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
