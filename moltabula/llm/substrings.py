"""Removal of repeated byte strings across documents with suffix order in shards.

0. Of equal texts only the first goes on; the others are removed whole if they have ``LENGTH`` bytes.
1. Every window of ``LENGTH`` bytes has an anchor: the ``GRAM`` bytes in it with the least hash. Equal windows have
   equal anchors. Windows whose anchor occurs once are unique; the others go on, in runs that share an anchor, each with its context bytes.
2. Equal contexts form a class; every copy but the first is removed whole. One context of a class goes to a shard by its anchor.
3. A shard orders the suffixes of its contexts by induced sorting (``suffixes``), with common prefixes; in a run of common prefixes of
   ``LENGTH`` and more all windows but the first repeat it.
4. An anchor with more than ``CROWDED`` classes would overload a shard. Its windows meet by digest in an aggregate instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.llm import bitmap, suffixes
from moltabula.llm.common import arrow_map, id_and_text, slices
from moltabula.scratch import written

LENGTH = 100
GRAM = 24
CROWDED = 4096  # classes of one anchor
SHARD_BYTES = 1 << 19  # least bytes of a shard; a task has many shards
PART_BYTES = 16 << 20
DIRECT_SHARE = 0.05  # of the bitmap's bits that repeated anchors may set for contexts to be taken directly
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def window_hashes(data: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``size`` bytes, put together from powers of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _P3
    h ^= h >> np.uint64(31)
    out, done, width = None, 0, 1
    while done < size:
        if size & width:
            if out is None:
                out = h
            else:
                n = len(data) - done - width + 1
                out = out[:n] * _power(factor, width) + h[done:done + n]
            done += width
        if done < size:
            h = h[:-width] * _power(factor, width) + h[width:]
            width *= 2
    out ^= out >> np.uint64(29)
    out *= _P1
    return out ^ (out >> np.uint64(32))


def _power(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(factor), n, 1 << 64))


def anchor_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each run of windows that share one anchor."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = window_hashes(data, GRAM, _P2)
    best, at = value, np.arange(len(value), dtype=np.int32)
    size, width = 1, LENGTH - GRAM + 1
    while size < width:
        step = min(size, width - size)
        less = best[step:] < best[:-step]  # among equals the leftmost
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        size += step
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], cuts])
    return best[first].view(np.int64), first, np.append(cuts, len(at)) - 1


def _bytes_of(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mark, text``; the mark, a hash of the text, tells rows with a repeated id apart."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _by_part(df: DataFrame, run, schema: str, prepare=None, chosen: Broadcast | None = None) -> DataFrame:
    """``run`` over slices of ``doc_id, mark, text, ...``; with a bitmap only rows whose last column may be in it."""

    def parts(batch: pa.RecordBatch, state: tuple) -> pa.Table:
        bits, extra = state
        out = []
        for part in slices(batch, 2):
            if bits is not None:
                part = part.filter(pa.array(bitmap.holds(bits, part.column(part.num_columns - 1).to_numpy(zero_copy_only=False))))
            if part.num_rows:
                out.append(run(part, *extra))
        return pa.Table.from_batches(out) if out else pa.table({})

    def state() -> tuple:
        return chosen.value if chosen else None, (prepare(),) if prepare else ()

    return arrow_map(df, parts, schema, state)


def _anchors(texts: DataFrame, repeated: Broadcast | None, chosen: Broadcast) -> DataFrame:
    """Hashes of all anchors, or with a bitmap the runs of those that may be repeated."""

    def run(batch: pa.RecordBatch, bits: np.ndarray | None = None) -> pa.RecordBatch:
        found = [anchor_runs(_bytes_of(t)) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        hashes, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
        if bits is None:
            return pa.RecordBatch.from_arrays([pa.array(hashes)], ["h"])
        row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        good = bitmap.holds(bits, hashes)
        ids, marks = (batch.column(i).to_numpy(zero_copy_only=False)[row[good]] for i in range(2))
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes[good]), pa.array(ids), pa.array(marks), pa.array(first[good].astype(np.int32)), pa.array(last[good].astype(np.int32))],
            ["h", "doc_id", "mark", "first", "last"])

    if repeated is None:
        return _by_part(texts, run, "h long", None, chosen)
    return _by_part(texts, run, "h long, doc_id long, mark long, first int, last int", lambda: repeated.value, chosen)


CONTEXT = "h long, c0 long, c1 long, doc_id long, mark long, first int, context binary"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows ``h, doc_id, mark, first, context`` with a digest of the context."""
    digests = [hashlib.blake2b(r[4], digest_size=16).digest() for r in rows]
    parts = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    h, doc, mark, first, context = zip(*rows) if rows else ([], [], [], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(doc, pa.int64()), pa.array(mark, pa.int64()),
         pa.array(first, pa.int32()), pa.array(context, pa.binary())], ["h", "c0", "c1", "doc_id", "mark", "first", "context"])


def _direct_contexts(texts: DataFrame, repeated: Broadcast, chosen: Broadcast) -> DataFrame:
    """Contexts of all runs whose anchor may be repeated, in one pass over the texts."""

    def run(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            hashes, first, last = anchor_runs(_bytes_of(text))
            good = bitmap.holds(bits, hashes)
            rows += [(h, doc, mark, a, text[a:b + LENGTH]) for h, a, b in zip(hashes[good].tolist(), first[good].tolist(), last[good].tolist())]
        return _context_batch(rows)

    return _by_part(texts, run, CONTEXT, lambda: repeated.value, chosen)


def _joined_contexts(texts: DataFrame, repeated: DataFrame, bits: Broadcast, chosen: Broadcast) -> DataFrame:
    """Contexts of runs whose anchor is repeated: runs go to their texts by a join."""
    runs = _anchors(texts, bits, chosen).join(repeated, "h")
    # a document has fewer runs than bytes
    by_doc = written(runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "first", "last")).alias("runs")), "runs")
    placed = bitmap.keep(texts.drop("row"), "mark", bitmap.build(by_doc, "mark")).join(by_doc, ["doc_id", "mark"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()]
        return _context_batch([
            (r["h"], doc, mark, r["first"], text[r["first"]:r["last"] + LENGTH]) for doc, mark, text, runs in zip(*columns) for r in runs])

    return _by_part(placed, run, CONTEXT)


SPAN = "doc_id long, mark long, start int, stop int"


def _shard_spans(classes: DataFrame) -> DataFrame:
    """Spans of repeated windows among contexts, sorted by anchor within partitions; all contexts of an anchor are in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size >= SHARD_BYTES:
                anchors = batch.column(0).to_numpy(zero_copy_only=False)
                other = np.flatnonzero(anchors != held[-1].column(0)[-1].as_py())
                cut = int(other[0]) if len(other) else batch.num_rows
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if not batch.num_rows:
                    continue
                yield from shard(held)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows * (LENGTH + 8)  # each context has at least LENGTH bytes
        if held:
            yield from shard(held)

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in held if b.num_rows]
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("mark", "ascending"), ("first", "ascending")])
        ids, marks, firsts = (table.column(c).to_numpy() for c in ("doc_id", "mark", "first"))
        contexts = table.column("context").to_pylist()
        # bytes of UTF-8 end at 0xF4, so all move up by one and leave 0 for the separator
        joined = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8) + np.uint8(1)
        begins = np.concatenate([[0], np.cumsum([len(c) + 1 for c in contexts])])
        at = suffixes.repeats(joined, LENGTH)
        if not len(at):
            return
        row = np.searchsorted(begins, at, side="right") - 1
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
        a, b = np.concatenate([[0], cuts]), np.append(cuts, len(at)) - 1
        r = row[a]
        start, stop = at[a] - begins[r] + firsts[r], at[b] - begins[r] + firsts[r] + LENGTH
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[r]), pa.array(marks[r]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc_id", "mark", "start", "stop"])

    return classes.select("h", "doc_id", "mark", "first", "context").mapInArrow(run, SPAN)


def _crowded_spans(classes: DataFrame) -> DataFrame:
    """The same for contexts of crowded anchors, by an aggregate over digests of windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for doc, mark, first, context in zip(*[c.to_pylist() for c in batch.columns]):
            data = _bytes_of(context)
            w = [window_hashes(data, LENGTH, p).view(np.int64) for p in (_P2, _P3)]
            n = len(w[0])
            parts.append((*w, np.full(n, doc), np.full(n, mark), first + np.arange(n, dtype=np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["w0", "w1", "doc_id", "mark", "start"])

    windows = arrow_map(classes.select("doc_id", "mark", "first", "context"), run, "w0 long, w1 long, doc_id long, mark long, start int")
    first = windows.groupBy("w0", "w1").agg(F.min(F.struct("doc_id", "mark", "start")).alias("least"))
    later = windows.join(first, ["w0", "w1"]).where(F.struct("doc_id", "mark", "start") != F.col("least"))
    return later.select("doc_id", "mark", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, start, stop``: byte spans, which may overlap, that together cover every repeated window."""
    whole = _texts(docs, id_col, text_col).where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
    rows = whole.select("doc_id", "mark", F.xxhash64(F.lit(1), "text").alias("mark2"), F.octet_length("text").alias("size"))
    rows = written(rows, "rows")
    heads = rows.groupBy("mark", "mark2", "size").agg(F.min("doc_id").alias("head"))
    same = rows.join(heads, ["mark", "mark2", "size"])
    again = same.where("doc_id > head").select("doc_id", "mark", F.lit(0).alias("start"), F.col("size").alias("stop"))
    # a copy that the bitmap lets through does no harm: it is removed whole in any case
    first = bitmap.build(heads.select(F.xxhash64("head", "mark").alias("row")), "row")
    texts = whole.select("doc_id", "mark", "text", F.xxhash64("doc_id", "mark").alias("row"))
    counted = _anchors(texts, None, first).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    repeated = written(counted, "anchors")
    bits = bitmap.build(repeated, "h")
    # While the bitmap tells well, contexts come straight from the texts. A fuller one would let too many through, and
    # a join of positions with texts moves less. Both give the same spans.
    if repeated.count() <= DIRECT_SHARE * (1 << bitmap.BITS):
        contexts = _direct_contexts(texts, bits, first)
    else:
        contexts = _joined_contexts(texts, repeated, bits, first)
    occurrences = written(contexts, "contexts")
    # a digest of the context stands for it, so that contexts themselves move once and only where they are compared
    key, place = ["c0", "c1"], ["doc_id", "mark", "first"]
    classes = occurrences.groupBy(*key).agg(F.min(F.struct(*place)).alias("least"), F.min("h").alias("h"))
    classes = written(classes, "classes")
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    needed = classes.join(several, "h").select("least.*", (F.col("n") > CROWDED).alias("crowded"))
    needed = written(needed.withColumn("at", F.xxhash64(*place)), "needed")
    likely = bitmap.keep(occurrences.select("h", *place, "context", F.xxhash64(*place).alias("at")), "at", bitmap.build(needed, "at"))
    compared = written(likely.drop("at").join(needed.drop("at"), place).dropDuplicates(place), "compared")
    total = compared.agg(F.sum(F.octet_length("context")).alias("b")).first()["b"] or 0
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(int(total // PART_BYTES), min(wide, int(total // SHARD_BYTES))) + 1
    shards = compared.where("not crowded").repartition(n_parts, "h").sortWithinPartitions("h")
    copies = occurrences.select(*key, *place, F.octet_length("context").alias("size")).join(classes.select(*key, "least"), key)
    copies = copies.where(F.struct(*place) != F.col("least")).select(
        "doc_id", "mark", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))
    return again.unionByName(copies).unionByName(_shard_spans(shards)).unionByName(_crowded_spans(compared.where("crowded")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed``: one row for each row of ``docs``.

    A byte is removed when some ``LENGTH`` bytes that cover it also start earlier: in a document with a smaller id, or earlier in the
    same one. ``removed`` lists the maximal runs as ``start:end``, comma-joined. Strings are those of the input, and matches do not cross
    documents. Null text counts as empty. A row without id has no place in the order: nothing is removed from it and it is not matched. Rows that
    repeat an id and a text are the same document; with different texts they are ordered by a hash of the text. Other columns are left out.
    """
    texts = _texts(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col)
    by_doc = written(spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    hit = bitmap.keep(texts, "mark", bitmap.build(by_doc, "mark")).join(by_doc, ["doc_id", "mark"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
            step = np.zeros(len(text) + 2, np.int32)
            np.add.at(step, [s["start"] + 1 for s in spans], 1)
            np.add.at(step, [s["stop"] + 1 for s in spans], -1)
            gone = np.cumsum(step) > 0
            edges = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
            kept = _bytes_of(text)[~gone[1:-1]].tobytes()
            rows.append((len(text) - len(kept), len(edges), hashlib.sha256(kept).hexdigest(), ",".join([f"{a}:{b}" for a, b in edges.tolist()])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "mark", "n_removed", "n_spans", "kept_sha256", "removed"])

    cut = _by_part(hit, run, "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string, removed string")
    cut = cut.dropDuplicates(["doc_id", "mark"])
    whole = texts.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return whole.join(cut, ["doc_id", "mark"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("removed", F.lit("")).alias("removed"))
