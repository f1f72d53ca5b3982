"""Benchmark decontamination: windows of test items found in training texts.

Words are runs of ASCII letters and digits and of characters beyond ASCII, lower case in A-Z. A window is ``SPAN`` consecutive words of an item; a shorter item
is one window as a whole. Every word of a document that lies in an occurrence of a window is hit.

The distinct windows are counted first. Up to ``BROADCAST_WINDOWS`` of them (and as many pairs of window and item, and ``BROADCAST_BYTES`` of text) go to every task as a set of hashes with their words, and each hit is
verified word by word in the task that reads the document. Beyond that, a bitmap of fixed size goes to the tasks instead; the windows that pass it meet the test
windows in a join on hash and digest. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.llm import bitmap
from moltabula.llm.common import arrow_map, mix64, slices
from moltabula.llm.ordered import list_digests
from moltabula.scratch import written

SPAN = 10
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 256 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
REMEMBERED = 200_000

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(b if b in _WORD_BYTES else 32 for b in bytes(range(256)).lower())
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLACES = mix64(np.arange(300, 300 + SPAN * 8, dtype=np.uint64)) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def window_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash for each window of ``length`` word codes."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, length, np.uint64)
    for j in range(length):
        total += codes[j:j + n] * _PLACES[j]
    return mix64(total)


def word_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A hash for each word; ``known`` remembers them within a task."""
    if len(known) > REMEMBERED:
        known.clear()
    known.update({w: xxhash.xxh3_64_intdigest(w) for w in set(words) if w not in known})
    return np.array([known[w] for w in words], np.uint64)


def covered(starts: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """Marks of the words in windows of ``length`` that begin at ``starts``."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """Start and end (exclusive) of the runs of marked words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def item_windows(items: DataFrame, span: int = SPAN, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``hash, length, gram, item_id``: the distinct windows of each item; ``gram`` has its words with single spaces. Null texts have none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, known = [], {}
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = words_of(text)
            length = min(span, len(words))
            if length:
                hashes = window_hashes(word_codes(words, known), length).view(np.int64).tolist()
                grams = {b" ".join(words[i:i + length]): h for i, h in enumerate(hashes)}
                out += [(h, length, g, item) for g, h in grams.items()]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["hash", "length", "gram", "item_id"])

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    def parts(batch: pa.RecordBatch) -> pa.Table:
        return pa.Table.from_batches([run(part) for part in slices(batch, 1)])

    return arrow_map(rows, parts, "hash long, length int, gram binary, item_id string").distinct()


class WindowSet:
    """Test windows by hash, their words for the check, and the items they come from."""

    def __init__(self, rows: pa.Table):
        self.grams: dict[bytes, list[str]] = {}
        for gram, item in zip(rows["gram"].to_pylist(), rows["item_id"].to_pylist()):
            found = self.grams.setdefault(gram, [])
            if item is not None:
                found.append(item)
        pairs = set(zip(rows["length"].to_pylist(), rows["hash"].to_pylist()))
        self.hashes = {n: np.sort(np.array([h for m, h in pairs if m == n], np.int64).view(np.uint64)) for n in sorted({n for n, _ in pairs})}
        # only words of test items can be part of a hit: all others share one code
        self.vocabulary = {w: xxhash.xxh3_64_intdigest(w) for g in self.grams for w in g.split(b" ")}

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Marks of the words that are hit, and the items hit."""
        marks, items = np.zeros(len(words), bool), set()
        codes = np.array([self.vocabulary.get(w, 0) for w in words], np.uint64)
        for length, hashes in self.hashes.items():
            found = window_hashes(codes, length)
            at = np.searchsorted(hashes, found)
            maybe = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == found)
            starts = []
            for i in maybe.tolist():
                listed = self.grams.get(b" ".join(words[i:i + length]))
                if listed is not None:
                    starts.append(i)
                    items.update(listed)
            if starts:
                marks |= covered(np.array(starts), length, len(words))
        return marks, items


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, runs array<struct<start:long,stop:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _run_column(runs: list[list[tuple[int, int]]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "stop"]), type=_RUNS)


def _searched(texts: DataFrame, rows: pa.Table) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batch: pa.RecordBatch, windows: WindowSet) -> pa.RecordBatch:
        out, runs = [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = words_of(text)
            marks, items = windows.search(words)
            out.append((len(words), int(marks.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() if items else EMPTY))
            runs.append(runs_of(marks))
        columns = [pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(4)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns, _run_column(runs)], [*batch.schema.names, "n_words", "n_hit", "n_items", "items_sha256", "runs"])

    return _by_slices(texts, run, lambda: WindowSet(shared.value))


def _by_slices(texts: DataFrame, run: Callable, prepare: Callable) -> DataFrame:
    def parts(batch: pa.RecordBatch, extra: object) -> pa.Table:
        return pa.Table.from_batches([run(part, extra) for part in slices(batch, 1)])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return arrow_map(texts, parts, f"{names}, {FOUND}", prepare)


def _joined(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for any number of test windows: candidates leave the documents by a bitmap and meet the windows in a join."""
    spark = texts.sparkSession
    bits = bitmap.build(windows.select("hash"), "hash")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most span numbers

    def pick(batch: pa.RecordBatch, state: tuple) -> pa.RecordBatch:
        held, known = state
        print_, places, lens, hashes, prints = [], [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = words_of(text)
            codes = word_codes(words, known)
            own = hashlib.sha256(text).digest()
            for length in lengths:
                found = window_hashes(codes, length).view(np.int64)
                for i in np.flatnonzero(bitmap.holds(held, found)).tolist():
                    print_.append(own)
                    places.append(i)
                    lens.append(length)
                    hashes.append(found[i])
                    prints.append(hashlib.sha256(b" ".join(words[i:i + length])).digest())
        columns = [pa.array(print_, pa.binary()), pa.array(places, pa.int64()), pa.array(lens, pa.int32()), pa.array(hashes, pa.int64()), pa.array(prints, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["text_print", "place", "length", "hash", "gram_print"])

    def parts(batch: pa.RecordBatch, state: tuple) -> pa.Table:
        return pa.Table.from_batches([pick(part, state) for part in slices(batch, 1)])

    candidates = arrow_map(texts, parts, "text_print binary, place long, length int, hash long, gram_print binary", lambda: (bits.value, {})).distinct()
    grams = written(windows.select("hash", F.unhex(F.sha2("gram", 256)).alias("gram_print"), "item_id"), "grams")
    hits = written(candidates.join(grams.select("hash", "gram_print").distinct(), ["hash", "gram_print"]), "hits")
    items = hits.select("text_print", "hash", "gram_print").distinct().join(grams.where("item_id is not null"), ["hash", "gram_print"]).select("text_print", "item_id").distinct()
    items = written(items, "items")
    digests = list_digests(items, "text_print", "item_id").toDF("text_print", "items_sha256").join(items.groupBy("text_print").agg(F.count(F.lit(1)).alias("n_items")), "text_print")
    # overlapping windows become runs: places of one text in order, a new run where no earlier window reaches
    ranged = hits.select("text_print", "place", (F.col("place") + F.col("length")).alias("stop")).repartition("text_print").sortWithinPartitions("text_print", "place")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, spans: list) -> pa.RecordBatch:
            n = sum(b - a for a, b in spans)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([n], pa.int64()), _run_column([spans])], ["text_print", "n_hit", "runs"])

        current, spans = None, []
        for batch in batches:
            for key, start, stop in zip(*[c.to_pylist() for c in batch.columns]):
                if key != current:
                    if current is not None:
                        yield row(current, spans)
                    current, spans = key, []
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
                else:
                    spans.append((start, stop))
        if current is not None:
            yield row(current, spans)

    runs = ranged.mapInArrow(merge, "text_print binary, n_hit long, runs array<struct<start:long,stop:long>>")
    found = written(runs.join(digests, "text_print", "left"), "found").withColumnRenamed("text_print", "_print")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = batch.column(1).cast(pa.binary()).to_pylist()
        columns = [pa.array([len(words_of(t)) for t in texts_], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts_], pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "_print"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    counted = arrow_map(texts, lambda b: pa.Table.from_batches([count(p) for p in slices(b, 1)]), f"{names}, n_words long, _print binary")
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    return counted.join(found, "_print", "left").select(
        *texts.columns, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY)).alias("items_sha256"), F.coalesce("runs", empty).alias("runs"))


def _scan(texts: DataFrame, items: DataFrame, span: int, limit: int) -> DataFrame:
    windows = written(item_windows(items, span), "windows")
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("b")).first()
    if size["n"] <= limit and size["b"] <= BROADCAST_BYTES:
        return _searched(texts, windows.select("hash", "length", "gram", "item_id").toArrow())  # at most limit rows
    return _joined(texts, windows)


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, limit: int = BROADCAST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs``: one row for each row of ``docs``; ``runs`` are maximal runs of hit words.

    Null and wordless texts have no words and no hits; null or wordless items have no window. Items that share an id are one item. An item without id marks words, but is not
    listed and not counted. Repeated documents each get their row. Without items nothing is hit, and without documents there is no row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _scan(texts, items, span, limit)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "runs")


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without what lies from the first to the last word of each run."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    kept, last = [], 0
    for start, stop in runs:
        kept.append(text[last:at[start][0]])
        last = at[stop - 1][1]
    return b"".join([*kept, text[last:]])


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", span: int = SPAN, limit: int = BROADCAST_WINDOWS, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, either without the hit ``spans`` of their texts or without the hit ``documents``; untouched texts, null ones included, stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    others = [f"_c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    plain = docs.toDF(*others)
    texts = plain.select(F.struct(*others).alias("row"), F.coalesce(F.col(others[place]), F.lit("")).alias("text"))
    found = _scan(texts, items, span, limit)
    if remove == "documents":
        return found.where("n_hit = 0").select("row.*").toDF(*docs.columns)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = [without_runs(t, [(r["start"], r["stop"]) for r in runs]).decode()
                  for t, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string())], ["row", "text"])

    hit = arrow_map(found.where("n_hit > 0").select("row", "text", "runs"), lambda b: pa.Table.from_batches([cut(p) for p in slices(b, 1)]), f"row {found.schema['row'].dataType.simpleString()}, text string")
    hit = hit.select(*[F.col("text").alias(c) if i == place else F.col(f"row.{c}").alias(c) for i, c in enumerate(others)])
    return found.where("n_hit = 0").select("row.*").unionByName(hit).toDF(*docs.columns)
