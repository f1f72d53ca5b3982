"""Exact dedup with composable polynomial fingerprints.

A text is cut into chunks of bytes. A chunk's hash is the sum of its bytes times powers of a base, modulo a
prime; hashes of neighbours combine as ``hash(ab) = hash(a) * base^len(b) + hash(b)``, so chunks may be
hashed in any order and place. Four primes give about 124 bits. Rows with equal fingerprints and lengths form
a group; their texts are then compared chunk by chunk: for each group and chunk number the least and greatest
chunk must be the same. Those extremes combine in each task before the shuffle, so a group that
holds a third of the rows costs one row for each task and chunk. A group that fails the comparison is divided by SHA-256.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.llm import bitmap
from moltabula.llm.common import arrow_map, fresh, id_and_text, slices
from moltabula.scratch import written

CHUNK = 1 << 16  # bytes of a chunk
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([1103515245, 1664525, 22695477, 134775813], np.uint64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    return _SPACE.sub(b" ", text)


def _powers(n: int) -> np.ndarray:
    """``base^(n-1) ... base^0`` for each prime, built by doubling."""
    out = np.ones((len(PRIMES), 1), np.uint64)
    while out.shape[1] < n:
        step = np.array([pow(int(b), out.shape[1], int(p)) for b, p in zip(BASES, PRIMES)], np.uint64)[:, None]
        out = np.concatenate([out * step % PRIMES[:, None], out], axis=1)
    return out[:, -n:]


_CHUNK_POWERS = _powers(CHUNK)


def chunk_hash(chunk: bytes) -> list[int]:
    """Hash of up to ``CHUNK`` bytes for each prime; a product is below 2^39 and a sum below 2^56."""
    data = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return [int(x) for x in (_CHUNK_POWERS[:, CHUNK - len(data):] @ data) % PRIMES]


def combine(left: list[int], right: list[int], right_length: int) -> list[int]:
    """Hash of two neighbours from their hashes, the left one shifted by the length of the right one."""
    return [
        (a * pow(int(base), right_length, int(p)) + b) % int(p)
        for a, b, base, p in zip(left, right, BASES, PRIMES)
    ]


def fingerprint(data: bytes) -> bytes:
    """16 bytes for a text of any length; chunk hashes combine pairwise as a tree."""
    level = [(chunk_hash(data[i:i + CHUNK]), len(data[i:i + CHUNK])) for i in range(0, len(data), CHUNK)]
    while len(level) > 1:
        joined = [(combine(a, b, n), m + n) for (a, m), (b, n) in zip(level[::2], level[1::2])]
        level = joined + level[2 * len(joined):]
    return np.array(level[0][0] if level else [0] * len(PRIMES), np.uint32).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, n_bytes, text_sha256`` of each normalised text; null text counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, sizes, shas = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            data = normalised(text)
            prints.append(fingerprint(data))
            sizes.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas)],
            ["doc_id", "print", "n_bytes", "text_sha256"])

    def parts(batch: pa.RecordBatch) -> pa.Table:
        return pa.Table.from_batches([run(part) for part in slices(batch, 1)])

    return arrow_map(id_and_text(docs, id_col, text_col), parts, "doc_id long, print binary, n_bytes long, text_sha256 string")


def print_hash(mark: bytes) -> int:
    """Spark's ``xxhash64`` of a fingerprint, unsigned."""
    return xxhash.xxh64_intdigest(mark, seed=42)


def _chunks(docs: DataFrame, repeated: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """``print, n_bytes, chunk_no, chunk`` of the normalised texts whose fingerprint may be in the bitmap ``repeated``."""

    def run(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
        texts = [normalised(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        marks = [fingerprint(t) for t in texts]
        held = bitmap.holds(bits, np.array([print_hash(m) for m in marks], np.uint64).view(np.int64))
        rows = [(m, len(t), i // CHUNK, t[i:i + CHUNK]) for m, t, h in zip(marks, texts, held.tolist()) if h for i in range(0, len(t), CHUNK)]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["print", "n_bytes", "chunk_no", "chunk"])

    def parts(batch: pa.RecordBatch, bits: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([run(part, bits) for part in slices(batch, 1)])

    return arrow_map(id_and_text(docs, id_col, text_col), parts, "print binary, n_bytes long, chunk_no int, chunk binary", lambda: repeated.value)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs``.

    Texts are equal when they agree after each run of white space became one space. Null text counts as
    empty, and all empty texts are one group. A row without id belongs to its group and is counted; it is never the one that
    stays unless no row of the group has an id (then ``keep_id`` is null and all of them stay, since
    nothing tells them apart). Rows that repeat an id with an equal text are one document and share their flag. Other
    columns are left out.
    """
    rows = written(fingerprints(docs, id_col, text_col), "prints")
    groups = rows.groupBy("print", "n_bytes").agg(F.count(F.lit(1)).alias("_n"))
    repeated = written(groups.where("_n > 1").select("print", "n_bytes"), "repeated")
    held = bitmap.build(repeated.select(F.xxhash64("print").alias("h")), "h")  # chunks of other texts need not move
    compared = (
        _chunks(docs, held, id_col, text_col).join(repeated, ["print", "n_bytes"])
        .groupBy("print", "n_bytes", "chunk_no").agg(F.min("chunk").alias("_low"), F.max("chunk").alias("_high"))
    )
    unlike = compared.where("_low <> _high").select("print", "n_bytes").distinct().withColumn("_unlike", F.lit(True))
    return groups_from(rows, unlike)


def groups_from(rows: DataFrame, unlike: DataFrame) -> DataFrame:
    """Groups of equal fingerprints; those listed in ``unlike`` are divided by the digest of the text."""
    marked = written(
        rows.join(unlike, ["print", "n_bytes"], "left")
        .withColumn("_part", F.when(F.col("_unlike"), F.col("text_sha256")).otherwise("")).drop("_unlike"), "marked")
    keys = ["print", "n_bytes", "_part"]
    heads = marked.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return marked.join(heads, keys).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` marks as copies; all columns and other rows pass through."""
    name, print_ = fresh("kept_id", docs), fresh("kept_sha256", docs)
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(print_)).distinct()
    own = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)) & (own == F.col(print_)), "left_semi")
