"""Fixed-width set fingerprints as columns.

A fingerprint is ``on_bits``, the sorted distinct positions of its set bits. The packed form is an
array of 64-bit words and the dense form an array of 0/1.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltabula.constants import N_BITS

WORD = 64
MARKS = 1 << 23  # places of a dense table of some rows that a task fills at once


def hash_bit(value: Column, n_bits: int = N_BITS) -> Column:
    """Bit position of a string: the first 32 bits of its md5, folded."""
    return (F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint") % F.lit(n_bits)).cast("int")


def token_fingerprint(token_array: Column, n_bits: int = N_BITS) -> Column:
    bits = F.transform(F.array_distinct(token_array), lambda token: hash_bit(token, n_bits))
    return F.sort_array(F.array_distinct(bits))


def _bits_of_words(texts: pa.Array, n_bits: int) -> pa.Array:
    """Sorted distinct positions for each text; each word of all these texts is hashed once."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    digests = b"".join([hashlib.md5(word, usedforsecurity=False).digest() for word in words])
    bit = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % n_bits
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    places = coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), counts)
    if b"" in words:
        use = places != words.index(b"")
        places, row = places[use], row[use]
    marks = np.zeros((len(texts), n_bits), bool)
    marks[row, bit[places]] = True
    ends = np.cumsum(marks.sum(axis=1), dtype=np.int32)
    values = np.nonzero(marks)[1].astype(np.int32)
    absent = pa.array(lists.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values), mask=absent)


def words_fingerprint(spaced: Column, n_bits: int = N_BITS) -> Column:
    """``token_fingerprint`` of the words of a text with single spaces between them, such as ``spaced_tokens``."""
    step = max(1, MARKS // n_bits)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_bits_of_words(texts.slice(at, step), n_bits) for at in range(0, max(1, len(texts)), step)])

    return run(spaced)


def pack_words(on_bits: Column, n_bits: int = N_BITS) -> Column:
    """Array of 64-bit words; bit ``b`` is bit ``b % 64`` of word ``b div 64``."""
    width = -(-n_bits // WORD)

    @F.arrow_udf("array<bigint>")
    def run(lists: pa.Array) -> pa.Array:
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bits = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), counts)
        use = (bits >= 0) & (bits < width * WORD)
        bits, row = bits[use], row[use]
        words = np.zeros(len(lists) * width, np.uint64)
        np.bitwise_or.at(words, row * width + (bits >> 6), np.uint64(1) << (bits & (WORD - 1)).astype(np.uint64))
        absent = np.repeat(lists.is_null().to_numpy(zero_copy_only=False), width)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * width), pa.array(words.view(np.int64), mask=absent))

    return run(on_bits.cast("array<int>"))


def unpack_words(words: Column) -> Column:
    """Set positions of a packed fingerprint."""
    positions = F.transform(
        words,
        lambda word, index: F.transform(
            F.filter(
                F.sequence(F.lit(0), F.lit(WORD - 1)),
                lambda b: F.call_function("getbit", word, b) == 1,
            ),
            lambda b: (index * WORD + b).cast("int"),
        ),
    )
    return F.flatten(positions)


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, word: acc + F.bit_count(word))


def dense_bits(on_bits: Column, n_bits: int = N_BITS) -> Column:
    """0/1 array of ``n_bits`` floats."""

    def places(word: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("getbit", word, b).cast("float"))

    spread = F.flatten(F.transform(pack_words(on_bits, n_bits), lambda word: places(word)))
    return spread if n_bits % WORD == 0 else F.slice(spread, 1, n_bits)


def bits_from_dense(dense: Column) -> Column:
    marked = F.transform(dense, lambda value, i: F.when(value != 0, i))
    return F.filter(marked, lambda i: i.isNotNull())


def feature_columns(df: DataFrame, prefix: str = "fp_") -> list[str]:
    """Columns named ``<prefix><number>``, ordered by the number."""
    pattern = re.compile(re.escape(prefix) + r"(\d+)")
    found = [(int(m.group(1)), name) for name in df.columns if (m := pattern.fullmatch(name))]
    if not found:
        raise ValueError(f"no '{prefix}<number>' columns in the table")
    return [name for _, name in sorted(found)]


def require_features(df: DataFrame, wanted: list[str]) -> list[str]:
    present = set(df.columns)
    missing = [name for name in wanted if name not in present]
    if missing:
        more = "..." if len(missing) > 5 else ""
        raise ValueError(f"missing feature columns: {missing[:5]}{more}")
    return wanted


def from_wide(df: DataFrame, prefix: str = "fp_", keep: tuple[str, ...] = ("smiles", "source")) -> DataFrame:
    """Wide 0/1 columns to the set form."""
    wide = feature_columns(df, prefix)
    packed = F.array(*[F.col(name).cast("int") for name in wide])
    rows = df.select(*keep, bits_from_dense(packed).alias("on_bits"))
    return rows.withColumn("n_on", F.size("on_bits"))


def to_wide(df: DataFrame, on_bits: str = "on_bits", n_bits: int = N_BITS, prefix: str = "fp_",
            keep: tuple[str, ...] = ("smiles", "source")) -> DataFrame:
    """The set form to wide 0/1 columns, for tools that need them."""
    rows = df.select(*keep, dense_bits(F.col(on_bits), n_bits).alias("_dense"))
    wide = [F.col("_dense")[i].cast("tinyint").alias(f"{prefix}{i}") for i in range(n_bits)]
    return rows.select(*keep, *wide)
