"""Near-duplicates by b-bit MinHash.

A document is its set of distinct shingles of five words. Documents with the same set form a class, and only one of a class
goes on. Bands of minima give candidates; the lowest bits of all minima, packed into a few numbers, estimate their
similarity by counting equal bits, corrected for bits that agree by chance; what may reach the threshold is confirmed
on the full sets.

Within a bucket of a band each document first meets only the least one. Confirmed links give components, and afterwards
only documents of different components meet, in cells of bounded size that return a forest of links (``crowds``). These get signatures of ``LONG`` minima, so that
few pairs below the threshold remain to be compared in full. No pair that could join two components is left out, and no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltabula.llm.common import arrow_map, fresh, id_and_text, mix64, slices
from moltabula.llm.components import components
from moltabula.llm.crowds import alike, deal, links, overlapping
from moltabula.scratch import written

SHINGLE = 5
SIMILARITY_PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at 0.75 shares no band with a probability of 5e-6
HASHES = BANDS * ROWS
BITS = 2  # low bits kept of each minimum
LONG = 1024  # minima in the signatures of documents that are left
SLACK = 5.0  # standard deviations by which the estimate may fall short
REMEMBERED = 250_000
CELL_ROWS = 2048  # signatures on each side of a cell
CELL_MEMBERS = 1 << 20  # members of all sets on each side of a cell

_SEEDS = mix64(np.arange(1, 2 * LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = (_SEEDS[:LONG] | np.uint64(1)).astype(np.uint32)
_SHIFTS = _SEEDS[LONG:].astype(np.uint32)
_PLACES = mix64(np.arange(100, 100 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


class Shingler:
    """Shingle sets as sorted 64-bit hashes; words are hashed once in a task."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            words = text.lower().split()  # both touch ASCII only
            try:
                hashes = np.array([known[w] for w in words], np.uint64)
            except KeyError:
                known.update({w: xxhash.xxh3_64_intdigest(w) for w in set(words) if w not in known})
                hashes = np.array([known[w] for w in words], np.uint64)
            out.append(shingles(hashes))
        return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of five words each; of fewer words the whole; none for none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return mix64((words * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[:n - SHINGLE + 1] * _PLACES[0]
    for j in range(1, SHINGLE):
        total = total + words[j:n - SHINGLE + 1 + j] * _PLACES[j]
    return np.unique(mix64(total))


def minima(hashes: np.ndarray, n: int = HASHES) -> np.ndarray:
    """The least value of each of ``n`` hash functions over a set."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    step = (1 << 18) // n
    for i in range(0, len(short), step):
        block = np.multiply.outer(short[i:i + step], _FACTORS[:n])
        block += _SHIFTS[:n]
        np.minimum(low, block.min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """``BITS`` low bits of each minimum side by side in 64-bit numbers."""
    per = 64 // BITS
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per)
    return np.bitwise_or.reduce(bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def bands(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


N_WORDS = HASHES * BITS // 64
SIGNATURE = [f"s{i}" for i in range(N_WORDS)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, d0, d1, s0 ..., bands``: size and digest of the set, packed signature and band keys."""

    def run(batch: pa.RecordBatch, shingler: Shingler) -> pa.RecordBatch:
        sizes, digests, signs, keys = [], [], [], []
        for s in shingler.sets(batch.column(1).cast(pa.binary()).to_pylist()):
            sizes.append(len(s))
            digests.append((s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
            low = minima(s)
            signs.append(packed(low))
            keys.append(bands(low) if len(s) else np.zeros(0, np.uint64))
        digest = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
        sign = np.array(signs, np.uint64).reshape(-1, N_WORDS).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(digest[:, i]) for i in range(2)], *[pa.array(sign[:, i]) for i in range(N_WORDS)], listed],
            ["doc_id", "n_shingles", "d0", "d1", *SIGNATURE, "bands"])

    def parts(batch: pa.RecordBatch, shingler: Shingler) -> pa.Table:
        return pa.Table.from_batches([run(part, shingler) for part in slices(batch, 1)])

    schema = f"doc_id long, n_shingles long, d0 long, d1 long, {', '.join(f'{s} long' for s in SIGNATURE)}, bands array<long>"
    return arrow_map(id_and_text(docs, id_col, text_col), parts, schema, Shingler)


def long_signatures(texts: DataFrame) -> DataFrame:
    """``doc_id, sign, members``: packed signature of ``LONG`` minima and the sorted set, as bytes, of each text that has shingles."""

    def run(batch: pa.RecordBatch, shingler: Shingler) -> pa.RecordBatch:
        sets = shingler.sets(batch.column(1).cast(pa.binary()).to_pylist())
        filled = [i for i, s in enumerate(sets) if len(s)]
        columns = [[packed(minima(sets[i], LONG)).tobytes() for i in filled], [sets[i].tobytes() for i in filled]]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(filled, pa.int64())), *[pa.array(c, pa.binary()) for c in columns]], ["doc_id", "sign", "members"])

    def parts(batch: pa.RecordBatch, shingler: Shingler) -> pa.Table:
        return pa.Table.from_batches([run(part, shingler) for part in slices(batch, 1)])

    return arrow_map(texts, parts, "doc_id long, sign binary, members binary", Shingler)


def most_different(hashes: int) -> int:
    """How many of ``hashes`` minima may differ in their low bits, so that the estimate reaches the threshold less the slack."""
    chance = 2.0 ** -BITS
    equal = chance + (1 - chance) * SIMILARITY_PERCENT / 100
    return int(hashes * (1 - equal + SLACK * (equal * (1 - equal) / hashes) ** 0.5))


def may_be_similar(left: str, right: str) -> Column:
    """Equal low bits of two signatures reach what the threshold leads to, less the slack."""
    odd = int("01" * 32, 2)
    differ = []
    for s in SIGNATURE:
        z = F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))
        differ.append(F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(odd))))
    return reduce(add, differ) <= most_different(HASHES)


MOST_DIFFERENT = most_different(LONG)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Two documents are linked when 100 * intersection >= 75 * union of their shingle sets; ``component_id`` is the least id reachable over links and
    ``kept`` marks the document that has it. Null, empty and blank texts have an empty set and are linked with nothing. A row without id is linked with nothing, has a null component and is kept.
    Rows that repeat an id are one node. Other columns are left out.
    """
    rows = written(sketches(docs, id_col, text_col), "sketches")
    keys = ["n_shingles", "d0", "d1"]
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(
        F.min(F.struct("doc_id", *SIGNATURE, "bands")).alias("r"))
    heads = written(classes.select(*keys, "r.*"), "heads")
    entries = heads.select(F.explode("bands").alias("band"), "doc_id")
    shared = entries.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    crowded = written(entries.join(shared, "band"), "crowded")
    signs = heads.select("doc_id", *SIGNATURE)

    stars = crowded.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    stars = written(_with_signs(stars, signs).where(may_be_similar("a_", "b_")).select("a", "b"), "stars")
    busy = crowded.select("doc_id").distinct()
    texts = written(id_and_text(docs, id_col, text_col).join(busy, "doc_id", "left_semi"), "texts")
    linked = written(confirmed(stars, texts), "confirmed")
    found = components(linked)

    # what is left: documents of different components that share a bucket
    at = crowded.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    at = written(at, "at")
    mixed = at.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    left_over = written(at.join(mixed, "band"), "left")
    signs = written(long_signatures(texts.join(left_over.select("doc_id").distinct(), "doc_id", "left_semi")).distinct(), "long")  # an id may have several texts
    more = [across_components(left_over, signs)]
    own = written(rows.select("doc_id", *keys).join(heads.select(*keys, F.col("doc_id").alias("head")), keys, "left"), "own")
    # an id with several texts is one node, so it links their classes
    several = own.where("head is not null").groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("z")).where("a < z")
    more.append(own.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("head").alias("b")).where("a < b"))
    later = written(more[0].unionByName(more[1]), "later")
    if not later.isEmpty():
        # components known so far stand for the links that made them
        found = components(later.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    own = own.join(found.withColumnRenamed("node", "head"), "head", "left").withColumn("component_id", F.coalesce("component", "head"))
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def across_components(entries: DataFrame, signs: DataFrame) -> DataFrame:
    """``a, b``: confirmed links that join different components of ``band, doc_id, component``, from the signatures and sets of ``signs``.

    Bit counts first show which components may belong together, as a forest for each bucket; all that hang together form a crowd. A crowd's rows then meet once, in cells, whatever
    number of buckets they share, with their full sets.
    """
    cells = deal(entries.withColumn("mass", F.lit(1)), "band", CELL_ROWS)
    maybe = links(cells.join(signs.select("doc_id", "sign"), "doc_id"), "band", ["sign"], lambda t: alike(_long(t), MOST_DIFFERENT))
    maybe = written(maybe.selectExpr("a_component as a", "b_component as b").distinct(), "maybe")
    crowds = components(maybe).toDF("component", "crowd")
    members = entries.select("doc_id", "component").distinct().join(crowds, "component")
    sized = members.join(signs.groupBy("doc_id").agg(F.sum(F.octet_length("members") / 8 + 1).alias("mass")), "doc_id")
    cells = deal(written(sized.select("crowd", "doc_id", "component", "mass"), "crowds"), "crowd", CELL_MEMBERS)

    def judge(t: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        near, full = alike(_long(t), MOST_DIFFERENT), overlapping([np.frombuffer(m, np.uint64) for m in t["members"].to_pylist()], SIMILARITY_PERCENT)

        def partners(i: int, other: np.ndarray) -> np.ndarray:
            other = near(i, other)
            return full(i, other) if len(other) else other

        return partners

    found = links(cells.join(signs, "doc_id"), "crowd", ["sign", "members"], judge)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _long(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sign"].to_pylist()), np.uint64).reshape(t.num_rows, -1)


def _with_signs(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(signs.select(F.col("doc_id").alias(side), *[F.col(s).alias(f"{side}_{s}") for s in SIGNATURE]), side)
    return pairs


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of which some texts have full shingle sets that reach the threshold."""
    full = pairs.join(texts.toDF("a", "a_text"), "a").join(texts.toDF("b", "b_text"), "b").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for batch in slices(whole, 2):
                keep = []
                last, held = None, None
                for a, x, y in zip(*[batch.column(i).cast(pa.binary()).to_pylist() if i > 1 else batch.column(i).to_pylist() for i in (0, 2, 3)]):
                    if (a, x) != last:
                        last, held = (a, x), shingler.sets([x])[0]
                    other = shingler.sets([y])[0]
                    both = len(np.intersect1d(held, other, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= SIMILARITY_PERCENT * (len(held) + len(other) - both))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return full.mapInArrow(run, "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; all columns and rows without id pass through."""
    name = fresh("kept_id", docs)
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
