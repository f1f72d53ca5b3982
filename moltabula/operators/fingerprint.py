"""Hashed set fingerprints of rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltabula.constants import N_BITS, RADIUS
from moltabula.functions.bits import token_fingerprint, words_fingerprint
from moltabula.functions.text import char_grams, spaced_tokens
from moltabula.scratch import written

SLOT_ROWS = 1 << 16  # vertices and edges of whole graphs that a task takes at once, on average
LARGE_SLOT = 1 << 19  # beyond, a slot holds a large graph, whose vertices are joined with their edges instead


def hash_fingerprint(df: DataFrame, text: str, n_bits: int = N_BITS, grams: int | None = None) -> DataFrame:
    """``on_bits`` and ``n_on`` from the word set of a text, or with ``grams`` from its runs of so many characters.

    Words suit prose. Structured keys need ``grams``, which keep case, order and signs. Rows without a text are dropped.
    """
    valid = df.filter(F.col(text).isNotNull())
    words = words_fingerprint(spaced_tokens(F.col(text)), n_bits)
    with_bits = valid.withColumn("on_bits", words if grams is None else token_fingerprint(char_grams(F.col(text), grams), n_bits))
    return with_bits.withColumn("n_on", F.size("on_bits"))


def bit_vectors(df: DataFrame, on_bits: str = "on_bits", out: str = "features", n_bits: int = N_BITS) -> DataFrame:
    """Sparse 0/1 ML vectors, made from whole Arrow batches. Places outside ``n_bits`` are left out; no list gives no vector."""

    @F.arrow_udf(VectorUDT())
    def run(lists: pa.Array) -> pa.Array:
        n = len(lists)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bits = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(n) * n_bits, counts) + bits
        place = place[(bits >= 0) & (bits < n_bits)]
        if (place[1:] <= place[:-1]).any():
            place = np.unique(place)
        row, bit = np.divmod(place, n_bits)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32())
        indices = pa.ListArray.from_arrays(ends, pa.array(bit, pa.int32()))
        values = pa.ListArray.from_arrays(ends, pa.array(np.ones(len(bit))))
        kind, size = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, n_bits, np.int32))
        return pa.StructArray.from_arrays([kind, size, indices, values], ["type", "size", "indices", "values"], mask=lists.is_null())

    return df.withColumn(out, run(F.col(on_bits).cast("array<int>")))


def _number(text: Column, start: int, digits: int) -> Column:
    """Some hex digits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def _joined_bits(vertices: DataFrame, edges: DataFrame, graph: str, vertex: str, label: str, source: str, target: str, bond: str,
                 radius: int, n_bits: int) -> DataFrame:
    """Bits of graphs of any size, by a join and an aggregate for each round.

    Neighbours combine map-side and a hub vertex is never gathered in one place. A hash is kept as two numbers of 60 bits, so that the
    aggregate is a plain hash aggregate.
    """
    def hashed(text: Column) -> list[Column]:
        return [_number(text, 1, 15).alias("_a"), _number(text, 17, 15).alias("_b")]

    none = F.lit(None).cast("bigint")
    directed = edges.select(graph, F.col(source).alias("_from"), F.col(target).alias(vertex), bond)
    state = vertices.select(graph, vertex, *hashed(F.col(label).cast("string")))
    rounds = [state]
    for _ in range(radius):
        # what the neighbours contribute and the vertex itself meet in one aggregate
        pair = F.concat_ws("|", *[F.col(c).cast("string") for c in (bond, "_a", "_b")])
        given = directed.join(state, [graph, vertex]).select(
            graph, F.col("_from").alias(vertex), none.alias("_a"), none.alias("_b"),
            _number(pair, 1, 8).alias("_low"), _number(pair, 9, 8).alias("_high"),
        )
        itself = state.withColumns({"_low": none, "_high": none})
        met = given.unionByName(itself).groupBy(graph, vertex).agg(
            F.max("_a").alias("_a"), F.max("_b").alias("_b"),
            F.coalesce(F.sum("_low"), F.lit(0)).alias("_low"), F.coalesce(F.sum("_high"), F.lit(0)).alias("_high"),
        ).filter(F.col("_a").isNotNull())
        rehashed = F.concat_ws("|", *[F.col(c).cast("string") for c in ("_a", "_b", "_low", "_high")])
        # three later steps read a round, so it is stored rather than derived three times
        state = written(met.select(graph, vertex, *hashed(rehashed)), "round")
        rounds.append(state)
    hashes = rounds[0]
    for later in rounds[1:]:
        hashes = hashes.unionByName(later)
    return hashes.select(graph, (F.col("_a") % n_bits).cast("int").alias("bit")).distinct()


def _digests(texts: list[str], kind: str) -> np.ndarray:
    """The md5 of each text as two or four numbers."""
    data = b"".join([hashlib.md5(text.encode(), usedforsecurity=False).digest() for text in texts])
    return np.frombuffer(data, kind).reshape(len(texts), 16 // np.dtype(kind).itemsize)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of 60 bits that ``_number`` takes from both halves of the md5."""
    halves = (_digests(texts, ">u8") >> np.uint64(4)).astype(np.int64)
    return halves[:, 0], halves[:, 1]


def _once(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct row of some columns, and which of these every row is."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        own, values = pd.factorize(column)
        code, kinds = pd.factorize(code * len(values) + own)
    index = np.zeros(len(kinds), np.int64)
    index[code] = np.arange(len(code))
    return index, code


def _whole_graphs(rows: pa.Table, radius: int, n_bits: int) -> pa.Table:
    """Bits of the whole graphs among ``rows`` ``(graph, at, to, text)``: vertices with their label, whose ``to`` is null, and edges with their bond.

    Surroundings repeat from graph to graph, so each distinct text is hashed once.
    """
    graphs = rows["graph"].combine_chunks().dictionary_encode()
    names = pa.concat_arrays([*rows["at"].chunks, *rows["to"].chunks]).dictionary_encode()
    g = graphs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    name = names.indices.fill_null(0).to_numpy(zero_copy_only=False)
    width = max(1, len(names.dictionary))
    at, to = g * width + name[: len(g)], g * width + name[len(g) :]
    is_edge = rows["to"].is_valid().to_numpy()
    texts = rows["text"].combine_chunks().dictionary_encode()
    text, words = texts.indices.to_numpy(zero_copy_only=False), texts.dictionary.to_pylist()
    order = np.argsort(at[~is_edge], kind="stable")
    place = at[~is_edge][order]  # of each state, ascending
    a, b = (part[text[~is_edge][order]] for part in _hashed(words))
    owner, end, bond = at[is_edge], to[is_edge], text[is_edge]
    bits = [place // width * n_bits + a % n_bits]
    for _ in range(radius):
        first = np.searchsorted(place, end)
        met = np.searchsorted(place, end, side="right") - first
        edge = np.repeat(np.arange(len(end)), met)
        state = np.repeat(first - np.cumsum(met) + met, met) + np.arange(len(edge))
        given = bond[edge], a[state], b[state]
        index, code = _once(*given)
        pairs = [f"{words[x]}|{y}|{z}" for x, y, z in zip(*(part[index].tolist() for part in given))]
        pieces = _digests(pairs, ">u4").astype(np.int64)[code]
        once, starts = np.unique(place, return_index=True)
        if len(starts):
            a, b = np.maximum.reduceat(a, starts), np.maximum.reduceat(b, starts)
        place = once
        mine = np.searchsorted(place, owner[edge])
        known = mine < len(place)
        known[known] = place[mine[known]] == owner[edge][known]
        sums = np.zeros((len(place), 2), np.int64)
        np.add.at(sums, mine[known], pieces[known, :2])
        met_all = a, b, sums[:, 0], sums[:, 1]
        index, code = _once(*met_all)
        a, b = (part[code] for part in _hashed(["|".join(map(str, own)) for own in zip(*(part[index].tolist() for part in met_all))]))
        bits.append(place // width * n_bits + a % n_bits)
    found = np.unique(np.concatenate(bits))
    which, starts = np.unique(found // n_bits, return_index=True)
    sets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(found)), pa.int32()), pa.array((found % n_bits).astype(np.int32)))
    return pa.table({"graph": graphs.dictionary.take(pa.array(which)), "on_bits": sets})


def _graph_parts(vertices: DataFrame, edges: DataFrame, graph: str, vertex: str, label: str, source: str, target: str, bond: str,
                 radius: int, n_bits: int, slot_rows: int, large: int) -> tuple[DataFrame, DataFrame | None]:
    """``(graph, on_bits)`` of the graphs that tasks take whole, and ``(graph, bit)`` of all others, if there are any."""
    own = vertices.select(F.col(graph).alias("graph"), F.col(vertex).alias("at"), F.lit(None).cast(edges.schema[target].dataType).alias("to"),
                          F.col(label).cast("string").alias("text"), F.lit(False).alias("edge"))
    other = edges.select(F.col(graph).alias("graph"), F.col(source).alias("at"), F.col(target).alias("to"), F.col(bond).cast("string").alias("text"),
                         F.lit(True).alias("edge"))
    slots = max(1, -(-(vertices.count() + edges.count()) // slot_rows))
    slot = F.pmod(F.xxhash64(F.col("graph")), F.lit(slots)).cast("int").alias("_slot")
    rows = own.unionByName(other).select(slot, "*")
    odd = F.col("graph").isNull() | F.col("at").isNull() | F.col("text").isNull() | (F.col("edge") & F.col("to").isNull())
    heavy = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"), F.max(odd).alias("odd")).filter((F.col("n") > large) | F.col("odd"))
    heavy = written(heavy.select("_slot"), "slots")
    rows = rows.drop("edge")
    some = heavy.count()
    light = rows.join(heavy, "_slot", "left_anti") if some else rows
    kind = vertices.schema[graph].dataType.simpleString()
    sets = light.groupBy("_slot").applyInArrow(lambda t: _whole_graphs(t, radius, n_bits), f"graph {kind}, on_bits array<int>")
    sets = sets.withColumnRenamed("graph", graph)
    if not some:
        return sets, None
    sides = (df.withColumn("_slot", F.pmod(F.xxhash64(F.col(graph)), F.lit(slots)).cast("int")).join(heavy, "_slot", "left_semi").drop("_slot") for df in (vertices, edges))
    return sets, _joined_bits(*sides, graph, vertex, label, source, target, bond, radius, n_bits)


def graph_fingerprint(vertices: DataFrame, edges: DataFrame, graph: str = "graph", vertex: str = "vertex",
                      label: str = "label", source: str = "src", target: str = "dst", bond: str = "bond",
                      radius: int = RADIUS, n_bits: int = N_BITS, slot_rows: int = SLOT_ROWS, large: int = LARGE_SLOT) -> DataFrame:
    """``(graph, bit)`` rows of a circular-neighbourhood fingerprint.

    Every vertex starts with the hash of its label and is rehashed ``radius`` times with the
    multiset of its (edge label, neighbour hash) pairs; the hashes of all rounds, folded, are the
    bits. The multiset enters as two sums of 32-bit pieces. Edges are given in both directions.

    Whole graphs go to slots of about ``slot_rows`` rows, and a task does all rounds of a slot, so that rows are shuffled once. Slots of more than
    ``large`` rows, which hold a large graph, and those with nulls are worked out by joins instead, with the same bits.
    """
    sets, others = _graph_parts(vertices, edges, graph, vertex, label, source, target, bond, radius, n_bits, slot_rows, large)
    bits = sets.select(graph, F.explode("on_bits").alias("bit"))
    return bits if others is None else bits.unionByName(others)


def graph_sets(vertices: DataFrame, edges: DataFrame, graph: str = "graph", vertex: str = "vertex",
               label: str = "label", source: str = "src", target: str = "dst", bond: str = "bond",
               radius: int = RADIUS, n_bits: int = N_BITS, slot_rows: int = SLOT_ROWS, large: int = LARGE_SLOT) -> DataFrame:
    """``graph_bits`` of ``graph_fingerprint``, without a shuffle of single bits."""
    sets, others = _graph_parts(vertices, edges, graph, vertex, label, source, target, bond, radius, n_bits, slot_rows, large)
    sets = sets.withColumn("n_on", F.size("on_bits"))
    return sets if others is None else sets.unionByName(graph_bits(others, graph))


def graph_bits(bits: DataFrame, graph: str = "graph") -> DataFrame:
    """``on_bits`` per graph; a set of at most ``n_bits`` numbers."""
    sets = bits.groupBy(graph).agg(F.array_sort(F.collect_set("bit")).alias("on_bits"))
    return sets.withColumn("n_on", F.size("on_bits"))
