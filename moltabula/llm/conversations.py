"""Prefix trie of conversations.

Turns get numbers from a dictionary, conversations become sequences of numbers, and equal sequences one row with a count. These rows are
dealt out by ranges, so conversations with a common beginning lie side by side. A task cuts its range into runs of bounded
size and puts each run into a ternary search tree, the middle sequence first and then the middles of both halves, which keeps the tree balanced. One traversal
with a stack sums members, leaves and savings from the bottom up.

Only nodes on the way to the first or the last sequence of a run can lie in other runs too. These leave partial sums, which are
merged by an aggregate and added up along their ancestors; all others are finished in their run.

Sequences are cut into segments of ``SEGMENT`` turns. The tries of later segments hang below the end nodes of earlier ones, so no row
holds a whole conversation however long it is; the number of passes is the number of segments of the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.llm.ordered import list_digests
from moltabula.scratch import written

SEGMENT = 256  # turns in one row of a sequence
RUN_TURNS = 100_000  # turns in one search tree
SHARED, BLOCK = 4, 20  # a conversation starts with fewer than SHARED turns of the first one of its block of ids
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, turn_id, words``: each turn with its place from 0 and its number in the dictionary.

    Turns are ordered by ``turn``, null first, ties by the digest of role and text; null role or text is empty. Rows without conv_id belong to no
    conversation and are left out. A conversation may span several tasks: each numbers its own part, and what its earlier parts hold is added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.cast("long").alias("words"))
    rows = rows.where("conv_id is not null").withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "digest", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            at = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + seen, at - start)
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(conv), part, np.int64))], ["conv_id", "digest", "words", "place", "part"])

    placed = written(ranged.mapInArrow(number, "conv_id long, digest binary, words long, place long, part long"), "turns")
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1").select("conv_id")
    split = written(parts.join(split, "conv_id"), "split")  # at most two conversations of each task
    later = split.select("conv_id", "part", "n").join(split.select("conv_id", F.col("part").alias("_part"), F.col("n").alias("_n")), "conv_id").where("_part < part")
    later = later.groupBy("conv_id", "part").agg(F.sum("_n").alias("_before"))
    codes = placed.groupBy("digest").agg(F.max("words").alias("_w")).select("digest", F.monotonically_increasing_id().alias("turn_id"))
    return (
        placed.join(later, ["conv_id", "part"], "left")
        .withColumn("place", F.col("place") + F.coalesce("_before", F.lit(0)))
        .join(written(codes, "dictionary"), "digest")
        .select("conv_id", "place", "turn_id", "words")
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, place, turn_id, words``: the first h turns come from the first conversation of the block, the others are its own.

    h is the checksum of the decimal id modulo ``SHARED``. With fewer turns there, or none, the own turns move up.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    first = turns.where(f"place < {SHARED - 1}").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "words"))).alias("first"))
    ids = turns.select("conv_id").distinct().withColumn("h", shared).where("h > 0").withColumn("_base", F.expr(f"conv_id - conv_id % {BLOCK}"))
    heads = ids.join(first.withColumnRenamed("conv_id", "_base"), "_base", "left").select("conv_id", "h", F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("h").cast("int")).alias("head"))
    heads = written(heads, "heads")
    moved = heads.where("size(head) < h").select("conv_id", (F.col("h") - F.size("head")).alias("_up"))
    own = turns.where(F.col("place") >= shared).join(moved, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("_up", F.lit(0))).alias("place"), "turn_id", "words")
    return heads.select("conv_id", F.inline("head")).unionByName(own)


class SearchTree:
    """Ternary search tree of sequences; a node stands for a prefix and knows the node of the prefix before it (``up``)."""

    def __init__(self):
        self.symbol, self.low, self.equal, self.high, self.up = [], [], [], [], []
        self.depth, self.members, self.least, self.words, self.end = [], [], [], [], []

    def _node(self, symbol, up: int, words: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.depth, self.depth[up] + 1 if up >= 0 else 0),
                              (self.members, 0), (self.least, None), (self.words, words), (self.end, -1)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, symbols: list, words: list[int], members: int, least: int, row: int) -> None:
        """Add a sequence of ``members`` conversations; row ``row`` ends at its last node."""
        up = -1
        for symbol, n_words in zip(symbols, words):
            level, side = (self.equal, up) if up >= 0 else (None, 0)
            x = (level[up] if up >= 0 else 0 if self.symbol else -1)
            while x >= 0 and self.symbol[x] != symbol:
                level, side = (self.low if symbol < self.symbol[x] else self.high), x
                x = level[x]
            if x < 0:
                x = self._node(symbol, up, n_words)
                if level is not None:
                    level[side] = x
            self.members[x] += members
            if self.least[x] is None or least < self.least[x]:
                self.least[x] = least
            up = x
        self.end[up] = row

    def order(self) -> list[int]:
        """All nodes, each prefix before its extensions."""
        out, stack = [], [0] if self.symbol else []
        while stack:
            x = stack.pop()
            out.append(x)
            stack += [y for y in (self.low[x], self.high[x], self.equal[x]) if y >= 0]
        return out


def median_order(n: int) -> list[int]:
    """The middle of 0 to n - 1, then the middles of both halves and so on."""
    out, waiting = [], [(0, n)]
    for low, high in waiting:
        if low < high:
            middle = (low + high) // 2
            out.append(middle)
            waiting += [(low, middle), (middle + 1, high)]
    return out


def node_key(above: bytes, turn_ids: list[int]) -> bytes:
    """Digest of a prefix: the segments before (``above``) and the turns of this one."""
    return hashlib.sha256(",".join([above.hex().upper(), *map(str, turn_ids)]).encode()).digest() if turn_ids else above


NODES = ("key binary, conv_id long, depth long, local int, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, words long, end_key binary, ancestors array<binary>")
_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 6, pa.binary(), pa.list_(pa.binary())]


def run_nodes(rows: list[dict], depth: int) -> pa.RecordBatch:
    """The nodes of one run of sorted sequences; those with a key are shared with other runs, or are roots, and hold partial sums."""
    tree = SearchTree()
    for i in median_order(len(rows)):
        r = rows[i]
        tree.insert([r["above"], *r["turn_ids"]], [0, *r["words"]], r["n_convs"], r["least"], i)
    n = len(tree.symbol)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    order = tree.order()
    shared = {x: node_key(tree.symbol[x], []) for x in order if tree.up[x] < 0}
    path: dict[int, tuple[int, int]] = {}  # nodes on the way to the first and last sequence: row and length
    for i in {0, len(rows) - 1}:
        x, length = tree.end.index(i), len(rows[i]["turn_ids"])
        while tree.up[x] >= 0:
            path[x] = (i, length)
            length -= 1
            x = tree.up[x]
    for x, (i, length) in path.items():
        shared[x] = node_key(rows[i]["above"], rows[i]["turn_ids"][:length])
    out: list[tuple] = []
    above_of: dict[int, int] = {}
    for x in order:
        above_of[x] = above_of[tree.up[x]] if tree.up[x] >= 0 else x
    root_conv = {tree.symbol[x]: None for x in order if tree.up[x] < 0}
    for r in rows:
        root_conv[r["above"]] = r["above_conv"]
    for x in reversed(order):
        up, end = tree.up[x], tree.end[x]
        if end >= 0:
            children[x] += rows[end]["more_children"]
            leaves[x] += rows[end]["more_leaves"]
            saved[x] += rows[end]["more_saved"]
        key, ancestors = shared.get(x), None
        if key is None:
            leaves[x] = leaves[x] or 1
            saved[x] += (tree.members[x] - 1) * tree.words[x]
            children[up] += 1
            leaves[up] += leaves[x]
            saved[up] += saved[x]
        else:
            ancestors, y = [], up
            while y >= 0:
                ancestors.append(shared[y])
                y = tree.up[y]
        root = above_of[x]
        parent_conv = None
        if up >= 0:
            parent_conv = root_conv[tree.symbol[root]] if up == root else tree.least[up] if up not in shared else None
        out.append((
            key, tree.least[x], depth + tree.depth[x], tree.depth[x], shared.get(up), parent_conv, tree.members[x], children[x], leaves[x], saved[x], tree.words[x],
            rows[end]["end_key"] if end >= 0 else None, ancestors))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], [c.split()[0] for c in NODES.split(", ")])


def _shards(classes: DataFrame, depth: int, run_turns: int) -> DataFrame:
    """Nodes of all runs of one segment."""
    order = ["above", "turn_ids"]
    ranged = classes.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= run_turns:
                    yield run_nodes(held, depth)
                    held, size = [], 0
                held.append(row)
                size += len(row["turn_ids"])
        if held:
            yield run_nodes(held, depth)

    return ranged.mapInArrow(run, NODES)


def _merged(partial: DataFrame) -> DataFrame:
    """Nodes that lie in several runs: their parts summed, then what they hold themselves added to all their ancestors."""
    parts = partial.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("depth", "local", "parent_key", "parent_conv_id", "words", "end_key")],
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("ancestors").alias("ancestors"))
    parts = written(parts, "boundary")
    inner = parts.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_more"))
    parts = parts.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more")
    own = parts.select(F.explode(F.concat(F.array("key"), "ancestors")).alias("key"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n"),
                       (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("s"))
    sums = own.groupBy("key").agg(F.sum("n").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    return written(parts.drop("n_leaves", "saved_tokens").join(sums, "key"), "merged")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, run_turns: int = RUN_TURNS, rebuild: bool = True) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: one row for each node of the trie.

    Null role or text is empty, turns without number come first, rows without conv_id take no part, other columns do not matter. An empty table has no node, not
    even a root. Repeated turns and equal conversations are members like others. ``rebuild=False`` takes the conversations as they are.
    """
    turns = written(turn_rows(conversations), "turn-ids")
    ids = turns.groupBy("conv_id").agg(F.lit(1).alias("_"))
    whole = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    used = written(rebuilt(turns) if rebuild else turns, "rebuilt")
    lengths = used.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    longest = lengths.agg(F.max("length")).first()[0] or 0
    parts = used.groupBy("conv_id", F.expr(f"place div {segment}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "turn_id", "words"))).alias("t"))
    parts = parts.select("conv_id", "block", F.col("t.turn_id").alias("turn_ids"), F.col("t.words").alias("words"))
    if longest > segment:
        parts = written(parts.join(lengths, "conv_id"), "segments")
    else:
        parts = written(parts.withColumn("length", F.size("turn_ids").cast("long")), "segments")

    key = F.unhex(F.sha2(F.concat_ws(",", F.hex("above"), F.col("turn_ids").cast("array<string>")), 256))
    above = None  # conversations that go on, with the key and least member of the node where the segment before ends
    levels, ends = [], []
    for block in range(-(-longest // segment)):
        rows = parts.where(F.col("block") == block).drop("block")
        if above is None:
            rows = rows.withColumn("above", F.lit(b"")).withColumn("above_conv", F.lit(whole["least"]))
        else:
            rows = rows.join(above, "conv_id")
        rows = rows.withColumn("key", key).withColumn("more", F.col("length") > (block + 1) * segment)
        if longest > segment:
            rows = written(rows, "classes")
        ends.append(rows.where("not more").select("key", "conv_id"))
        classes = rows.groupBy("above", "key", "turn_ids").agg(
            F.first("words").alias("words"), F.first("above_conv").alias("above_conv"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("least"),
            F.bool_or(~F.col("more")).alias("ends"))
        classes = written(classes, "sequences")
        levels.append(classes)
        above = rows.where("more").select("conv_id", F.col("key").alias("above")).join(classes.select(F.col("key").alias("above"), F.col("least").alias("above_conv")), "above")

    deeper = None
    nodes = []
    for block in reversed(range(len(levels))):
        classes = levels[block].withColumn("end_key", F.when(F.col("ends"), F.col("key")))
        if deeper is None:
            classes = classes.withColumns({c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")})
        else:
            classes = classes.join(deeper, "key", "left").fillna(0, ["more_children", "more_leaves", "more_saved"])
        made = written(_shards(classes.drop("key", "ends"), block * segment, run_turns), "nodes")
        merged = _merged(made.where("key is not null"))
        deeper = merged.where("local = 0").select("key", F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
        found = made.where("key is null").select(merged.columns).unionByName(merged.where("local > 0"))
        known = found.where("parent_conv_id is not null")
        parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_conv"))
        asked = found.where("parent_conv_id is null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_conv")).select(found.columns)
        nodes.append(known.unionByName(asked))

    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    silent = ids.select("conv_id").join(lengths, "conv_id", "left_anti").select(F.lit(b"").alias("key"), "conv_id")
    digests = list_digests(reduce(DataFrame.unionByName, [*ends, silent]), "key", "conv_id")
    spark = conversations.sparkSession
    root = spark.createDataFrame([(b"", whole["least"], 0, None, whole["n"])] if whole["n"] else [], "end_key binary, conv_id long, depth long, parent_conv_id long, n_convs long")
    if deeper is None:
        root = root.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    else:
        root = root.join(deeper.toDF("end_key", "n_children", "n_leaves", "saved_tokens"), "end_key", "left")
    every = reduce(DataFrame.unionByName, [t.select(*result, "end_key") for t in [*nodes, root]])
    ended = every.where("end_key is not null").join(digests.withColumnRenamed("key", "end_key"), "end_key", "left")
    ended = ended.select(*result, F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return ended.unionByName(every.where("end_key is null").select(*result, F.lit(EMPTY).alias("ends_sha256")))
