"""Conversation tries, centroid clusters and decontamination against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, documents, sentence
from moltabula.llm import centroids, conversations, decontaminate, ordered

TURNS = "conv_id long, turn int, role string, text string, key string, depth int, place long"


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            role, text = r or "", x or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0, digest), (role, text)))
    own = {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes, kids = defaultdict(list), Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids.update(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * words
    out = Counter()
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(k))))
        out[(min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def talks(seed, n):
    rng, rows = random.Random(seed), [(None, 1, "user", "x", None, 1, 2)]
    for c in range(-30, n):
        if rng.random() < 0.8:
            rows += [(c, rng.choice([t, t, None]), rng.choice(["u", "a", None]), rng.choice(["hi  there", "x", None, "a b c\n", "é"]), "k", None, 3) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    return rows + rows[5:9]  # repeated rows


@pytest.mark.parametrize("segment, run_turns", [(256, 100_000), (2, 5), (3, 1)])
def test_trie(spark, segment, run_turns):
    rows = talks(segment, 50)
    found = conversations.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3), segment, run_turns)
    assert Counter(map(tuple, found.collect())) == plain_trie(rows)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_few_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.prefix_trie(empty).collect() == []
    # turnless after the exchange: the block's first conversation is absent and no own turn is left
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    for rows in ([(c, 0, "u", "a b", None, 1, 2)], [(c, 0, "u", "a b", None, 1, 2), (0, 0, "u", "x", None, 1, 2)], [(7, None, None, None, None, None, None)]):
        assert Counter(map(tuple, conversations.prefix_trie(spark.createDataFrame(rows, TURNS)).collect())) == plain_trie(rows)
    rows = talks(9, 10)
    assert Counter(map(tuple, conversations.prefix_trie(spark.createDataFrame(rows, TURNS), rebuild=False).collect())) == plain_trie(rows, rebuild=False)


def test_one_long_conversation_and_many_copies(spark):
    """A conversation of many segments over several tasks, and one sequence that most conversations share."""
    rows = [(1000, t, "u", f"turn {t % 5}", None, 1, 2) for t in range(700)]
    rows += [(c * 20, t, "u", f"turn {t % 5}", None, 1, 2) for c in range(300) for t in range(3)]
    got = conversations.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), 240, 50)
    assert Counter(map(tuple, got.collect())) == plain_trie(rows)


def test_search_tree_is_balanced():
    tree = conversations.SearchTree()
    for i in conversations.median_order(1000):
        tree.insert([i], [1], 1, i, i)

    def height(x):
        return 0 if x < 0 else 1 + max(height(tree.low[x]), height(tree.high[x]))

    assert height(0) == 10 and sorted(tree.order()) == list(range(1000))


def test_list_digests(spark):
    rng = random.Random(4)
    rows = [(bytes([rng.choice([1, 1, 1, 1, 2, 3, rng.randrange(200)])]), rng.randrange(500)) for _ in range(3000)] + [(None, 1), (b"z", None)]
    want = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None:
            want[k].append(v)
    for size in (1, 100, 1 << 18):
        found = ordered.list_digests(spark.createDataFrame(rows, "k binary, v long").repartition(4), "k", "v", size).collect()
        assert {bytes(r.key): r.sha256 for r in found} == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
        assert len(found) == len(want)


def plain_clusters(rows, dims, k=16, rounds=3, scale=64, seed=1):
    v = [(i, [math.floor(scale * float(x)) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    centres = [x for _, x in sorted(v, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for i, x in v:
            squares = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
            out.append((i, squares.index(min(squares)), min(squares), x))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            mine = [x for _, c, _, x in found if c == j]
            centres[j] = [sum(column) // len(mine) for column in zip(*mine)] if mine else centres[j]
    found, per = assign(), Counter()
    for _, c, d, _ in found:
        per[c] += d
    return Counter((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d, _ in found)


@pytest.mark.parametrize("dims, n", [(6, 120), (2, 60), (1, 30), (2, 4)])
def test_clusters(spark, dims, n):
    """Nulls, other lengths, repeated ids and vectors, ties, flat pivots, fewer vectors than clusters."""
    rng = np.random.default_rng(dims)
    rows = [(int(i) if i % 7 else None, [float(x) for x in rng.integers(-3, 4, dims) / 2], "c", 1) for i in range(n)] + [(5, [1.0] * dims, None, None)] * 4
    rows += [(i, v, "c", 2) for i, v in enumerate([None, [], [1.0] * (dims + 1), [float("nan")] * dims, [None] * dims, [float("-inf")] * dims], 900)]
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int").repartition(3), dims=dims)
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows, dims)


def test_clusters_of_nothing_and_of_large_numbers(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(none).collect() == []
    large = spark.createDataFrame([(1, [2.0 ** 21, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ArithmeticError):
        centroids.cluster(large, dims=2)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (16, 64))
    vectors = centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 61, (3000, 64))
    simplex = centroids.Simplex(centres)
    squares, other = simplex.distances(vectors), simplex.apexes(simplex.distances(centres))
    own = simplex.apexes(squares)
    exact = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    flat = ((own[:, None, :-1] - other[None, :, :-1]) ** 2).sum(axis=2)
    assert ((flat + (own[:, None, -1] - other[None, :, -1]) ** 2) <= exact * (1 + 1e-9) + 1e-3).all()
    assert ((flat + (own[:, None, -1] + other[None, :, -1]) ** 2) >= exact * (1 - 1e-9) - 1e-3).all()
    cluster, distance, compared = centroids.nearest(vectors, squares, centres, simplex)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared < 3000 * 16 / 3


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, span=10):
    windows = defaultdict(set)
    for i, t in items:
        words = plain_words(t)
        n = min(span, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[a:a + n])].add(i)
    out = Counter()
    for i, t in docs:
        words, hit, found = plain_words(t), set(), set()
        for n in {len(w) for w in windows}:
            for a in range(len(words) - n + 1):
                ids = windows.get(tuple(words[a:a + n]))
                if ids:
                    hit.update(range(a, a + n))
                    found.update(str(x) for x in ids if x is not None)
        out[(i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0)] += 1
    return out


ITEMS = [(1, sentence(2, 60)), (2, None), (3, ""), (4, "X"), (5, "one, TWO three"), (10, sentence(6, 30)), (9, sentence(6, 30)), (None, "a b"), (9, "größe"), (1, "Привет мир GRößE"),
         (7, "a" * 30_000), (8, sentence(5, 12_000))]


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_decontamination(spark, docs, none, limit):
    """The broadcast and the join give the same rows."""
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id int, text string, doc_id string, n_hit int")
    found = decontaminate.contaminated(docs, items, limit=limit)
    assert Counter(tuple(r)[:6] for r in found.collect()) == plain_hits([r[:2] for r in documents()], ITEMS)
    assert all(r.n_hit == sum(x.stop - x.start for x in r.runs) for r in found.collect())
    assert decontaminate.contaminated(none, items, limit=limit).count() == 0
    assert decontaminate.contaminated(docs, items.where("false"), limit=limit - 1).where("contaminated").count() == 0


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_removal(spark, docs, limit):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    bad = {r[:2] for r in plain_hits([r[:2] for r in documents()], ITEMS) if r[5]}
    hits = {(r[0], r[1]) for r in documents() if (r[0], len(plain_words(r[1]))) in bad}
    whole = decontaminate.decontaminate(docs, items, "documents", limit=limit)
    assert whole.columns == docs.columns and Counter(map(tuple, whole.collect())) == Counter(r for r in documents() if r[:2] not in hits)
    cut = decontaminate.decontaminate(docs, items, "spans", limit=limit)
    assert cut.schema == docs.schema and cut.count() == len(documents())
    rows = Counter(map(tuple, cut.collect()))
    assert all(rows[r] for r in documents() if r[:2] not in hits)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    assert texts[11] == [""] and texts[15] == [""] and texts[7] == [""] and texts[13] == ["一二三 四五六 "]
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, "other")


def test_hash_collisions_are_verified():
    import pyarrow as pa

    rows = pa.table({"hash": pa.array([int(decontaminate.window_hashes(decontaminate.word_codes([b"a"], {}), 1).view(np.int64)[0])]), "length": pa.array([1], pa.int32()),
                     "gram": pa.array([b"a"], pa.binary()), "item_id": ["1"]})
    windows = decontaminate.WindowSet(rows)
    windows.grams = {b"b": ["1"]}  # as if another window had this hash
    assert not windows.search([b"a"])[0].any()
