"""Copies, near copies, repeated strings and vector search against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, sentence
from moltabula.llm import bitmap, components, crowds, exact, minhash, substrings, suffixes, topk
from pyspark.sql import functions as F


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    for cut in (0, 1, 40_000, 65_536, 200_000):
        def whole(b):
            return [int(x) for x in np.frombuffer(exact.fingerprint(b), np.uint32)]
        assert exact.combine(whole(data[:cut]), whole(data[cut:]), len(data) - cut) == whole(data)
    assert exact.fingerprint(b"ab") != exact.fingerprint(b"ba") and exact.fingerprint(b"") == bytes(16)
    slow = 0
    for b in data[:1000]:
        slow = (slow * int(exact.BASES[0]) + b + 1) % int(exact.PRIMES[0])
    assert slow == int(np.frombuffer(exact.fingerprint(data[:1000]), np.uint32)[0])


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = Counter()
    for r in rows:
        ids = groups[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out[(r[0], keep, len(ids), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest())] += 1
    return out


def test_exact_groups(spark, docs, none):
    assert Counter(map(tuple, exact.exact_groups(docs).collect())) == plain_groups(documents())
    assert exact.exact_groups(none).count() == 0
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {norm(r.text) for r in kept.collect()} == {norm(r[1]) for r in documents()}


def test_print_hash_is_that_of_spark(spark):
    marks = [exact.fingerprint(t.encode()) for t in ("", "a", "b" * 100_000)]
    rows = spark.createDataFrame([(m,) for m in marks], "m binary").select("m", F.xxhash64("m").alias("h")).collect()
    assert {bytes(r.m): r.h & (1 << 64) - 1 for r in rows} == {m: exact.print_hash(m) for m in marks}


def test_unequal_texts_behind_one_fingerprint_part(spark):
    rows = spark.createDataFrame([(1, b"x", 3, "aa"), (2, b"x", 3, "bb"), (3, b"x", 3, "aa"), (4, b"y", 3, "cc")], "doc_id long, print binary, n_bytes long, text_sha256 string")
    unlike = spark.createDataFrame([(b"x", 3, True)], "print binary, n_bytes long, _unlike boolean")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.groups_from(rows, unlike).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return Counter((i, len(s), None if i is None else find(i) if s else i, i is None or not s or find(i) == i) for i, s in sets)


def test_near_duplicates(spark, docs, none):
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == plain_components(documents())
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicate_chains_and_crowds(spark):
    rng, rows = random.Random(2), []
    words = sentence(9, 60).split()
    for i in range(150):  # a chain: neighbours are alike, the ends are not
        words[rng.randrange(60)] = f"w{i}"
        rows.append((2 * i + 1, " ".join(words)))
    base = sentence(10, 200).split()
    for i in range(150):  # a crowd of near copies, all different
        copy = list(base)
        copy[rng.randrange(200)] = f"v{i}"
        rows.append((2 * i, " ".join(copy)))
    shared = sentence(11, 60)
    rows += [(1000 + i, shared + " " + sentence(100 + i, 60 + i)) for i in range(60)]  # a common passage only
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == plain_components(rows)


@pytest.mark.parametrize("rows_, members", [(minhash.CELL_ROWS, minhash.CELL_MEMBERS), (40, 6000)])
def test_crowd_around_the_threshold(spark, rows_, members, monkeypatch):
    """Several hundred texts at 0.5 to 0.8 of each other, in one cell and in many."""
    monkeypatch.setattr(minhash, "CELL_ROWS", rows_)
    monkeypatch.setattr(minhash, "CELL_MEMBERS", members)
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(160)]
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            words[rng.randrange(len(words))] = f"c{rng.randrange(10 ** 6)}"
        rows.append((1000 - i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = plain_components(rows)
    assert 20 < len({r[2] for r in want}) < 290
    assert Counter(map(tuple, found.collect())) == want


def test_cells_hold_all_pairs_of_components(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0, 0, 0, 0, 1, 2, 3 + i]), 1 + i % 3) for g in range(3) for i in range(60)]
    cells = crowds.deal(spark.createDataFrame(rows, "band long, doc_id long, component long, mass int"), "band", 10.0).collect()
    together = defaultdict(list)
    for r in cells:
        together[(r.band, r.cell_a, r.cell_b)].append(r)
    met = set()
    for (band, a, b), group in together.items():
        assert sum(1 + r.doc_id % 3 for r in group) < 60
        met |= {(band, min(x.doc_id, y.doc_id), max(x.doc_id, y.doc_id)) for x in group for y in group if x.component != y.component and (a == b or x.side != y.side)}
    assert met == {(g, min(i, j), max(i, j)) for g, i, c, _ in rows for h, j, d, _ in rows if g == h and c != d}


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 9))).astype(np.uint64) for _ in range(80)]
    for sides in (np.zeros(80, int), rng.integers(0, 2, 80)):
        start = rng.integers(0, 40, 80)
        found = crowds.forest(start, sides, crowds.overlapping(sets, 75))
        linked = [(i, j) for i in range(80) for j in range(i) if (sides[i] != sides[j] or not sides.any())
                  and 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))]

        def joined(pairs):
            label = start.copy()
            for i, j in pairs:
                label[label == label[i]] = label[j]
            return [int(np.flatnonzero(label == x)[0]) for x in label]

        assert set(found) | {(j, i) for i, j in found} <= set(linked) | {(j, i) for i, j in linked}
        assert joined(found) == joined(linked) and len(found) < len(set(start))


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(3)
    for share in (0.3, 0.75, 0.95):
        n = 4000
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        own = [rng.integers(0, 2**63, (n - len(common)) // 2).astype(np.uint64) for _ in range(2)]
        a, b = (minhash.packed(minhash.minima(np.concatenate([common, o]))).view(np.int64).tolist() for o in own)
        columns = [f"{p}{s}" for p in "ab" for s in minhash.SIGNATURE]
        row = spark.createDataFrame([tuple(a + b)], columns).select(minhash.may_be_similar("a", "b").alias("x")).first()
        assert row.x == (share >= 0.75)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(500)]
    links += [(5, 5), (None, 7), (7, None), (2, 1)]
    root = {x: x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(data, depth):
    seen, out = set(), []
    for i in range(len(data) - depth + 1):
        w = data[i:i + depth]
        if 0 not in w:
            if w in seen:
                out.append(i)
            seen.add(w)
    return out


def test_suffix_order_with_spilling():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([[1], [1, 2], [1, 2, 3], list(range(1, 256))])
        parts = []
        for _ in range(rng.choice([1, 3, 15])):
            if parts and rng.random() < 0.5:
                old = rng.choice(parts)
                parts.append(old[rng.randrange(len(old) + 1):][:60] + [rng.choice(letters) for _ in range(rng.randrange(9))])
            else:
                parts.append([rng.choice(letters) for _ in range(rng.randrange(80))])
        data, depth = bytes(x for p in parts for x in [*p, 0]), rng.choice([1, 2, 3, 8, 20])
        memory, run_rows = rng.choice([(1 << 20, 1 << 18), (200, 5)])
        assert suffixes.repeats(np.frombuffer(data, np.uint8), depth, memory, run_rows).tolist() == plain_repeats(data, depth)


def plain_removal(rows):
    order = sorted({(r[0], (r[1] or "").encode()) for r in rows if r[0] is not None})
    seen, out = set(), {}
    for i, data in order:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = data[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        out[i, data] = gone
    result = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        gone = out.get((r[0], data), np.zeros(len(data), bool))
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        result[(r[0], len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return result


@pytest.mark.parametrize("crowded,direct", [(substrings.CROWDED, 0.05), (1, 0.05), (substrings.CROWDED, -1.0)])
def test_repeated_strings(spark, docs, none, crowded, direct, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "DIRECT_SHARE", direct)
    got = Counter(tuple(r)[:5] for r in substrings.without_repeats(docs).collect())
    assert got == plain_removal(documents())
    assert substrings.without_repeats(none).count() == 0


def test_bitmap_misses_nothing(spark):
    values = [hash(("x", i)) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    found = bitmap.build(df, "h")
    assert bitmap.keep(df, "h", found).count() == 2000
    other = spark.createDataFrame([(hash(("y", i)),) for i in range(2000)], "h long")
    assert bitmap.keep(other, "h", found).count() < 50


def vectors(spark, rows):
    return topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int"))


@pytest.mark.parametrize("blocks", [(4096, 8192, 16), (7, 11, 2)])
def test_top_k(spark, blocks, monkeypatch):
    for name, value in zip(("QUERY_ROWS", "CANDIDATE_ROWS", "RUN_BLOCKS"), blocks):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        v = rng.normal(size=8) * rng.choice([0.1, 0.5, 2.0])
        rows.append((i, [float(x) for x in np.float32(np.round(v, 1 if i % 2 else 3))], 0, 1))
    rows += [(900 + i, rows[i][1], None, None) for i in range(5)]
    bad = [(1001, None), (1002, []), (1003, [1.0, None, 0, 0, 0, 0, 0, 0.0]), (1004, [float("nan")] * 8), (1005, [float("inf")] * 8), (None, [1.0] * 8)]
    df = vectors(spark, rows + [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0) for i, v in bad])
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    whole = {i: np.floor(256 * np.float64(np.float32(v))) for i, v, *_ in rows}
    want = []
    for q in sorted(whole):
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    few = vectors(spark, rows[:3])
    mixed = vectors(spark, [(i, [float(i), 1.0][:1 + i // 100 % 2], 0, 1) for i in (0, 50, 51, 100, 101, 150, 350)])
    got = sorted(map(tuple, topk.top_k(mixed, mixed.where("vec_id % 50 = 0")).collect()))
    short, two = [0, 50, 51], [100, 101, 150, 350]
    assert got == sorted((q, n + 1, i, s) for group in (short, two) for q in group if q % 50 == 0 for n, (s, i) in enumerate(
        sorted(((65536 * (q * i + (group is two)), i) for i in group if i != q), key=lambda x: (-x[0], x[1]))))
    assert topk.top_k(few, few.where("vec_id % 50 = 0")).count() == 2
    assert topk.top_k(few.where("false"), few.where("false")).count() == 0 and topk.top_k(few, few.where("false")).count() == 0
