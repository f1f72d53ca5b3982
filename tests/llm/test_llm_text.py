"""Language, tokens, personal data and urls against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents
from moltabula.llm import bpe, langid, packing, pii, tokenfiles, urls

FOLDER = "/root/testdata/sf0.01"
BYTE, WORD = bpe.default_path("byte_bpe_50k.json"), bpe.default_path("word_bpe_49k.json")


def texts():
    return [r[1] or "" for r in documents()]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_is_the_library_s(path):
    rng = random.Random(1)
    alphabet = ["ab", "the and ing", "éßñ 0123'sre\n\t  ", "x", "日本語のテスト", "<|endoftext|>", "İΣJ̌ǰ \x0b\x1c\x85", "🙂👍🏽 z"]
    many = texts() + ["".join(rng.choice(rng.choice(alphabet)) for _ in range(rng.choice([1, 9, 200]))) for _ in range(200)]
    encoder = bpe.Bpe(path, leaf=64, window=1)
    for text, raw in zip(many, encoder.encode_batch(many)):
        assert np.frombuffer(raw, np.uint32).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_tree_joins_grow_until_they_agree():
    encoder, rng = bpe.Bpe(BYTE, leaf=32, window=1), random.Random(2)
    for text in ["a" * 2000, "ab" * 1500, "".join(rng.choice("etaoinshr") for _ in range(5000)), "é" * 900]:
        mapped = encoder._mapped(text)
        assert encoder.tree(mapped) == encoder._bare_ids([mapped])[0]


def test_round_trip_rows(spark, docs, none):
    got = Counter(tuple(r) for r in bpe.round_trip_digests(docs, BYTE).collect())
    library = bpe.load(BYTE).library
    want = Counter()
    for row in documents():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in documents())
    assert bpe.round_trip_digests(none, BYTE).count() == 0


def test_token_files(spark, docs, none):
    got = tokenfiles.token_file_round_trip(spark, docs, WORD, 2).collect()
    library, want, start = bpe.load(WORD).library, [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in documents()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfiles.token_file_round_trip(spark, none, WORD, 2).count() == 0


def check_packing(rows, docs, window):
    library = bpe.load(WORD).library
    want = Counter()
    for r in docs:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r[0], len(ids)] += len(ids)
    got, sequences = Counter(), {}
    by_id = {}
    for r in docs:
        by_id.setdefault(r[0], []).append(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in by_id[r.doc_id])
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window


def test_packing(spark, docs, none):
    for window in (2048, 128):
        check_packing(packing.pack(docs, WORD, 1, window).collect(), documents(), window)
    assert packing.pack(none, WORD).count() == 0


def test_least_squares_and_plan():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, (12, 40)).astype(float)
    y = rng.integers(0, 50, 12).astype(float)
    x = packing.nonnegative_least_squares(a, y)
    slope = a.T @ (y - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 0]).max() < 1e-6
    histogram = {int(s): int(rng.integers(1, 900)) for s in range(1, 129)}
    used = Counter()
    for parts, n in packing.plan(histogram, 128):
        assert n > 0 and sum(s * m for s, m in parts.items()) <= 128
        for s, m in parts.items():
            used[s] += m * n
    assert used == Counter(histogram) and packing.plan({}, 128) == []


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_personal_data(spark, docs, none):
    rng, anchors = random.Random(4), pii.automaton()
    pieces = ["a@b.co", "@", ".", "+", "1", "22", "4111 1111 1111 1111", "10.0.0.1", " ", "-", "(", ")", "x", "é", "+44 20 7946 0958", "acct: ", "IBAN GB82 WEST 1234 5698 7654 32", "https://a.b/c"]
    for text in texts() + ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(4000)]:
        spans = pii.find_spans(text, anchors)
        assert pii.joined([s for s in spans if s.kind in pii.BASE_KINDS]) == plain_base(text)
    found = pii.joined(pii.find_spans("my iban GB82 WEST 1234 5698 7654 32, SSN: 123-45-6789, account no. 12345678, https://a.example/x?y.", anchors))
    assert found == "iban:8:35,ssn:42:53,account:67:75,url:77:98"
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(documents()) and pii.personal_data(none).count() == 0
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows if r.doc_id in (1, 2, 21)} == {1: (1, 0, 0, 1), 2: (0, 0, 0, 0), 21: (1, 1, 1, 0)}


def test_mask_keeps_rows_and_columns(spark, docs, none):
    rows = pii.mask(docs)
    assert rows.columns == docs.columns and rows.count() == docs.count() and pii.mask(none).count() == 0
    by_id = {r.doc_id: r for r in rows.collect()}
    assert by_id[1].text == "Hello there, this is a plain text. Write to <EMAIL> or call <PHONE> now." and by_id[1].n_chars == len(by_id[1].text)
    assert by_id[2].text is None


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r.host) + len(r.path), r.host + r.path, r.verdict) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("n_ranges", [1, 2, 7, 50])
def test_urls(spark, n_ranges):
    rng = random.Random(5)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "example.com", "Example.COM", "xexample.net", "org", "a-b.org", "", ".", "net.", "é.org"]
    pages = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/de/', '?q=/en/', '#/en/'])}") for i in range(300)]
    pages += [(None, "http://a.example.net/en/"), (900, None), (901, "no scheme"), (902, ""), (3, "http://net/")] + [(1000 + i, "http://hot.example.net/en/1") for i in range(300)]
    rules = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "a.example.net", "/en/x"),
             urls.Rule("allow", "a.example.net", "/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/"), urls.Rule("block", "", "/")]
    df = spark.createDataFrame([(*p, "key", 1, 2) for p in pages], "page_id long, url string, key string, range int, kind int")
    got = urls.judge(df, urls.rule_table(spark, rules), n_ranges=n_ranges).collect()
    # an empty host is the parent of nothing but itself
    want = Counter((i, *plain_verdict(u, rules)) for i, u in pages)
    assert Counter(map(tuple, got)) == want
    assert urls.judge(df.where("false"), urls.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in urls.judge(df, urls.rule_table(spark, [])).collect()} == {"allow"}


def plain_viterbi(scores, penalty):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda j: best[j])
        moves = [top if best[top] - penalty > best[j] else j for j in range(len(best))]
        best = [max(best[j], best[top] - penalty) + row[j] for j in range(len(best))]
        back.append(moves)
    path = [max(range(len(best)), key=lambda j: best[j])]
    for moves in reversed(back):
        path.append(moves[path[-1]])
    return path[::-1]


def test_viterbi():
    rng = np.random.default_rng(6)
    lengths = np.array([0, 1, 5, 40, 0, 200, 7])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got, at = langid.viterbi(scores, lengths, 4.0), 0
    for n in lengths:
        if n:
            assert got[at:at + n].tolist() == plain_viterbi(scores[at:at + n].tolist(), 4.0)
        at += n


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    held = docs.where(~langid.training_rows(docs))
    rows = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100
    mixed = spark.createDataFrame([(1, "the thing is that they were there with other things and then the " * 3 + "der und die nicht schen ichen verein lichkeit und das zung der " * 3)], "doc_id long, text string")
    assert {s.split(":")[0] for s in langid.identify(mixed, model).first().spans.split(",")} >= {"en", "de"}


def test_language_awkward_rows(spark, docs, none):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(documents())
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (2, 3, 4, 14)) and by_id[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {2, 3, 4, 14} & {r.doc_id for r in kept.collect()}
    unlabelled = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(docs, unlabelled).collect()} == {"und"}
    assert langid.keep_identified(docs, unlabelled).count() == docs.count() and langid.identify(none, model).count() == 0
