"""Cases that the operators once lost."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from cases import documents
from moltabula.llm import bpe, langid, minhash, pii, urls
from test_llm_pairs import plain_components
from test_llm_text import plain_viterbi

FOLDER = "/root/testdata/sf0.01"


def test_cues_in_any_case():
    anchors = pii.automaton()
    for cue in pii.ACCOUNT_CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title(), cue.swapcase(), cue[:-1] + cue[-1].upper()):
            for word in ("", " number", " Number", " NO.", " Nr", " NUM"):
                text = f"É İ {form}{word}: 123-45-6789 and {form}{word} 12345678"
                a, b = text.index("123-"), text.index("12345678")
                assert pii.joined(pii.find_spans(text, anchors)) == f"ssn:{a}:{a + 11},account:{b}:{b + 8}"
    assert pii.masked_text("Social Security Number 123-45-6789, ACCOUNT NO. 12345678", anchors) == "Social Security Number <SSN>, ACCOUNT NO. <ACCOUNT>"
    assert pii.joined(pii.find_spans("HTTP://a.example http://b.example", anchors)) == "url:17:33"


def test_dotted_numbers_of_any_length():
    anchors, long = pii.automaton(), "1" * 5000
    for text in (f"{long}.1.1.1", f"1.1.1.{long}", f"1.{long}.1.1"):
        assert pii.find_spans(text, anchors) == []
    found = pii.find_spans(f"{long}.1.1.1 x {'0' * 5000}.0.0.255 x 1.2.3.256 x 001.02.3.0255", anchors)
    assert [(s.kind, s.end - s.start) for s in found] == [("ip", 5008), ("ip", 13)]


def test_balanced_languages_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    # of each language a run of words from a training text, cut to the same number of letters
    best = docs.where(langid.training_rows(docs)).where("lang is not null and n_chars > 500").orderBy("doc_id").collect()
    parts = {}
    for r in best:
        words, letters = [], 0
        for w in langid.words_of(r.text):
            if letters + len(w) <= 300:
                words, letters = [*words, w], letters + len(w)
        if r.lang not in parts and letters >= 295:
            parts[r.lang] = " ".join(words)
    langs = sorted(parts)[:4]
    planted = [(1, " ".join(parts[x] for x in langs[:3]), None), (2, " ".join(parts[x] for x in langs), None), (3, "\u13a0\u13a1\u13a2 " * 50 + "the", None), (4, "1 2 3", None)]
    rows = spark.createDataFrame(planted, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert found[1].score < langid.MIN_SCORE and len({s.split(":")[0] for s in found[1].spans.split(",")}) >= 3
    assert {r.doc_id for r in langid.keep_identified(rows, model).collect()} == {1, 2}


def test_every_text_of_an_id_is_compared(spark):
    """Links of a repeated id to documents that are not the least of any bucket they share."""
    rng, rows = random.Random(7), []
    for i in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

        def changed(places):
            return " ".join([f"c{rng.randrange(10**6)}" if j in places else w for j, w in enumerate(base)])
        x, y = changed({20, 60}), changed({100, 140})
        shingler = minhash.Shingler()
        kx, ky = (set(minhash.bands(minhash.minima(shingler.sets([t.encode()])[0])).tolist()) for t in (x, y))
        both, least = kx & ky, set()
        while not both <= least:  # smaller ids in each bucket that the two share, themselves linked with neither
            text = changed(set(rng.sample([j for j in range(5, 195) if j not in (20, 60, 100, 140)], 9)))
            keys = set(minhash.bands(minhash.minima(shingler.sets([text.encode()])[0])).tolist())
            if keys & both - least:
                least |= keys
                rows.append((len(rows) + 1, text))
        rows += [(5000, x), (6000 + i, y)]
    rows += [(5000, ""), (6000, " "), (7000, ""), (7000, "alone in the world it was then")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    assert {c for i, n, c, _ in got if 5000 <= i < 6999 and n} == {5000}
    assert got == sorted(plain_components(rows).elements())


def test_confirmed_reads_every_text_of_an_id(spark):
    a, b = ("one two three four five six", "red green blue black white grey")
    texts = spark.createDataFrame([(1, a), (1, b), (1, ""), (2, b), (3, a), (4, ""), (4, "far away from it all")], "doc_id long, text string").coalesce(1)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long").coalesce(1)
    assert sorted(map(tuple, minhash.confirmed(pairs, texts).collect())) == [(1, 2), (1, 3)]


def test_ids_do_not_depend_on_other_texts():
    mojibake = "CafÃ© is here"
    unusual = "(Café)\nCafé " + "\u0e01 b " * 900
    want = None
    for order in ([[mojibake, unusual]], [[unusual, mojibake]], [[mojibake], [unusual]], [[unusual], [mojibake]]):
        encoder = bpe.Bpe(bpe.default_path("byte_bpe_50k.json"))
        got = {t: np.frombuffer(raw, np.uint32).tolist() for texts in order for t, raw in zip(texts, encoder.encode_batch(texts))}
        want = want or {t: encoder.library.encode(t, add_special_tokens=False).ids for t in got}
        assert got == want


def test_rules_reach_hosts_beyond_the_basic_plane(spark):
    pages = [(i, f"http://\U0001f600{i % 3}.net/x") for i in range(300)] + [(1000 + i, f"http://a{i}.org/x") for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = urls.judge(df, urls.rule_table(spark, [urls.Rule("block", "net", "/")]), n_ranges=7).collect()
    assert {(r.page_id < 1000, r.verdict) for r in rows} == {(True, "block"), (False, "allow")} and len(rows) == 350


def test_cut_points_are_even(spark):
    heads = spark.range(20_000).selectExpr("concat('h', lpad(id, 5, '0'), '.') key", "1L n")
    for n in (7, 100):
        cuts = urls._cut_points(heads, n)
        assert cuts == sorted(cuts) and len(cuts) in (n - 1, n - 2)
        sizes = np.diff([0, *[int(c[1:6]) for c in cuts], 20_000])
        assert sizes.max() < 2.5 * 20_000 / n


def test_pages_without_id_spread_over_the_ranges_of_a_hot_host(spark):
    pages = [(None, f"https://hot.example.net/p{i}") for i in range(3000)] + [(i, f"https://h{i}.org/") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = urls.judge(df, urls.rule_table(spark, [urls.Rule("block", "net", "/p1")]), n_ranges=8)
    got = rows.collect()
    assert len(got) == 3300 and sum(r.verdict == "block" for r in got) == sum(f"p{i}".startswith("p1") for i in range(3000))
    sizes = [len(part) for part in rows.rdd.glom().collect()]
    assert max(sizes) < 1500


def test_schemes_in_any_case():
    anchors = pii.automaton()
    text = "see HTTP://Example.org/x and Https://b.example, not xhttp:/a.b"
    assert pii.joined(pii.find_spans(text, anchors)) == "url:4:24,url:29:46"


# -- language ID, from the words on ------------------------------------------------------------------


def plain_words(text):
    """Runs of characters that are letters, in lower case. Digits and underscores part words, other number characters vanish."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum() and unicodedata.category(c) != "Nd":
            word += c if c.isalpha() else ""
        elif word:
            words.append(word)
            word = ""
    return words


def plain_grams(word):
    """Hashes of all runs of 2 to 4 characters of the word between two spaces, but not of runs from space to space."""
    padded, found = f" {word} ", []
    for size in (2, 3, 4):
        for i in range(len(padded) - size + 1):
            gram = padded[i:i + size]
            if gram[0] == " " and gram[-1] == " ":
                continue
            value = 0
            for c in gram:
                value = (value * 0x100000001B3 + ord(c) + 1) % 2**64
            value = (value + size - 1) % 2**64
            for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xD1B54A32D192ED03)):
                value = (value ^ value >> shift) * factor % 2**64
            found.append((value ^ value >> 32) >> (64 - 16))
    return found


def plain_script(word):
    return [number for first, number in langid._RANGES if first <= ord(word[0])][-1]


def plain_fit(rows):
    grams, scripts = {}, {}
    for doc_id, text, lang in rows:
        if lang is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            own, used = grams.setdefault(lang, Counter()), scripts.setdefault(lang, Counter())
            for word in plain_words(text or ""):
                own.update(plain_grams(word))
                used[plain_script(word)] += 1
    languages = sorted(grams)
    sums = {k: sum(grams[k].values()) + 0.5 * 2**16 for k in languages}
    allowed = {k: {s for s, n in scripts[k].items() if n >= 0.01 * max(1, sum(scripts[k].values()))} for k in languages}
    return languages, grams, sums, allowed


def plain_identify(text, languages, grams, sums, allowed):
    words = plain_words(text or "")
    if not words or not languages:
        return "und", 0.0, "", 0.0
    scores, known = [], []
    for word in words:
        fits = [plain_script(word) in allowed[k] for k in languages]
        known.append(any(fits))
        row = [0.0] * len(languages)
        if any(fits):
            for g in plain_grams(word):
                logs = [math.log((grams[k][g] + 0.5) / sums[k]) for k in languages]
                row = [r + v - sum(logs) / len(logs) for r, v in zip(row, logs)]
            row = [r if f else r - 48.0 for r, f in zip(row, fits)]
        scores.append(row)
    labels = plain_viterbi(scores, 12.0)
    letters, sure = Counter(), Counter()
    for word, j, k in zip(words, labels, known):
        letters[j] += len(word)
        sure[j] += len(word) * k
    best = max(range(len(languages)), key=lambda j: letters[j])
    cuts = [i for i in range(len(words)) if i == 0 or labels[i] != labels[i - 1]] + [len(words)]
    spans = ",".join(f"{languages[labels[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:]))
    total = sum(letters.values())
    return languages[best], sure[best] / total, spans, sum(sure.values()) / total


def test_language_of_every_text_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    learned = plain_fit(rows)
    texts = [(i, t) for i, t, _ in rows] + [(r[0], r[1]) for r in documents() if len(r[1] or "") < 20_000]
    texts += [(90_001, "the cat and the dog were there " * 9 + "и это было в городе " * 9 + "der hund und die katze nicht " * 9), (90_002, "x²y 12 a_b ④c")]
    model = langid.fit(docs)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = langid.identify(df, model).collect()
    assert len(got) == len(texts)
    want = Counter((i, *(p if j != 1 else round(p, 9) for j, p in enumerate(plain_identify(t, *learned)[:3]))) for i, t in texts)
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9), r.spans) for r in got) == want
    full = df.withColumn("lang", df.text.substr(1, 0))
    kept = Counter(r.doc_id for r in langid.keep_identified(full, model).collect())
    plain = [(i, plain_identify(t, *learned)) for i, t in texts]
    assert kept == Counter(i for i, p in plain if p[0] != "und" and p[3] >= langid.MIN_SCORE)
