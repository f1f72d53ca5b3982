"""Language identification with labelled spans.

Words are runs of letters. Script ranges narrow each word to the learned languages that use its script; hashed
character n-grams give the word a score for each of those; Viterbi over the words, with a penalty for each
switch, labels spans, so a text of several languages falls into spans of one language each.

The model is a table of ``2^FEATURE_BITS`` rows and one column for each language, fitted on a sample of
about ``SAMPLE_PER_LANGUAGE`` labelled documents of each language, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.llm.common import arrow_map, id_and_text, mix64, slices

SAMPLE_PER_LANGUAGE = 2000
FEATURE_BITS = 16
GRAMS = (2, 3, 4)
SWITCH_PENALTY = 12.0  # log-likelihood that a change of language must gain
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01  # a language uses a script that at least so much of its sample's words are in
SLICE = 2 << 20  # bytes of text labelled abreast
MIN_SCORE = 0.4  # least share of letters in spans of learned languages, all of them together, for a document to stay in a filter
REMEMBERED = 150_000  # words remembered in a task

# First code points of script ranges (fixed values of Unicode), each up to the next; number of the script.
_RANGES = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0900, 6), (0x0980, 7), (0x0E00, 8),
    (0x0E80, 7), (0x10A0, 9), (0x1100, 10), (0x1200, 7), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 11), (0x3130, 10),
    (0x3190, 12), (0xA000, 7), (0xAC00, 10), (0xD7B0, 7), (0xF900, 12), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFF00, 0), (0x20000, 12),
]
N_SCRIPTS = 13
_STARTS = np.array([a for a, _ in _RANGES], np.uint32)
_SCRIPTS = np.array([s for _, s in _RANGES], np.int64)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; number-like characters that are no letters are left out."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    clean = [w if w.isascii() or w.isalpha() else "".join([c for c in w if c.isalpha()]) for w in found]
    return [w for w in clean if w]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in one array, the word each belongs to, and each word's script and length."""
    codes = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = codes == 32
    owner = np.cumsum(space) - 1  # a word's letters and the space before it
    lengths = np.array([len(w) for w in words])
    features, owners = [], []
    value, broken = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for k in range(max(GRAMS)):
        size = len(codes) - k
        value, broken = value[:size], broken[:size]
        value = value * np.uint64(0x100000001B3) + codes[k:] + np.uint64(1)
        if k >= 2:
            broken = broken | space[k - 1:-1][:size]  # a space inside: the gram would cross into the next word
        if k + 1 in GRAMS:
            good = ~broken & ~(space[:size] & space[k:])
            features.append((mix64(value[good] + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
            owners.append(np.minimum(owner[:size][good], len(words) - 1))
    heads = np.flatnonzero(space)[:-1] + 1
    script = _SCRIPTS[np.searchsorted(_STARTS, codes[heads], side="right") - 1] if words else np.zeros(0, np.int64)
    return np.concatenate(features), np.concatenate(owners), script, lengths


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages, log-likelihood less the mean over languages
    scripts: np.ndarray  # scripts x languages, True where the language uses the script

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores words x languages, and whether any language uses the word's script."""
        features, owners, script, _ = word_features(words)
        scores = np.stack([np.bincount(owners, self.weights[features, j], len(words)) for j in range(len(self.languages))], axis=1)
        allowed = self.scripts[script]
        known = allowed.any(axis=1)
        # out of the running, as far as any sum of scores goes; a script of no learned language tells nothing
        scores[~allowed] -= 4 * SWITCH_PENALTY
        scores[~known] = 0
        return scores, known


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> F.Column:
    """True for rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from training rows with a language. Without any, the model knows no language.

    From a language with more rows a hash of the id picks about ``SAMPLE_PER_LANGUAGE``; whole texts are used.
    """
    labelled = docs.where(training_rows(docs, id_col) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << FEATURE_BITS, 0)), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, SAMPLE_PER_LANGUAGE / counts[lang])))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, 1):
                texts: dict[str, list[str]] = {}
                for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    texts.setdefault(lang, []).extend(words_of(text))
                for lang, words in texts.items():
                    if not words:
                        continue
                    features, _, script, _ = word_features(words)
                    f, s = sums.setdefault(lang, (np.zeros(1 << FEATURE_BITS, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                    f += np.bincount(features, minlength=1 << FEATURE_BITS)
                    s += np.bincount(script, minlength=N_SCRIPTS)
        for lang, (f, s) in sums.items():
            used = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + N_SCRIPTS)), pa.array(np.concatenate([used, -1 - np.arange(N_SCRIPTS)]).astype(np.int32)), pa.array(np.concatenate([f[used], s]))],
                ["lang", "feature", "n"])

    # at most 2^FEATURE_BITS rows for each language, whatever the sample
    rows = sample.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    column = {lang: j for j, lang in enumerate(languages)}
    langs = np.array([column[x] for x in rows["lang"].to_pylist()], np.int64)
    feature, n = rows["feature"].to_numpy(), rows["n"].to_numpy()
    table, scripts = np.full((1 << FEATURE_BITS, len(languages)), SMOOTHING), np.zeros((N_SCRIPTS, len(languages)))
    is_gram = feature >= 0
    table[feature[is_gram], langs[is_gram]] += n[is_gram]
    scripts[-1 - feature[~is_gram], langs[~is_gram]] = n[~is_gram]
    weights = np.log(table / table.sum(axis=0))
    used = scripts / np.maximum(1, scripts.sum(axis=0)) >= SCRIPT_SHARE
    return Model(languages, weights - weights.mean(axis=1, keepdims=True), used)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language of each word for texts that follow each other in ``scores``, all texts abreast.

    Staying costs nothing and any change costs ``penalty``, so the best way into a language is from itself or from
    the best language before. Ties stay, else go to the first language.
    """
    out = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts longer than t
    if not len(alive):
        return out
    best = scores[starts[:alive[0]]].copy()
    own = np.arange(scores.shape[1], dtype=np.uint8 if scores.shape[1] <= 256 else np.int32)
    came = np.empty(scores.shape, own.dtype)  # for each word and language, the language of the word before
    ends = {}
    for t in range(1, len(alive)):
        n = alive[t]
        if n < len(best):
            ends[t - 1] = np.argmax(best[n:], axis=1)
            best = best[:n]
        top = np.argmax(best, axis=1)
        reach = best[np.arange(n), top] - penalty
        moved = reach[:, None] > best
        came[starts[:n] + t] = np.where(moved, top[:, None], own)
        best = np.where(moved, reach[:, None], best) + scores[starts[:n] + t]
        best -= best.max(axis=1, keepdims=True)
    state = np.argmax(best, axis=1)
    for t in range(len(alive) - 1, -1, -1):
        if t in ends:
            state = np.concatenate([state, ends[t]])
        out[starts[:alive[t]] + t] = state
        if t:
            state = came[starts[:alive[t]] + t, state]
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for each row of ``docs``.

    ``spans`` lists ``language:first word:end word``, comma-joined, word numbers from 0, ends exclusive. ``lang_pred`` is the language of the spans with
    the most letters (first in order among equals), ``und`` for a text that is null, empty or without letters, or with a model of no languages. ``score`` is the share of all letters
    that lie in its spans and in a script that some learned language uses; 0 for ``und``. Null and repeated ids are handled row by row; other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2^FEATURE_BITS rows, one column for each language

    def parts(batch: pa.RecordBatch, state: _Words) -> pa.Table:
        found = pa.Table.from_batches([_identify(part, state) for part in slices(batch, 1, SLICE)])
        return found.select(["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans string"
    return arrow_map(id_and_text(docs, id_col, text_col), parts, schema, lambda: _Words(shared.value))


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text has no language: ``und``, or a share of letters below ``min_score`` in spans of any learned language.

    Only letters in a script that some learned language uses count, as in the score of ``identify``; how they fall on languages does not matter. A row without ``lang`` gets the predicted one. All other columns pass through. A model of no languages rejects nothing.
    """
    if not model.languages:
        return docs
    names = docs.columns
    text, lang = names.index(text_col), names.index(lang_col) if lang_col in names else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def parts(batch: pa.RecordBatch, state: _Words) -> pa.Table:
        out = []
        for part in slices(batch, text, SLICE):
            filled = pa.RecordBatch.from_arrays([part.column(text), part.column(text).fill_null("")], ["id", "text"])
            found = _identify(filled, state)
            columns = list(part.columns)
            if lang is not None:
                columns[lang] = pc.coalesce(columns[lang], found.column(1).cast(columns[lang].type))
            good = pc.and_(pc.not_equal(found.column(1), "und"), pc.greater_equal(found.column("known"), min_score))
            out.append(pa.RecordBatch.from_arrays(columns, names=names).filter(good))
        return pa.Table.from_batches(out)

    return arrow_map(docs.select([F.col(f"`{c}`") for c in names]), parts, docs.schema, lambda: _Words(shared.value))


class _Words:
    """Scores of the words met so far in a task."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.known = np.zeros(0, bool)

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self.clear()
        new = list(set().union(*texts).difference(self.index)) if texts else []
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            scores, known = self.model.word_scores(new)
            self.scores, self.known = np.concatenate([self.scores, scores]), np.concatenate([self.known, known])
        index = self.index
        return np.array([index[w] for words in texts for w in words], np.int64)


def _identify(batch: pa.RecordBatch, state: _Words) -> pa.RecordBatch:
    """The columns of ``identify`` and ``known``, the share of letters in spans of any learned language."""
    languages = state.model.languages
    texts = [words_of(t) if languages else [] for t in batch.column(1).to_pylist()]
    lengths = np.array([len(w) for w in texts], np.int64)
    at = state.look_up(texts)
    labels = viterbi(state.scores[at], lengths)
    letters = np.array([len(w) for words in texts for w in words], np.float64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    n = max(1, len(languages))
    total = np.bincount(doc, letters, len(texts))
    by_lang = np.bincount(doc * n + labels, letters, len(texts) * n).reshape(-1, n)
    sure = np.bincount(doc * n + labels, letters * state.known[at], len(texts) * n).reshape(-1, n)
    best = by_lang.argmax(axis=1)
    share = sure[np.arange(len(texts)), best] / np.maximum(1, total)
    known = sure.sum(axis=1) / np.maximum(1, total)
    names = [languages[b] if t else "und" for b, t in zip(best, total)]
    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    stops = np.append(cut[1:], len(doc)) if len(cut) else cut
    begins = np.cumsum(lengths) - lengths
    spans: list[list[str]] = [[] for _ in texts]
    for a, b in zip(cut.tolist(), stops.tolist()):
        d = doc[a]
        spans[d].append(f"{languages[labels[a]]}:{a - begins[d]}:{b - begins[d]}")
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(names), pa.array(share), pa.array([",".join(s) for s in spans]), pa.array(known)],
        ["doc_id", "lang_pred", "score", "spans", "known"])
