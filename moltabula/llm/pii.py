"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, schemes, digits and cue words. From each
anchor a local parser walks to the boundaries of the find and validates it. Every base find holds an at-sign or a digit
and lies within a run of its own characters around it, so looking only there gives what the patterns give over the whole text.

Base kinds, leftmost and non-overlapping within each kind, failing ones dropped: ``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits, Luhn),
``phone`` (10 to 15 digits). Added kinds: ``url`` (after a scheme), ``iban`` (valid check digits), ``ssn`` and ``account`` (after a cue word).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from moltabula.llm.common import arrow_map, id_and_text, slices

# Fixed values of the contract.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "ssn", "account")
KINDS = BASE_KINDS + ADDED_KINDS
MASKED_KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account")
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "social security", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ZONE = re.compile(r"[0-9+\x20().-]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
_AFTER_CUE = re.compile(r"[\s:#=.]{1,3}(?:(?:number|no|nr|num)[\s:#=.]{1,3})?", re.IGNORECASE)
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9])")


@dataclass(frozen=True)
class Span:
    start: int
    kind: str
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    body = text.replace(" ", "")
    turned = body[4:] + body[:4]
    return 15 <= len(body) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, for texts whose ASCII letters are in lower case."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for cue in ACCOUNT_CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def _byte(digits: str) -> bool:
    """At most 255; Python refuses to convert very long numbers."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def _zone_spans(text: str, at: int, end: int) -> Iterator[Span]:
    """Base finds that start with a digit or plus within one run of number characters."""
    for m in _IP.finditer(text, at, end):
        if all(_byte(p) for p in m[0].split(".")):
            yield Span(m.start(), "ip", m.end())
    for m in _CARD.finditer(text, at, end):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield Span(m.start(), "card", m.end())
    for m in _PHONE.finditer(text, at, end):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield Span(m.start(), "phone", m.end())


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All finds of a text by start, then kind; offsets in code points, ends exclusive."""
    spans: list[Span] = []
    mail_end = zone_end = url_end = cue_end = 0
    # bytes know lower case of ASCII only, so all offsets stay
    for last, (what, size) in anchors.iter(text.encode().lower().decode()):
        if what == "digit":
            if last >= zone_end:
                zone_end = _ZONE.match(text, last).end()
                spans += _zone_spans(text, last - (last > 0 and text[last - 1] == "+"), zone_end)
        elif what == "at":
            start = last
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            rest = _DOMAIN.match(text, last + 1) if start < last else None
            if rest:
                mail_end = rest.end()
                spans.append(Span(start, "email", mail_end))
        elif what == "scheme":
            rest = _URL_REST.match(text, last + 1)
            start = last - size + 1
            if rest and start >= url_end:
                url_end = rest.end() - (text[rest.end() - 1] in ".,;:!?")
                spans.append(Span(start, "url", url_end))
        else:
            gap = _AFTER_CUE.match(text, last + 1)
            if gap and gap.end() >= cue_end:
                for kind, pattern in (("ssn", _SSN), ("iban", _IBAN), ("account", _ACCOUNT)):
                    m = pattern.match(text, gap.end())
                    if m and (kind != "iban" or iban_valid(m[0])):
                        cue_end = m.end()
                        spans.append(Span(m.start(), kind, cue_end))
                        break
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join([f"{s.kind}:{s.start}:{s.end}" for s in spans])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: one row for each row of ``docs``.

    Null text counts as empty and has no finds; ``base_sha256`` is then the digest of an empty text. Null and repeated ids are
    handled row by row, other columns are left out. Work is linear in the text.
    """

    def run(batch: pa.RecordBatch, anchors: ahocorasick.Automaton) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = find_spans(text, anchors)
            base = [s for s in spans if s.kind in BASE_KINDS]
            counts = [sum(s.kind == k for s in base) for k in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    def parts(batch: pa.RecordBatch, anchors: ahocorasick.Automaton) -> pa.Table:
        return pa.Table.from_batches([run(part, anchors) for part in slices(batch, 1)])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return arrow_map(id_and_text(docs, id_col, text_col), parts, schema, automaton)


def masked_text(text: str, anchors: ahocorasick.Automaton) -> str:
    """The text with each find of a masked kind as ``<KIND>``; overlapping finds go under the name of the first."""
    out, at = [], 0
    for s in find_spans(text, anchors):
        if s.kind not in MASKED_KINDS:
            continue
        if s.start >= at:
            out += [text[at:s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if at else text


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with finds masked in the text, and its length in code points brought up to date where that column exists.

    Null text stays null. All other columns and rows pass through.
    """
    names = docs.columns
    place = names.index(text_col)
    size = names.index(length_col) if length_col in names else None
    schema = StructType([StructField(f.name, LongType()) if i == size else f for i, f in enumerate(docs.schema.fields)])

    def run(batch: pa.RecordBatch, anchors: ahocorasick.Automaton) -> pa.RecordBatch:
        texts = [t if t is None else masked_text(t, anchors) for t in batch.column(place).to_pylist()]
        columns = list(batch.columns)
        columns[place] = pa.array(texts, pa.string())
        if size is not None:
            old = batch.column(size).to_pylist()
            columns[size] = pa.array([n if t is None else len(t) for n, t in zip(old, texts)], pa.int64())
        return pa.RecordBatch.from_arrays(columns, names=names)

    def parts(batch: pa.RecordBatch, anchors: ahocorasick.Automaton) -> pa.Table:
        return pa.Table.from_batches([run(part, anchors) for part in slices(batch, place)])

    return arrow_map(docs.select([F.col(f"`{c}`") for c in names]), parts, schema, automaton)
