"""Column expressions on text keys."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from moltabula.constants import FORBIDDEN_CHARACTERS
from moltabula.functions.vectors import bind

MARKS = "[" + re.escape("".join(FORBIDDEN_CHARACTERS)) + "]"
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def normalize_key(col: Column) -> Column:
    """Trimmed key without stereo marks and with single spaces; null when nothing is left."""
    no_marks = F.regexp_replace(col, MARKS, "")
    return blank_to_null(F.regexp_replace(no_marks, r"[ \t\n\r\x0B\f]+", " "))


def key_digest(col: Column) -> Column:
    """A fixed-width stand-in for a long key, so that shuffles do not move whole texts."""
    return F.sha2(col, 256)


def contains_any(col: Column, needles: Iterable[str] = FORBIDDEN_CHARACTERS) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(col, F.lit(needle))
    return hit


def clean_lines(col: Column) -> Column:
    """Stripped non-blank lines of a text, as an array."""
    lines = F.transform(F.split(col, "\n"), strip)
    return F.filter(lines, lambda line: line != "")


def tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits of any script; null input gives null."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda token: token != "")


def spaced_tokens(col: Column) -> Column:
    """The same words in one text, with single spaces between them and perhaps at its ends."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " ")


def char_grams(col: Column, n: int) -> Column:
    """All runs of ``n`` characters, case and signs kept; a shorter text gives itself, an empty one nothing.

    Keys that differ only in case or in a bond sign have different runs, which words would not show.
    """
    def runs(letters: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(letters, i, n), ""))

    return F.filter(bind(F.split(col, ""), runs), lambda gram: gram != "")
