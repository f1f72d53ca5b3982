"""Similarity of two texts by the edits between them, with a bound from the counts of their characters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: str, b: str) -> int:
    """Least number of inserted, removed and replaced characters, by bit vectors as long as ``a``.

    Bit i of ``up`` (``down``) tells that the distance grows (falls) from the first i to the first i + 1 characters of ``a``.
    """
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = every, 0, len(a)
    for c in b:
        equal = at.get(c, 0)
        keeps = equal | down
        same = (((equal & up) + up) ^ up) | equal
        rises, falls = down | ~(same | up) & every, up & same
        distance += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & every, (falls << 1) & every
        up, down = falls | ~(keeps | rises) & every, rises & keeps
    return distance


def edit_similarity(a: str, b: str) -> float:
    """One minus the distance over the longer length; two empty texts are alike."""
    longer = max(len(a), len(b))
    return 1 - edit_distance(a, b) / longer if longer else 1.0


def character_features(text: Column, letters: str) -> list[Column]:
    """Length, and the count of each of some characters."""
    return [F.length(text), *[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in letters]]


def edit_bound(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Greatest ``edit_similarity`` with a text whose ``character_features`` lie in a box.

    An edit removes at most one surplus character and brings at most one that is short, so either sum bounds the distance from below.
    """
    surplus = np.maximum(own[1:] - high[:, 1:], 0).sum(axis=1)
    short = np.maximum(low[:, 1:] - own[1:], 0).sum(axis=1)
    longer = np.maximum(own[0], high[:, 0])
    length = np.maximum(np.maximum(own[0] - high[:, 0], low[:, 0] - own[0]), 0)
    least = np.maximum(np.maximum(surplus, short), length)
    return 1 - least / np.maximum(longer, 1) + 1e-12
