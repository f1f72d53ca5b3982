"""Suffix and common-prefix order of a shard by induced sorting, with queues that spill to disk.

Suffixes that start a descending-to-ascending turn (LMS) are ordered first; all others follow by induction. Scanning the sorted
suffixes, each hands its predecessor to the queue of the predecessor's first character; a queue is served when the scan reaches its
character. Tuples carry the position and the length of the common prefix with the tuple before it in the same queue, which is one
more than the least common prefix among the suffixes scanned between the two.

Common prefixes matter up to ``depth`` only. So LMS suffixes need an order by ``depth`` characters, which sorted
runs and a merging priority queue give directly; the recursion on names of LMS substrings is not needed.

A queue or run keeps up to ``memory`` bytes; beyond that its tuples lie in an unlinked file of the task.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

RUN_ROWS = 1 << 19  # LMS suffixes sorted at once
MEMORY = 64 << 20
FAR = 1 << 20


class Queue:
    """First in, first out; arrays of equal kinds go in and come out."""

    def __init__(self, memory: int):
        self.memory, self.held, self.size, self.spilled, self.file = memory, [], 0, [], None

    def put(self, *arrays: np.ndarray) -> None:
        self.held.append(arrays)
        self.size += sum(a.nbytes for a in arrays)
        if self.size > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            held = [np.concatenate(column) for column in zip(*self.held)]
            self.spilled.append((self.file.tell(), [(a.dtype, len(a)) for a in held]))
            for a in held:
                self.file.write(a.tobytes())
            self.held, self.size = [], 0

    def serve(self) -> Iterator[tuple[np.ndarray, ...]]:
        """All arrays in order, those that arrive meanwhile too."""
        while self.spilled or self.held:
            spilled, held = self.spilled, self.held
            self.spilled, self.held, self.size = [], [], 0
            for at, kinds in spilled:
                self.file.seek(at)
                yield tuple(np.frombuffer(self.file.read(k.itemsize * n), k) for k, n in kinds)
            if held:
                yield tuple(np.concatenate(column) for column in zip(*held))


def _turns(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is less than the next one (S), and the positions of LMS suffixes; the last one is S."""
    n = len(text)
    rises = np.zeros(n, bool)
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    differs = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    next_step = np.minimum.accumulate(differs[::-1])[::-1]  # where the run of equal characters ends
    rises[:-1] = np.append(step, 1)[next_step[:-1]] > 0
    rises[-1] = True
    return rises, np.flatnonzero(rises[1:] & ~rises[:-1]) + 1


def _keys(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    padded = np.append(text, np.zeros(depth, np.uint8))
    return np.lib.stride_tricks.sliding_window_view(padded, depth)[at]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading characters of rows of two arrays, up to a separator (0)."""
    stop = (a != b) | (a == 0)
    return np.where(stop.any(axis=1), stop.argmax(axis=1), a.shape[1]).astype(np.int32)


def sorted_lms(text: np.ndarray, lms: np.ndarray, depth: int, memory: int, run_rows: int = RUN_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """LMS positions by the first ``depth`` characters, with common prefixes, from sorted runs that a priority queue merges."""
    if len(lms) <= run_rows:
        parts: Iterator[np.ndarray] = iter([lms[np.argsort(_keys(text, lms, depth).view(f"S{depth}")[:, 0], kind="stable")]])
    else:
        parts = _merged(text, lms, depth, memory, run_rows)
    last = None
    for part in parts:
        for i in range(0, len(part), 1 << 16):
            at = part[i:i + (1 << 16)]
            keys = _keys(text, at, depth)
            before = np.concatenate([keys[:1] if last is None else last, keys[:-1]])
            common = _common(keys, before)
            if last is None:
                common[0] = 0
            last = keys[-1:].copy()
            yield at, common


def _merged(text: np.ndarray, lms: np.ndarray, depth: int, memory: int, run_rows: int) -> Iterator[np.ndarray]:
    def rows(run: Queue) -> Iterator[tuple[bytes, int]]:
        for (at,) in run.serve():
            keys = _keys(text, at, depth).view(f"S{depth}")[:, 0]
            yield from zip(keys.tolist(), at.tolist())

    runs = []
    for i in range(0, len(lms), run_rows):
        part = lms[i:i + run_rows]
        part = part[np.argsort(_keys(text, part, depth).view(f"S{depth}")[:, 0], kind="stable")]
        queue = Queue(memory // 64)
        for j in range(0, len(part), 4096):
            queue.put(part[j:j + 4096])
        runs.append(rows(queue))
    out: list[int] = []
    for _, at in heapq.merge(*runs):
        out.append(at)
        if len(out) == 1 << 16:
            yield np.array(out, np.int64)
            out = []
    yield np.array(out, np.int64)


class _Induction:
    """One scan: sorted suffixes come by, their predecessors go to queues."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int, memory: int):
        self.text, self.wanted, self.depth = text, wanted, depth
        self.queues = [Queue(memory // 64) for _ in range(256)]
        self.least = np.full(256, -1, np.int32)  # least common prefix since a queue's last tuple; -1 before its first

    def scan(self, at: np.ndarray, common: np.ndarray) -> None:
        if not len(at):
            return
        before = np.maximum(at - 1, 0)
        chars = np.where((at > 0) & self.wanted[before], self.text[before].astype(np.int16), -1)
        order = np.argsort(chars, kind="stable")
        kinds, starts = np.unique(chars[order], return_index=True)
        upto = np.minimum.accumulate(common)
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], FAR)
        old = self.least.copy()
        self.least = np.where(old < 0, old, np.minimum(old, upto[-1]))
        for c, a, b in zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            if c < 0:
                continue
            rows = order[a:b]
            new = np.empty(len(rows), np.int32)
            new[0] = 0 if old[c] < 0 else 1 + min(int(old[c]), int(upto[rows[0]]))
            if len(rows) > 1:
                new[1:] = 1 + np.minimum.reduceat(common[:rows[-1] + 1], rows[:-1] + 1)
            # a separator has nothing in common with another
            self.queues[c].put(before[rows], np.minimum(new, self.depth) if c else np.zeros_like(new))
            self.least[c] = min(FAR, int(after[rows[-1] + 1]))


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY, run_rows: int = RUN_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all suffixes but the last from the greatest to the least, with the common prefix of each and the one before.

    ``text`` is an array of bytes above 0 with 0 as separator, also at its end. The order is exact in the first ``depth`` characters up to
    a separator, and common prefixes count up to there.
    """
    rises, lms = _turns(text)
    seeds: dict[int, Queue] = {}
    for at, common in sorted_lms(text, lms, depth, memory, run_rows):
        firsts = text[at]
        cuts = np.flatnonzero(np.diff(firsts)) + 1
        for part, c in zip(np.split(at, cuts), np.split(common, cuts)):
            if len(part):
                seeds.setdefault(int(text[part[0]]), Queue(memory // 64)).put(part, c)

    def between(a: int, b: int) -> int:
        return int(_common(*(_keys(text, np.array([i]), depth) for i in (a, b)))[0])

    # Left to right: suffixes greater than their successors. What each character gets is kept for the way back.
    left = _Induction(text, ~rises, depth, memory)
    kept: list[Queue] = [Queue(memory // 64) for _ in range(256)]
    for c in range(256):
        last = None
        for at, common in left.queues[c].serve():
            kept[c].put(at, common)
            left.scan(at, common)
            last = int(at[-1])
        if c in seeds:
            for at, common in seeds[c].serve():
                if last is not None:
                    common = np.concatenate([[between(last, int(at[0]))], common[1:]]).astype(np.int32)
                    last = None
                left.scan(at, common)
    # Right to left: suffixes less than their successors, after them the ones of the first scan, backwards.
    right = _Induction(text, rises, depth, memory)
    for c in range(255, -1, -1):
        last = None
        for at, common in right.queues[c].serve():
            right.scan(at, common)
            yield at, common
            last = int(at[-1])
        parts = list(kept[c].serve())
        for i in range(len(parts) - 1, -1, -1):
            at = parts[i][0][::-1]
            head = np.array([0 if last is None else between(last, int(at[0]))], np.int32)
            common = np.concatenate([head, parts[i][1][:0:-1]])
            right.scan(at, common)
            yield at, common
            last = int(at[-1])


def repeats(text: np.ndarray, depth: int, memory: int = MEMORY, run_rows: int = RUN_ROWS) -> np.ndarray:
    """Positions whose ``depth`` characters also start at a smaller position, sorted."""
    out: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def close() -> None:
        group = np.concatenate(held) if len(held) > 1 else held[0]
        if len(group) > 1:
            out.append(group[group != group.min()])
        held.clear()

    for at, common in suffix_order(text, depth, memory, run_rows):
        cuts = np.flatnonzero(common < depth)
        first = int(cuts[0]) if len(cuts) else len(at)
        if first:
            held.append(at[:first])
        if not len(cuts):
            continue
        if held:
            close()
        ends = np.append(cuts[1:], len(at))
        inner, sizes = cuts[:-1], (ends - cuts)[:-1]
        if len(inner):
            body = at[cuts[0]:cuts[-1]]
            least = np.minimum.reduceat(body, inner - cuts[0])
            out.append(body[body != np.repeat(least, sizes)])
        held.append(at[cuts[-1]:])
    if held:
        close()
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
