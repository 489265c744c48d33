"""Letters and words of whole Arrow batches of texts as folded code points, in numpy.

The hashes here name features of models, which share far fewer slots; that some very long words have one hash matters
no more than that they share a slot.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from qanat.llm.words import mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


#: The planes that hold letters and marks.
ASSIGNED = (range(0x40000), range(0xE0000, 0xE1000))


@functools.cache
def folded() -> np.ndarray:
    """For each code point its lower case, or 32 if it is no letter or mark."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in chain(*ASSIGNED):
        if unicodedata.category(ch := chr(c))[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter; marks alone are none."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for c in chain(*ASSIGNED):
        out[c] = unicodedata.category(chr(c))[0] == "L"
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse; the longest ones are kept."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers


class Chars:
    """All texts of a column in one array of code points, each text followed by one space; null texts are empty."""

    def __init__(self, texts: pa.Array):
        raw = [t or "" for t in texts.to_pylist()]
        self.raw = np.frombuffer("".join(t + " " for t in raw).encode("utf-32-le", "replace"), np.uint32)
        self.points = folded()[self.raw]
        self.edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw]))).astype(np.int64)
        self.row = np.repeat(np.arange(len(raw)), np.diff(self.edges))

    def has_letter(self) -> np.ndarray:
        return np.bincount(self.row[letters()[self.raw]], minlength=len(self.edges) - 1) > 0

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each n-gram that holds a letter first or last; runs of other characters are single spaces."""
        keep = np.ones(len(self.points), bool)
        keep[1:] = (self.points[1:] != 32) | (self.points[:-1] != 32) | (self.row[1:] != self.row[:-1])
        p, row = self.points[keep].astype(np.uint64), self.row[keep]
        m = max(0, len(p) - n + 1)
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(_BASE) + p[i : i + m]
        fine = (row[:m] == row[n - 1 : n - 1 + m]) & ((p[:m] != 32) | (p[n - 1 : n - 1 + m] != 32))
        return mix(h[fine]), row[:m][fine]

    def words(self, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each word, a run of letters, and of each longer word's prefixes of the given lengths."""
        full = self.points != 32
        edge = np.diff(np.concatenate(([0], full.astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(self.points) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.points.astype(np.uint64) * up[: len(self.points)], dtype=np.uint64)))
        of = lambda a, b, salt: mix((sums[b] - sums[a]) * down[a] ^ np.uint64(salt << 56))
        out, rows = [of(starts, ends, 0)], [self.row[starts]]
        for k in prefixes:
            long = starts[ends - starts > k]
            out.append(of(long, long + k, k))
            rows.append(self.row[long])
        return np.concatenate(out), np.concatenate(rows)
