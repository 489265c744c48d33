"""Words and hashes of whole Arrow batches of texts, in numpy.

A word is a run of bytes other than ASCII white space. Hashes are 64 bit; with ``fold`` A-Z count as a-z. Words of over
``SHORT`` bytes are hashed by BLAKE2, all others in whole columns.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to about this many bytes at a time; a longer text is taken alone, whole.
STEP = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, bool)
_POINT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_BASE = 0x9E3779B97F4A7C15
#: Words of more bytes than this are known by a digest; shorter ones by their bytes, eight at a time.
SHORT = 64
#: _FIRST[n]: a mask of the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some texts in one buffer: bytes, and where each text's words start and end; null texts are empty."""

    def __init__(self, texts: pa.Array, cut_points: bool = False):
        """cut_points: words end as well between a letter, ASCII or of Latin-1, and ASCII punctuation but the apostrophe."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inner = self.offsets[:-1]
        inner = inner[inner < len(self.bytes)]
        full = ~_SPACE[self.bytes]
        after = np.ones(len(full) + 1, bool)  # at i: byte i - 1 doesn't continue into i
        after[1:-1] = ~full[:-1]
        after[inner] = True
        before = np.ones(len(full) + 1, bool)  # at i: byte i - 1 is the last of its run
        before[1:-1] = ~full[1:]
        before[inner] = True
        if cut_points and len(full) > 1:
            begins, ends = _LETTER[self.bytes], _LETTER[self.bytes]
            pair = (self.bytes[:-1] == 0xC3) & (self.bytes[1:] != 0x97) & (self.bytes[1:] != 0xB7)
            begins[:-1] |= pair
            ends[1:] |= pair
            point = _POINT[self.bytes]
            cut = (ends[:-1] & point[1:]) | (point[:-1] & begins[1:])
            after[1:-1] |= cut
            before[1:-1] |= cut
        self.starts = np.flatnonzero(full & after[:-1])
        self.ends = np.flatnonzero(full & before[1:]) + 1
        #: first[i]: number of the first word of text i
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self, fold: bool) -> np.ndarray:
        """64 bits of each word. Every step is a bijection of eight bytes, so no structure within words can cancel out."""
        data = np.zeros(len(self.bytes) + 8, np.uint8)
        data[:-8] = _LOWER[self.bytes] if fold else self.bytes
        eight = np.ndarray((len(self.bytes) + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
        sizes = self.ends - self.starts
        out = mix(sizes.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
        own = np.flatnonzero(sizes <= SHORT)
        at, rest = self.starts[own], sizes[own]
        while len(own):
            out[own] = mix(out[own] ^ (eight[at] & _FIRST[np.minimum(rest, 8)]))
            more = rest > 8
            own, at, rest = own[more], at[more] + 8, rest[more] - 8
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = int.from_bytes(hashlib.blake2b(data[self.starts[i] : self.ends[i]].data, digest_size=8).digest(), "little")
        return out


def give_back() -> None:
    """Hands memory that was freed back to the system: a worker lives on after its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def row_slices(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``step`` bytes of text; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + batch.num_rows + 1])
        part = np.cumsum(sizes) // step
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
        del batch, sizes
    give_back()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", cut_points: bool = False, step: int = STEP) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """``row_slices`` with their texts."""
    for own in row_slices(batches, column, step):
        yield own, Texts(own.column(column), cut_points)


def is_long(texts: pa.Array, step: int | None = None) -> bool:
    """Whether this is one text of more bytes than ``text_pieces`` takes at a time."""
    return len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > (STEP if step is None else step)


def text_pieces(texts: pa.Array, step: int | None = None) -> Iterator[pa.Array]:
    """One text in pieces of about ``step`` bytes, each an array of its own; all but the first begin with white space."""
    step = STEP if step is None else step
    data = np.frombuffer(texts[0].as_buffer(), np.uint8)
    at = 0
    while at < len(data):
        stop = min(at + step, len(data))
        while stop < len(data):  # on to white space
            gap = np.flatnonzero(_SPACE[data[stop : stop + step]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(stop + step, len(data))
        yield pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, stop - at], np.int64)), pa.py_buffer(data[at:stop]))
        at = stop


def shingle_sets(texts: Texts, width: int) -> Iterator[np.ndarray]:
    """For each text, its distinct word n-grams as ascending hashes; a text of fewer words is one n-gram, one of none is empty."""
    words = texts.hashes(fold=True)
    k = np.uint64(_BASE)
    grams = words[: max(0, len(words) - width + 1)].copy()
    for i in range(1, width):
        grams = grams * k + words[i : i + len(grams)]
    grams = mix(grams ^ np.uint64(width))
    for a, b in zip(texts.first[:-1], texts.first[1:], strict=True):
        n = b - a
        if n >= width:
            x = np.sort(grams[a : b - width + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x
        elif n:
            whole = words[a : a + 1]
            for i in range(a + 1, b):
                whole = whole * k + words[i : i + 1]
            yield mix(whole ^ np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
