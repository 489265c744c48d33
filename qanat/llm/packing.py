"""Packing of tokenised documents into sequences of bounded length, by best-fit decreasing.

Every document's ids, with one end id, are first cut into full windows, which are sequences of their own and need no
shuffle; what remains is shorter than a window. A document has one remainder at most, so remainders are dealt evenly,
by hash of their place in the table, into pools cut from the number of documents; a pool's size does not grow with the
input. In a pool they are placed longest first, each into the open sequence with the least room that takes it, found by
a segment tree over remaining capacities. Padding is left only in a pool's last sequences. Full windows have odd
sequence ids, filled ones even ids.

Tokenising works on each batch's distinct words, in lower case: runs without ASCII white space, cut as well between a
letter and punctuation other than the apostrophe. The tokeniser folds case and cuts in all these places itself. Words'
ids are looked up and joined by array operations. An added token of the tokeniser (such as <|endoftext|>) is one id and
may reach over such cuts, so a run without white space that holds one is encoded as a whole. The tokeniser stays as its
file sets it. A long text is read in pieces that end before white space.

Defined cases: a null text is empty and holds the end id only; repeated rows are packed each; rows with null ids are
packed as any other; an empty table gives an empty result; further columns of any name are kept apart.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm.words import Texts, is_long, row_slices, text_pieces
from qanat.session import checkpointed, text_batches

LENGTH, END = 2048, 1
#: Documents, and so remainders at most, of a pool, in expectation.
POOL = 40_000
#: Words that the tokeniser gets at a time.
AT_ONCE = 8192
#: Bytes of text whose distinct words are taken together.
STEP = 1 << 20
WHITE = b" \t\n\x0b\x0c\r"
SPACE = re.compile(b"[ \t-\r]")
#: Distinct words whose ids a Python worker keeps.
KEEP = 600_000

_ids: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of whole texts by one tokeniser, through those of their distinct words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known words, ascending, and their numbers
        self.flat, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Hashes ascend and are not known."""
        for i in range(0, len(words), AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + AT_ONCE], add_special_tokens=False)]
            used, own = int(self.starts[-1]), hashes[i : i + AT_ONCE]
            ends = np.cumsum([len(x) for x in ids]) + used
            while ends[-1] > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[used : ends[-1]] = list(chain.from_iterable(ids))
            at = np.searchsorted(self.hashes, own)
            self.hashes = np.insert(self.hashes, at, own)
            self.place = np.insert(self.place, at, np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(own)))
            self.starts = np.concatenate((self.starts, ends))

    def by_words(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """As ``of``, for texts without added tokens."""
        if len(self.hashes) > KEEP:
            self.clear()
        distinct, first, inverse = np.unique(texts.hashes(fold=True), return_index=True, return_inverse=True)
        if not len(distinct):
            return self.flat[:0], np.zeros(len(texts.first), np.int64)
        new = np.flatnonzero(~np.isin(distinct, self.hashes, assume_unique=True))
        if len(new):
            data = texts.bytes.tobytes()
            spans = zip(texts.starts[first[new]].tolist(), texts.ends[first[new]].tolist(), strict=True)
            self.learn(distinct[new], [data[a:b].decode("utf-8", "replace") for a, b in spans])
        at = self.place[np.searchsorted(self.hashes, distinct)][inverse]
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        source = np.repeat(self.starts[at] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[source], ends[texts.first]

    def spans(self, texts) -> list[tuple[int, int]]:
        """The runs without white space that hold an added token, in any case, in order; none reaches over a text's end."""
        data = texts.bytes.tobytes().lower()
        found: set[tuple[int, int]] = set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                text = int(np.searchsorted(texts.offsets, at, "right")) - 1
                low, high = int(texts.offsets[text]), int(texts.offsets[text + 1])
                if at + len(token) <= high:
                    run = SPACE.search(data, at, high)
                    end = run.start() if run else high
                    begin = max(low, max(data.rfind(bytes([c]), low, at) for c in WHITE) + 1)
                    found.add((begin, end))
                at = data.find(token, at + 1)
        return sorted(found)

    def of(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start and end."""
        if not (special := self.spans(texts)):
            return self.by_words(texts)
        cuts = np.unique(np.concatenate((texts.offsets, np.array(special, np.int64).ravel())))
        parts = type(texts)(pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(texts.bytes))), True)
        ids, edges = self.by_words(parts)
        data, lengths, out, at = texts.bytes.tobytes(), np.diff(edges), [], 0
        for a, b in special:
            i = int(np.searchsorted(cuts, a))
            own = np.array(self.tokenizer.encode(data[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, ids.dtype)
            out += [ids[at : edges[i]], own]
            lengths[i], at = len(own), edges[i + 1]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return np.concatenate([*out, ids[at:]]), ends[np.searchsorted(cuts, texts.offsets)]

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``of``, for an array of texts; one long text is read in pieces."""
        if not is_long(column):
            return self.of(Texts(column, True))
        ids = np.concatenate([self.of(Texts(piece, True))[0] for piece in text_pieces(column)])
        return ids, np.array([0, len(ids)])


def word_ids(path: str) -> WordIds:
    """One for each Python worker and tokeniser."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


class Room:
    """A segment tree over remaining capacities 0 .. length: the least capacity of at least n that an open sequence has."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)  # open sequences below
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        i = room + self.leaves
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(sequence, room) with the least room >= n, taken out."""
        i = n + self.leaves
        while not self.tree[i]:
            while i & 1:  # up, until a right neighbour is left
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.open[room].pop()
        while i:
            self.tree[i] -= 1
            i >>= 1
        return sequence, room


def best_fit_decreasing(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given; the caller orders pieces."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, opened = Room(length), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = room.take(n) if n < length else None
        if found is None:
            found, opened = (opened, length), opened + 1
        sequence[i], offset[i] = found[0], length - found[1]
        if found[1] > n:
            room.add(found[0], found[1] - n)
    return sequence, offset


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids cut into full windows and a remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = word_ids(path), np.array([end], "<u4").tobytes()
        for batch in row_slices(batches, step=STEP):
            ids, edges = known.column(batch.column("text"))
            ids = ids.astype("<u4")
            out: list[list] = [[], [], [], [], [], []]
            for row, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                total = b - a + 1
                for start in range(0, total, length):
                    part = ids[a + start : min(b, a + start + length)].tobytes() + (last if start + length >= total else b"")
                    for to, v in zip(out, (row, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None), strict=True):
                        to.append(v)
            columns = [batch.column("doc_id").take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:5])]
            if with_ids:
                columns.append(pa.array(out[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return text_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset; the ids of a sequence are its pieces' ids in order of offset."""
    pools = max(1, math.ceil(docs.count() / pool))
    cut = checkpointed(pieces(docs, path, length, end, with_ids).withColumn("place", F.monotonically_increasing_id()))  # read twice, tokenised once
    names = [c for c in cut.columns if c != "place"]

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("place", "ascending")])
        sequence, offset = best_fit_decreasing(rows.column("length").to_numpy(), length)
        own = rows.column("pool")[0].as_py()
        return rows.select(names).append_column("sequence_id", pa.array(2 * (sequence * pools + own), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    full = cut.filter(F.col("length") == length).select(*names, (F.col("place") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < length).withColumn("pool", F.pmod(F.xxhash64("place"), F.lit(pools)).cast("int"))
    schema = ", ".join(f"{n} {t}" for n, t in [*[t for t in cut.dtypes if t[0] in names], ("sequence_id", "long"), ("offset", "long")])
    return rest.groupBy("pool").applyInArrow(fill, schema).unionByName(full)
