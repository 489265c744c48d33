"""Ranked lexical search by sort-based accumulation: every item's best documents, in whole-number impacts.

Items are taken in blocks of a bounded number of (item, term) pairs; a block is sent to all tasks. One pass over the
texts counts every document's terms and keeps, as arrays, the terms that the block asks for (a posting). Postings are
written once; document frequencies, the number of documents and their length come from them, over all documents.

The second pass scores. In each task, for documents of up to ``CHUNK`` matches at a time, the arrays of (item, document,
impact) are concatenated, keys of item and document are radix sorted, equal keys' impacts are summed by ``reduceat``,
and a heap of ``k`` an item takes what reaches the item's k-th best so far. A document lies in one row, so its sums are
complete in its task: what is exchanged is ``k`` rows an item and task, ranged by item, first for ``FAN`` tasks at a
time, then all.

Terms are compared by 64 bits of hash; all other steps are exact. Texts are read a slice of about ``STEP`` bytes at a
time, a long one in parts that end at separators, so memory is bounded by the slice, the block and the longest term.

Defined cases: a null or termless text is no document; items without terms have no rows, and rows that share an item's
id are one item with the terms of all of them, null being an id like any other; rows that share a document's id are
documents of their own; null ids come after others of equal score; an empty table on either side gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.llm.sums import SCHEMA, pieces, summed
from qanat.llm.words import Texts
from qanat.session import checkpointed, text_batches, written

#: Bytes of text read at a time; (item, term) pairs of a block, about; matches scored at a time; tasks merged at a time.
STEP, PAIRS, CHUNK, FAN = 1 << 20, 1_000_000, 1 << 21, 64
#: Bytes of terms as they are, with A-Z lower-cased; all others become spaces.
_TERM = np.full(256, 32, np.uint8)
_TERM[128:] = np.arange(128, 256)
for _c in (string.digits + string.ascii_lowercase).encode():
    _TERM[_c] = _c
for _c in string.ascii_uppercase.encode():
    _TERM[_c] = _c + 32
POSTING = "id long, n long, terms binary, counts binary"
#: What a task yields: the item's number in its block.
FOUND = "number int, doc_id long, score long"


def term_slices(texts: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The texts in slices (first row, texts in terms and spaces); a text of over STEP bytes comes in several slices."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)

    def part(edges: np.ndarray) -> Texts:
        own = _TERM[data[edges[0] : edges[-1]]]
        return Texts(pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges - edges[0])), pa.py_buffer(own)))

    row = 0
    while row < len(texts):
        to = int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1
        if to > row:
            yield row, part(offsets[row : to + 1])
            row = to
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at < end:
            stop = min(at + STEP, end)
            while stop < end:  # on to a separator
                gap = np.flatnonzero(_TERM[data[stop : min(stop + STEP, end)]] == 32)
                stop = stop + int(gap[0]) if len(gap) else min(stop + STEP, end)
                if len(gap):
                    break
            yield row, part(np.array([at, stop], np.int64))
            at = stop
        row += 1


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, term, n): how often an item holds a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in term_slices(batch.column(1)):
                terms = texts.hashes(fold=False).view(np.int64)
                owner = row + np.repeat(np.arange(len(texts.first) - 1), np.diff(texts.first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(terms)], ["item", "term"])

    found = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item long, term long")
    return found.groupBy("item", "term").agg(F.count("*").alias("n"))


class Block:
    """Items by number, and for each of their terms, in order of hash, the items that hold it, and how often."""

    def __init__(self, pairs: pa.Table):
        items = pairs.column("item").to_pylist()
        self.ids = sorted(set(items), key=lambda x: (x is None, x or 0))
        number = {x: i for i, x in enumerate(self.ids)}
        term = pairs.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[order], return_index=True)
        self.ends = np.append(first, len(term)).astype(np.int64)
        self.items = np.array([number[x] for x in items], np.int32)[order]
        self.repeats = pairs.column("n").to_numpy()[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.terms & np.uint64(0xFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms, and the terms' numbers."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFF)])
        number = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        hit = self.terms[number] == hashes[at]
        return at[hit], number[hit]


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """int32 values, so many a row, as a binary column."""
    ends = np.concatenate(([0], np.cumsum(sizes * 4))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.astype(np.int32))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``binaries`` packed: values, and how many a row."""
    if not len(column):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int32) if ends[-1] > ends[0] else np.zeros(0, np.int32)
    return values, np.diff(ends) // 4


def postings(block: Block) -> Callable:
    """Texts -> one posting for each that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, texts in term_slices(batch.column(1)):
                n[row : row + len(texts.first) - 1] += np.diff(texts.first)
                at, number = block.find(texts.hashes(fold=False))
                owner = row + np.searchsorted(texts.first, at, "right") - 1
                key, count = np.unique(owner << 32 | number, return_counts=True)
                keys.append(key)
                counts.append(count)
            key, where = np.unique(np.concatenate(keys), return_inverse=True)  # parts of one long text
            count = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)
            sizes = np.bincount(key >> 32, minlength=batch.num_rows)
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(some)), pa.array(n[some]), binaries(key & 0xFFFFFFFF, sizes[some]), binaries(count, sizes[some])],
                ["id", "n", "terms", "counts"],
            )

    return run


def frequencies(size: int) -> Callable:
    """Postings -> the task's document frequencies, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0))[0], minlength=size)
        yield from pieces(total)

    return run


def impacts(terms: np.ndarray, counts: np.ndarray, doc: np.ndarray, n: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each (document, term) adds to the score of an item that holds the term once."""
    sizes, where = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in sizes], np.int64)[where]
    tf = counts.astype(np.int64)
    return weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys from 0 to ``most``, 16 bits at a time from the lowest; numpy sorts 16 bits by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        order = order[np.argsort((keys >> shift & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def take(self, keys: np.ndarray, scores: np.ndarray, docs: list[int | None]) -> None:
        """Of whole scores by ascending key (item * len(docs) + place in docs)."""
        item = keys // len(docs)
        edges = np.concatenate(([0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            i = int(item[a])
            own = scores[a:b]
            least = int(self.least[i])
            if b - a > self.k:
                least = max(least, int(np.partition(own, b - a - self.k)[b - a - self.k]))
            for j in np.flatnonzero(own >= least).tolist():
                doc = docs[int(keys[a + j] % len(docs))]
                entry = (int(own[j]), doc is not None, -(doc or 0))
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
            if len(self.heaps[i]) == self.k:
                self.least[i] = self.heaps[i][0][0]

    def rows(self) -> pa.RecordBatch:
        found = [(i, -doc if known else None, score) for i, heap in enumerate(self.heaps) for score, known, doc in heap]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["number", "doc_id", "score"])


def scores(block: Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable:
    """Postings -> the task's k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        fan = np.diff(block.ends)
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            terms, sizes = unpacked(batch.column(2))
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = impacts(terms, unpacked(batch.column(3))[0], doc, n, weight, n_docs, n_terms)
            upto = np.cumsum(np.bincount(doc, fan[terms], len(ids)).astype(np.int64))  # matches of the documents up to each
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, "right")))
                x, y = np.searchsorted(doc, [a, b])
                times = fan[terms[x:y]]
                held = np.arange(times.sum()) + np.repeat(block.ends[terms[x:y]] - np.cumsum(times) + times, times)
                if len(held):
                    key = block.items[held].astype(np.int64) * (b - a) + np.repeat(doc[x:y] - a, times)
                    order = radix_order(key, len(block.ids) * (b - a))
                    key = key[order]
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    total = np.add.reduceat((np.repeat(impact[x:y], times) * block.repeats[held])[order], first)
                    best.take(key[first], total, ids[a:b])
                a = b
        yield best.rows()

    return run


def merged(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each ``by``, ranked; ranges of items, so equal shares meet in a task."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.repartitionByRange(*by).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    asked = checkpointed(item_terms(items, item_text, item_key))
    texts = text_batches(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    blocks = max(1, math.ceil(asked.count() / pairs))
    out: DataFrame | None = None
    for number in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)  # about ``pairs`` rows
        block = Block(own.toArrow())
        if not len(block.terms):
            continue
        held = written(texts.mapInArrow(postings(block), POSTING), "postings")
        all_ = held.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).head()
        df = summed(held.select("terms").mapInArrow(frequencies(len(block.terms)), SCHEMA), len(block.terms))
        weight = np.array([math.floor(1000 * math.log((2 * all_["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = held.mapInArrow(scores(block, weight, all_["docs"], all_["terms"] or 1, k), FOUND)
        found = checkpointed(found.withColumn("part", F.floor(F.spark_partition_id() / FAN)))  # k rows an item and task, sampled for ranges and then read
        found = merged(found, k, "number", "part").drop("rank")
        named = spark.createDataFrame(pa.table({"number": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, pa.int64())}))
        top = merged(found, k, "number").join(F.broadcast(named), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
