"""N-gram Jaccard join: components of documents whose word n-gram sets are similar, exact.

A document's set holds the 64-bit hashes of its distinct word n-grams, in the global order of the hashes. Documents of
equal sets form a class, known by 64 bits of its set's digest (of 10^9 classes, two share theirs with a chance of 3%);
only classes are joined. The join runs in four steps:

1. Pruning. Two linked sets share at least ``l`` n-grams within the first ``|x| - ceil(t |x|) + l`` of each, in any
   global order. The heads of that length are dealt out by hash range as packed arrays, and a class goes on only if
   enough of its head is shared with another class. No text of a document without near copies goes further: the few
   that do are found by a broadcast of their ids, or by a join beyond ``ALIVE`` of them.
2. Blocks. The n-grams of what is left are counted, and the order becomes rarest first, so a passage that many unlike
   documents hold comes last and ties none of them. Linked sets share one n-gram of their prefixes in this order too;
   classes that share one are tied, and ties form blocks. Every link lies in a block.
3. Prefix-tree join of each block, in bins of bounded size (``trie``).
4. A block of over ``LARGE`` classes or ``BIN`` n-grams is never gathered. Each class is first compared with a few
   pivots of the block, which connects most of a large group of near copies. Then the classes outside the block's
   largest component meet all others, in cells of bounded size; pairs within a component need no comparison.

Holders of one n-gram are combined before every exchange: a task sends one entry for each n-gram that it has gathered,
not one for each holder, so an n-gram that a third of all documents hold makes no task large.

Defined cases: null and empty texts, and texts without words, have empty sets and link with nothing; rows with null ids
get a set size and a null component, and take no part; rows that share an id count as linked; repeated rows are one
class; an empty table gives an empty result; further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.llm import trie
from qanat.llm.components import components
from qanat.llm.words import shingle_sets, slices
from qanat.session import checkpointed, cleared, small_side, text_batches

#: N-grams that one task of a counting step holds at most, in expectation.
SPREAD = 500_000
#: N-grams of a bin of blocks, and of a cell's side, in expectation; classes of a block that are joined in one task.
BIN, LARGE = 500_000, 2_000
#: Classes of a cell's side, against pivots and against each other.
NEAR, SIDE = 250, 1_500
PIVOTS = 4
#: The most frequent n-grams whose counts every task knows: a broadcast of 8 bytes each.
KNOWN = 1 << 18
#: N-grams gathered in a task before they are combined and dealt out.
GATHER = 500_000
#: Classes that pruning leaves whose ids are broadcast to find their texts, and to tell their sets the block.
ALIVE = 1_000_000
#: Rows that go whose ids are broadcast.
GONE = 1_000_000


def needed(n, percent: int):
    """ceil(t n): what a set of n shares at least with any set that it links with."""
    return (n * percent + 99) // 100


def head(n, percent: int):
    return np.minimum(n, 2 * (n - needed(n, percent) + 1))


def shared_at_least(n, percent: int):
    """Of its head, what a set of n shares at least with the head of any set that it links with."""
    m = needed(n, percent)
    return head(m, percent) - (m - needed(m, percent) + 1) + 1


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def number(d: bytes) -> int:
    return int.from_bytes(d[:8], "big", signed=True)


def set_sizes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest) of each row; an empty set has a null digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = list(shingle_sets(texts, width))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) if len(x) else None for x in sets], pa.binary())], ["doc_id", "n", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary")


class Gathered:
    """Sets of a task, combined by n-gram once there are enough of them."""

    def __init__(self) -> None:
        self.owners: list[int] = []
        self.sets: list[np.ndarray] = []
        self.n = 0

    def add(self, owner: int, x: np.ndarray) -> bool:
        """Whether there are enough."""
        self.owners.append(owner)
        self.sets.append(x)
        self.n += len(x)
        return self.n >= GATHER

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by hash, owners ascending: hashes, owners, start and length of each run of one hash. Starts anew."""
        x = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.array(self.owners, np.int64), [len(v) for v in self.sets])
        self.__init__()
        return runs(x, owner)


def runs(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, owner) pairs sorted by both: hashes, owners, start and length of each run of one hash."""
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])))
        hashes, owners = hashes[new], owners[new]
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return hashes, owners, starts, np.diff(np.append(starts, len(hashes)))


def ranges(x: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges each unsigned hash lies in."""
    return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def by_range(where: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """(to, packed columns): a row for each range that has values."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True]))) if len(where) else np.zeros(1, np.int64)
    packed = [pa.array([c[order][a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(where[edges[:-1]], pa.int32()), *packed], ["to", *[f"c{i}" for i in range(len(columns))]])


def by_owner(where: np.ndarray, owners: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """As by_range of columns sorted by range and owner, with each owner once: (to, owners, their numbers of values, values)."""
    first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (owners[1:] != owners[:-1])))) if len(where) else np.zeros(0, np.int64)
    heads = by_range(where[first], owners[first], np.diff(np.append(first, len(where))).astype(np.uint32))
    rest = by_range(where, values)
    return sparse(pa.RecordBatch.from_arrays([*heads.columns, rest.column("c0")], ["to", "c0", "c1", "c2"]), "c0", "c1", "c2")


def sparse(rows: pa.RecordBatch, *names: str) -> pa.RecordBatch:
    """(to, columns) as (to, c0, c1, c2, c3), the columns under the names and the others empty."""
    own = dict(zip(names, rows.columns[1:], strict=True))
    empty = pa.array([b""] * rows.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([rows.column(0), *(own.get(c, empty) for c in ("c0", "c1", "c2", "c3"))], ["to", "c0", "c1", "c2", "c3"])


def unpacked(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)


def buckets_for(n: int) -> int:
    return max(1, math.ceil(n / SPREAD))


def shared_heads(docs: DataFrame, width: int, percent: int, buckets: int, sums: int) -> DataFrame:
    """(class, shared): of a class's head, no fewer n-grams than the heads of other classes hold.

    A class counts the n-grams that it shares within its task at once; for every n-gram, a task sends one holder, and
    whether it has more. A bucket's counts go on packed, one row for each of the ``sums`` ranges of classes. Copies of
    a class may lie in several tasks: an n-gram that none of them sends was counted in each, so the least count holds.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def combined() -> Iterator[pa.RecordBatch]:
            own = np.unique(np.array(gathered.owners, np.int64))
            hashes, owners, starts, lengths = gathered.take()
            who, n = np.unique(owners[np.repeat(lengths > 1, lengths)], return_counts=True)
            here = np.zeros(len(own), np.int64)
            here[np.searchsorted(own, who)] = n
            hashes, owners, more = hashes[starts], owners[starts], lengths > 1
            where = ranges(hashes, buckets)
            order = np.lexsort((owners, where))
            order = order[~more[order]]
            yield by_owner(where[order], owners[order], hashes[order].astype(np.uint32))
            yield sparse(by_range(where[more], hashes[more].astype(np.uint32)), "c3")
            counts = by_range(ranges(own.view(np.uint64), sums), own, here.astype(np.uint32))
            yield sparse(counts.set_column(0, "to", pa.array([-1 - t for t in counts.column("to").to_pylist()], pa.int32())), "c0", "c1")

        seen: set[int] = set()
        gathered = Gathered()
        for _, texts in slices(batches):
            for x in shingle_sets(texts, width):
                if len(x) and (own := number(digest(x))) not in seen:
                    seen.add(own)
                    if gathered.add(own, x[: int(head(len(x), percent))]):
                        yield from combined()
        yield from combined()

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        to = key[0].as_py()
        if to < 0:  # counts within tasks
            classes, n = unpacked(rows, "c0", np.int64), unpacked(rows, "c1", np.uint32)
            order = np.lexsort((n, classes))
            first = np.unique(classes[order], return_index=True)[1]
            out = by_range(np.full(len(first), -1 - to), classes[order][first], n[order][first])
        else:
            ids, at = np.unique(unpacked(rows, "c0", np.int64), return_inverse=True)
            at = np.repeat(at.astype(np.uint64), unpacked(rows, "c1", np.uint32))
            pairs = np.unique(unpacked(rows, "c2", np.uint32).astype(np.uint64) << np.uint64(32) | at)  # copies of a class count once
            hashes = (pairs >> np.uint64(32)).astype(np.uint32)
            starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(pairs) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(pairs)))
            shared = (lengths > 1) | np.isin(hashes[starts], unpacked(rows, "c3", np.uint32))
            n = np.bincount((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.repeat(shared, lengths)], minlength=len(ids))
            who, n = ids[n > 0], n[n > 0]
            out = by_range(ranges(who.view(np.uint64), sums), who, n.astype(np.uint32))
        return pa.Table.from_batches([out])

    def add(rows: pa.Table) -> pa.Table:
        who, at = np.unique(unpacked(rows, "c0", np.int64), return_inverse=True)
        n = np.bincount(at, unpacked(rows, "c1", np.uint32), len(who))
        return pa.table({"class": pa.array(who, pa.int64()), "shared": pa.array(n.astype(np.int64), pa.int64())})

    packed = docs.select("text").mapInArrow(deal, "to int, c0 binary, c1 binary, c2 binary, c3 binary").groupBy("to").applyInArrow(count, "to int, c0 binary, c1 binary")
    return packed.groupBy("to").applyInArrow(add, "class long, shared long").filter("shared > 0")


def each_set(rows: DataFrame, run: Callable[[Iterator[tuple[int, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over the (id, set) pairs of each task of (id, grams)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            for own, x in zip(b.column("id").to_pylist(), b.column("grams"), strict=True):
                yield own, np.frombuffer(x.as_buffer(), np.uint64)

    return rows.select("id", "grams").mapInArrow(lambda batches: run(pairs(batches)), schema)


def upper(x: np.ndarray) -> np.ndarray:
    """The upper halves of hashes, by which n-grams are counted for their order: any order of n-grams is a right one."""
    return (x >> np.uint64(32)).astype(np.uint32)


def frequent(sets: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent upper halves of n-grams, KNOWN at most, ascending, and how often sets hold each."""

    def deal(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        def combined() -> pa.RecordBatch:
            hashes, _, starts, lengths = gathered.take()
            return by_range(ranges(hashes[starts], buckets), upper(hashes[starts]), lengths.astype(np.uint32))

        gathered = Gathered()
        for own, x in pairs:
            if gathered.add(own, x):
                yield combined()
        yield combined()

    def count(rows: pa.Table) -> pa.Table:
        hashes, at = np.unique(unpacked(rows, "c0", np.uint32), return_inverse=True)
        n = np.bincount(at, unpacked(rows, "c1", np.uint32), len(hashes)).astype(np.int64)
        hashes, n = hashes[n > 1], n[n > 1]
        level = np.floor(np.log2(np.maximum(n, 1)) * 4).astype(np.int64)
        out = [(int(v), int((level == v).sum()), hashes[level == v].tobytes(), n[level == v].astype(np.uint32).tobytes()) for v in np.unique(level)]
        return pa.table({"level": pa.array([o[0] for o in out], pa.int32()), "n": pa.array([o[1] for o in out], pa.int64()), "hashes": pa.array([o[2] for o in out], pa.binary()), "counts": pa.array([o[3] for o in out], pa.binary())})

    counts = checkpointed(each_set(sets, deal, "to int, c0 binary, c1 binary").groupBy("to").applyInArrow(count, "level int, n long, hashes binary, counts binary"))
    least, room = 1 << 30, KNOWN
    for r in counts.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # four levels for each power of two
        if (room := room - r["n"]) < 0:
            break
        least = r["level"]
    found = counts.filter(F.col("level") >= least).select("hashes", "counts").collect()
    hashes, n = np.frombuffer(b"".join(r[0] for r in found), np.uint32), np.frombuffer(b"".join(r[1] for r in found), np.uint32)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def ties(sets: DataFrame, known: tuple[np.ndarray, np.ndarray], percent: int, buckets: int) -> DataFrame:
    """(u, v): links between classes that share an n-gram of the prefixes, rarest first: from each to the smallest one.

    Holders within a task are linked there, and their smallest one is sent.
    """
    shared = sets.sparkSession.sparkContext.broadcast(known)

    def links(owners: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
        least = np.repeat(owners[starts], lengths)
        return np.unique(np.stack([owners, least], 1)[owners != least], axis=0).tobytes()

    def deal(pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        def combined() -> Iterator[pa.RecordBatch]:
            hashes, owners, starts, lengths = gathered.take()
            yield by_range(ranges(hashes[starts], buckets), hashes[starts], owners[starts])
            found = links(owners, starts, lengths)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(owners[0]) % buckets] if found else [], pa.int32()), *(pa.array([v] if found else [], pa.binary()) for v in (found, b""))], ["to", "c0", "c1"])

        hashes, counts = shared.value
        gathered = Gathered()
        for own, x in pairs:
            n = np.zeros(len(x), np.uint32)
            if len(hashes):
                own_half = upper(x)
                at = np.minimum(np.searchsorted(hashes, own_half), len(hashes) - 1)
                n = np.where(hashes[at] == own_half, counts[at], n)
            if gathered.add(own, x[np.argsort(n, kind="stable")[: len(x) - int(needed(len(x), percent)) + 1]]):
                yield from combined()
        yield from combined()

    def tie(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            pairs = unpacked(rows, "c0", np.int64)
        else:
            _, owners, starts, lengths = runs(unpacked(rows, "c0", np.uint64), unpacked(rows, "c1", np.int64))
            pairs = np.frombuffer(links(owners, starts, lengths), np.int64)
        pairs = pairs.reshape(-1, 2)
        return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})

    return each_set(sets, deal, "to int, c0 binary, c1 binary").groupBy("to").applyInArrow(tie, "u long, v long")


def joined(rows: DataFrame, by: str, percent: int) -> DataFrame:
    """The prefix-tree join of each group of (by, id, part, grams, label, stored, probing), part by part: (u, v) links."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part").to_numpy()
        ids, labels = group.column("id").to_numpy(), group.column("label").to_numpy()
        stored, probing = (group.column(c).to_numpy(zero_copy_only=False) for c in ("stored", "probing"))
        grams = group.column("grams")
        out: list[tuple[int, int]] = []
        order = np.lexsort((ids, part))
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            own = own[np.concatenate(([True], (np.diff(ids[own]) != 0) | (stored[own][1:] != stored[own][:-1]) | (probing[own][1:] != probing[own][:-1])))]  # repeated rows
            sets = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in own]
            whole = bool(stored[own].all() and probing[own].all())
            out += [(int(ids[own[i]]), int(ids[own[j]])) for i, j in trie.join(sets, labels[own], percent, *(() if whole else (stored[own], probing[own])))]
        return pa.table({"u": pa.array([p[0] for p in out], pa.int64()), "v": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy(by).applyInArrow(run, "u long, v long")


def roles(stored: bool, probing: bool) -> list[Column]:
    return [F.lit(stored).alias("stored"), F.lit(probing).alias("probing")]


def chunk(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), n)


def large_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Links within blocks that no task may gather, of (id, grams, block, members, size); see step 4 above."""
    parts = lambda n, side: F.greatest(F.lit(1), F.ceil(n / side), F.ceil(n / F.col("members") * F.col("size") / BIN))
    chunks = parts(F.col("members"), NEAR)
    by_hash = [F.min(F.struct(F.xxhash64("id", F.lit(i)), "id"))["id"].alias(f"p{i}") for i in range(PIVOTS)]
    pivots = checkpointed(sets.groupBy("block").agg(*by_hash).select("block", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("id")))
    all_to = sets.select("id", "grams", chunk(chunks, 11).alias("cell"), "block", *roles(False, True))
    pivots_to = sets.join(pivots, ["block", "id"], "left_semi").select("id", "grams", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("cell"), "block", *roles(True, False))
    first = all_to.unionByName(pivots_to).select(F.xxhash64("block", "cell").alias("group"), "id", F.col("block").alias("part"), "grams", F.col("id").alias("label"), "stored", "probing")
    links = checkpointed(joined(first, "group", percent))

    roots = components(links)
    named = sets.join(roots, F.col("id") == F.col("node"), "left").select("id", "grams", "block", "members", "size", F.coalesce("root", "id").alias("label"))
    kin = named.groupBy("block", "label").agg(F.count("*").alias("n"))
    main = checkpointed(kin.groupBy("block").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select(F.col("block").alias("b"), F.col("top.label").alias("main"), (F.col("all") - F.col("top.n")).alias("others")).filter("others > 0"))
    named = named.join(main, F.col("block") == F.col("b"))
    chunks, sides = parts(F.col("members"), SIDE), parts(F.col("others"), SIDE)
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    store = named.select("id", "grams", "label", "block", chunk(chunks, 12).alias("x"), span(sides).alias("y"), *roles(True, False))
    probe = named.filter("label <> main").select("id", "grams", "label", "block", span(chunks).alias("x"), chunk(sides, 13).alias("y"), *roles(False, True))
    cells = store.unionByName(probe).select(F.xxhash64("block", "x", "y").alias("group"), "id", F.col("block").alias("part"), "grams", "label", "stored", "probing")
    return links.unionByName(joined(cells, "group", percent))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each row's set, and the smallest id that its links reach."""
    rows = checkpointed(set_sizes(text_batches(docs), width).hint("rebalance"))  # a few narrow bytes a document: no file for each split of the texts
    named = rows.filter("digest is not null and doc_id is not null")
    leading = F.expr("conv(hex(substring(digest, 1, 8)), 16, -10)").cast("long")  # number
    classes = checkpointed(named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n")).withColumn("class", leading))
    labels = class_components(docs, classes, width, percent)
    linked = classes.join(labels, F.col("class") == F.col("node")).select("class", "id", "root")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    names = linked.join(least, "root").select(F.col("class").alias("node"), F.col("least").alias("root"))
    kin = classes.join(names, F.col("class") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("root"))
    # rows of one id and different sets are one document
    twice = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    if twice.head(1):
        more = named.join(twice.select("doc_id"), "doc_id", "left_semi").join(kin, "digest").select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
        merged = components(more).select(F.col("node").alias("from"), F.col("root").alias("to"))
        kin = kin.join(merged, F.col("root") == F.col("from"), "left").select("digest", F.coalesce("to", "root").alias("root"))
    found = rows.join(kin, "digest", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def class_components(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root), both of column class, of the classes (digest, id, n, class) that link with another one."""
    spark = docs.sparkSession
    number_of, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    in_heads = 2 * total * (100 - percent) // 100
    buckets = buckets_for(in_heads)
    shared = shared_heads(docs, width, percent, buckets, buckets_for(min(in_heads, number_of * buckets)))
    n = F.col("n")
    ceil = lambda x: F.floor((x * percent + 99) / 100)
    m = ceil(n)
    base = m - ceil(m) + 1
    enough = F.least(m, 2 * base) - base + 1  # shared_at_least
    alive = classes.join(shared, "class").filter(F.col("shared") >= enough).select(F.col("id").alias("doc_id"), "digest")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = list(shingle_sets(texts, width))
            own = [i for i, (x, d) in enumerate(zip(sets, batch.column("digest").to_pylist(), strict=True)) if digest(x) == d]
            yield pa.RecordBatch.from_arrays([pa.array([number(digest(sets[i])) for i in own], pa.int64()), pa.array([sets[i].tobytes() for i in own], pa.binary())], ["id", "grams"])

    alive = checkpointed(alive)
    del shared
    cleared(spark)
    sets = checkpointed(docs.select("doc_id", "text").join(small_side(alive, ALIVE), "doc_id").mapInArrow(grams, "id long, grams binary"))
    left = sets.agg(F.sum(F.octet_length("grams"))).head()[0] or 0
    if not left:
        return spark.createDataFrame([], "node long, root long")
    known = frequent(sets, buckets_for(left // 8))
    tied = ties(sets, known, percent, buckets_for(left * (100 - percent) // 800))
    blocks = components(tied)
    sizes = sets.select("id", (F.octet_length("grams") / 8).cast("long").alias("n"))
    named = blocks.join(sizes, F.col("node") == F.col("id"))
    members = named.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    in_blocks = checkpointed(blocks.join(members, "root").select(F.col("node").alias("id"), F.col("root").alias("block"), "members", "size"))
    del tied, named, members
    cleared(spark)
    placed = sets.join(small_side(in_blocks, ALIVE), "id")  # so sets are exchanged once, by block
    large = (F.col("members") > LARGE) | (F.col("size") > BIN)
    bins = max(1, math.ceil(left / 8 / BIN))
    small = placed.filter(~large & (F.col("members") > 1)).select(F.pmod(F.xxhash64("block"), F.lit(bins)).alias("bin"), "id", F.col("block").alias("part"), "grams", F.col("id").alias("label"), *roles(True, True))
    links = joined(small, "bin", percent)
    if in_blocks.filter(large).head(1):
        links = links.unionByName(large_blocks(checkpointed(placed.filter(large)), percent))
    return components(links)


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row that names it; rows with null ids stay.

    Of rows that share an id the one of the longest text stays, of equally long ones that of the largest hash. Ids that
    go are broadcast up to ``GONE`` of them, so texts stay where they are.
    """
    found = checkpointed(jaccard_components(docs, width, percent))
    gone = checkpointed(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    stay = docs.join(small_side(gone, GONE), F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = checkpointed(found.filter("doc_id is not null and doc_id = component_id").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("n")).filter("n > 1").select("_twice"))
    if twice.head(1):
        same = F.col("doc_id") == F.col("_twice")
        known = small_side(twice, GONE)
        rank = F.struct(F.coalesce(F.length("text"), F.lit(-1)), F.xxhash64("text"))
        one = stay.join(known, same, "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias("r"))
        stay = stay.join(known, same, "left_anti").unionByName(one.select("r.*"))
    return stay
