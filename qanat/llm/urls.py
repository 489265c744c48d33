"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides teach two models, one of accepted and one of rejected URLs. A model is a Markov model of
variable order: the probability of a byte given the up to ``ORDER`` bytes before it is smoothed towards that of the
next shorter context, by as much as the longer context is rare. Counts are exact, by order, context and byte, over all
decided URLs, and all of them are used. Up to ``KNOWN`` of them are broadcast, by whole orders, the shortest contexts
first; those of longer contexts stay where they were added up, and pieces of URLs ask for the ones they need by a join.

A URL's score is the difference of its log-likelihoods by byte. The cut is calibrated on a fifth of the decided URLs
that the models do not hold; once it stands, the counts of that fifth are added for the verdicts.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is scored as it stands (null as
empty); repeated rows are decided alike; an empty table gives an empty result; without decided URLs of both kinds the
cut is 0, and what scores at the cut is accepted; a URL of any length is read in pieces; further columns of any name
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.llm.jaccard_join import by_range, unpacked
from qanat.llm.words import mix
from qanat.session import checkpointed, written

ORDER, PRIOR = 5, 4.0
#: Counts that a model holds; counts that a task gathers before it deals them out, and that one task adds up.
KNOWN, GATHER, SPREAD = 1 << 21, 1 << 21, 1 << 22
#: Bins of the calibration's histogram, over scores of -LIMIT to LIMIT.
BINS, LIMIT = 2000, 10.0
#: Bytes of URLs taken together; rows, and bytes of their URLs, that a task turns into pieces at once.
STEP = 1 << 18
GATHERED_ROWS, GATHERED_BYTES = 50_000, 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, verdict


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or above it and whose path starts the URL's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def keys(urls: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A piece at a time, for each byte to predict: its key by order, and the number of its URL.

    A key is the order, the context, nearest byte first, and the byte itself: 3, 40 and 8 bits. Before a URL stand
    zeros, after it a line feed.
    """
    raw = [(u or "").encode() + b"\n" for u in urls]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(bytes(ORDER) + r for r in raw), np.uint8)
    ends = np.cumsum(lengths + ORDER)
    starts = ends - lengths
    keep = np.ones(len(data), bool)
    for k in range(ORDER):
        keep[starts - ORDER + k] = False
    for i in range(0, len(data), STEP):
        at = i + np.flatnonzero(keep[i : i + STEP])
        out, context = np.empty((ORDER + 1, len(at)), np.int64), np.zeros(len(at), np.int64)
        for k in range(ORDER + 1):
            if k:
                context = context << 8 | data[at - k]
            out[k] = k << 48 | context << 8 | data[at]
        yield out, np.searchsorted(ends, at, "right")


class Model:
    """Counts of keys by kind, 0 rejected and 1 accepted, and of their contexts."""

    def __init__(self, known: np.ndarray, counts: np.ndarray):
        """known: ascending keys. counts: (2, keys)."""
        self.keys, self.counts = known, counts.astype(np.float32)
        self.contexts, first = np.unique(known >> 8, return_index=True)
        self.totals = np.add.reduceat(self.counts.astype(np.float64), first, axis=1) if len(first) else np.zeros((2, 0))

    def of(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, their contexts' totals) of keys of order k, each (kind, key)."""
        return found(self.keys, self.counts, asked), found(self.contexts, self.totals, asked >> 8)

    def log_ratio(self, own: np.ndarray) -> np.ndarray:
        """Of keys by order: the accepted model's log-likelihood of each byte less the rejected one's."""
        p = np.full((2, own.shape[1]), 1 / 256)
        for k in range(ORDER + 1):
            few, where = np.unique(own[k], return_inverse=True)
            c, n = self.of(few, k)
            p = (c[:, where] + PRIOR * p) / (n[:, where] + PRIOR)
        return np.log(p[1]) - np.log(p[0])


class Told(Model):
    """A model of the orders under ``first``, and what it was told of the longer contexts of some keys."""

    def __init__(self, model: Model, first: int, known: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        """known: ascending keys. counts, totals: (2, keys)."""
        self.model, self.first, self.told, self.told_counts, self.told_totals = model, first, known, counts, totals

    def of(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k < self.first:
            return self.model.of(asked, k)
        return found(self.told, self.told_counts, asked), found(self.told, self.told_totals, asked)


def found(known: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values (kind, key) of the keys that are asked for, 0 where they are not known."""
    if not len(known):
        return np.zeros((2, len(asked)))
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, values[:, at], 0).astype(np.float64)


def buckets_for(rows: DataFrame) -> int:
    """Buckets that share out the keys of these rows' URLs."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length("url"), F.lit(0)) + 1)).head()[0] or 0
    return max(1, -(-size * (ORDER + 1) // SPREAD))


def bucket(asked: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: that of its context, so that a context's keys lie together."""
    return (mix((asked >> 8).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def tallied(rows: DataFrame, buckets: int) -> DataFrame:
    """(to, order, level, n, keys, counts) of (url, good, held): all counts, by bucket, order and size.

    A key goes with its kind in its lowest two bits: 1 for good URLs, 2 more for held ones.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def combined() -> tuple[np.ndarray, np.ndarray]:
            return added(np.concatenate(gathered), np.concatenate(counts)) if gathered else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def dealt() -> pa.RecordBatch:
            own, n = combined()
            return by_range(bucket(own >> 2, buckets), own, n)

        for b in batches:
            kind = b.column("good").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * b.column("held").to_numpy(zero_copy_only=False).astype(np.int64)
            for own, row in keys(b.column("url").to_pylist()):
                few, n = np.unique(own << 2 | kind[row], return_counts=True)
                gathered.append(few)
                counts.append(n.astype(np.int64))
                if sum(map(len, gathered)) >= GATHER:
                    few, n = combined()
                    gathered, counts = [few], [n]
                    if len(few) >= GATHER // 2:
                        yield dealt()
                        gathered, counts = [], []
        yield dealt()

    def add(part: pa.Table) -> pa.Table:
        own, n = added(unpacked(part, "c0", np.int64), unpacked(part, "c1", np.int64))
        _, where = np.unique(own >> 2, return_inverse=True)
        level = np.floor(np.log2(np.bincount(where, n)[where]) * 4).astype(np.int64) if len(own) else np.zeros(0, np.int64)
        group = (own >> 50) << 32 | level
        out = [(int(v), own[group == v], n[group == v]) for v in np.unique(group)]
        to = part.column("to")[0].as_py()
        return pa.table({"to": pa.array([to] * len(out), pa.int32()), "order": pa.array([o[0] >> 32 for o in out], pa.int32()), "level": pa.array([o[0] & 0xFFFFFFFF for o in out], pa.int32()), "n": pa.array([len(o[1]) for o in out], pa.int64()), "keys": pa.array([o[1].tobytes() for o in out], pa.binary()), "counts": pa.array([o[2].tobytes() for o in out], pa.binary())})

    dealt = rows.select("url", "good", "held").mapInArrow(deal, "to int, c0 binary, c1 binary")
    return checkpointed(dealt.groupBy("to").applyInArrow(add, "to int, order int, level int, n long, keys binary, counts binary"))


def merged(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their counts (4, keys) by kind, of some of the rows of ``tallied``; the caller bounds them."""
    kept = rows.select("keys", "counts").collect()
    return by_kind(np.frombuffer(b"".join(r[0] for r in kept), np.int64), np.frombuffer(b"".join(r[1] for r in kept), np.int64))


def by_kind(own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, where = np.unique(own >> 2, return_inverse=True)
    out = np.zeros((4, len(known)))
    out[own & 3, where] = n
    return known, out


def counted(rows: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and their counts (4, keys) of (url, good, held): kind 1 of good URLs, 2 more of held ones.

    For a model of bounded size: of more than ``most`` the most frequent, by whole levels. ``judge`` uses all counts.
    """
    levels = tallied(rows, buckets_for(rows))
    least, room = 1 << 30, KNOWN if most is None else most
    for r in levels.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # four levels for each power of two
        if (room := room - r["n"]) < 0:
            break
        least = r["level"]
    return merged(levels.filter(F.col("level") >= least))


def added(own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sums of their counts."""
    few, where = np.unique(own, return_inverse=True)
    total = np.zeros(len(few), np.int64)
    np.add.at(total, where, n)
    return few, total


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Adds score to (page_id, url, host, path, rule, verdict)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap, n = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for own, row in keys(b.column("url").to_pylist()):
                gap += np.bincount(row, shared.value.log_ratio(own), b.num_rows)
                n += np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(gap / n, pa.float64())], [*b.schema.names, "score"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", score double")


def scored_by_join(rows: DataFrame, model: Model, first: int, rest: DataFrame, buckets: int, held: bool) -> DataFrame:
    """As ``scored``, with the counts of orders from ``first`` on looked up in ``rest``, rows of ``tallied``.

    URLs are cut into pieces of keys; a piece asks each bucket once for the distinct keys that lie there. held: with
    the counts of held URLs.
    """
    own = written(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def pieces() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([b.column("_row").to_numpy() for b in waiting])
            for got, row in keys([u for b in waiting for u in b.column("url").to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[row], got[ORDER])], ["rows", "keys"])

        for b in batches:
            waiting.append(b)
            if sum(w.num_rows for w in waiting) >= GATHERED_ROWS or sum(w.nbytes for w in waiting) >= GATHERED_BYTES:
                yield from pieces()
                waiting = []
        if waiting:
            yield from pieces()

    cuts = checkpointed(own.select("_row", "url").mapInArrow(cut, "rows binary, keys binary")).withColumn("piece", F.monotonically_increasing_id())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, longest in zip(b.column("piece").to_pylist(), b.column("keys"), strict=True):
                few = np.unique(np.concatenate([shortened(np.unique(np.frombuffer(longest.as_py(), np.int64)), k) for k in range(first, ORDER + 1)]))
                out = by_range(bucket(few, buckets), few)
                yield pa.RecordBatch.from_arrays([out.column("to"), pa.array([piece] * out.num_rows, pa.int64()), out.column("c0")], ["to", "piece", "keys"])

    def answer(asked: pa.Table, here: pa.Table) -> pa.Table:
        known, n = by_kind(unpacked(here, "keys", np.int64), unpacked(here, "counts", np.int64))
        lookup = Model(known, n[:2] + n[2:] if held else n[:2])
        told: list[tuple[bytes, bytes]] = []
        for few in asked.column("keys").to_pylist():
            c, t = lookup.of(np.frombuffer(few, np.int64), first)
            told.append((c.astype(np.float32).tobytes(), t.tobytes()))
        return pa.table({"piece": asked.column("piece"), "keys": asked.column("keys"), "counts": pa.array([c for c, _ in told], pa.binary()), "totals": pa.array([t for _, t in told], pa.binary())})

    def add(piece: pa.Table, told: pa.Table) -> pa.Table:
        known = unpacked(told, "keys", np.int64)
        order = np.argsort(known)
        each = lambda c, kind: np.concatenate([np.frombuffer(x, kind).reshape(2, -1) for x in told.column(c).to_pylist()], 1)[:, order]
        row, longest = unpacked(piece, "rows", np.int64), unpacked(piece, "keys", np.int64)
        full = Told(shared.value, first, known[order], each("counts", np.float32), each("totals", np.float64))
        ids, where = np.unique(row, return_inverse=True)
        gap = full.log_ratio(np.stack([shortened(longest, k) for k in range(ORDER + 1)]))
        return pa.table({"_row": ids, "gap": np.bincount(where, gap, len(ids)), "n": np.bincount(where, minlength=len(ids))})

    asks = cuts.select("piece", "keys").mapInArrow(ask, "to int, piece long, keys binary")
    answers = asks.groupBy("to").cogroup(rest.groupBy("to")).applyInArrow(answer, "piece long, keys binary, counts binary, totals binary")
    gaps = cuts.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(add, "_row long, gap double, n long")
    score = gaps.groupBy("_row").agg((F.sum("gap") / F.sum("n")).alias("score"))
    return own.join(score, "_row").drop("_row")


def shortened(longest: np.ndarray, k: int) -> np.ndarray:
    """The keys of order k at the places of keys of the highest order."""
    return k << 48 | (longest >> 8 & (1 << 8 * ORDER) - 1) >> 8 * (ORDER - k) << 8 | longest & 255


def calibrated(held: DataFrame) -> float:
    """The cut with the best mean of both kinds' accuracy on (score, good); the middle of the best range."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + LIMIT) / (2 * LIMIT) * BINS)))
    found = held.groupBy(bin_.alias("bin"), "good").agg(F.count("*").alias("n")).collect()  # 2 * BINS rows at most
    n = np.zeros((2, BINS))
    for r in found:
        n[int(r["good"]), int(r["bin"])] = r["n"]
    if not n[0].sum() or not n[1].sum():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(n, 1)), 1)  # of each kind, under the lower edge of a bin
    merit = below[0] / n[0].sum() + 1 - below[1] / n[1].sum()
    best = np.flatnonzero(merit >= merit.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * (2 * LIMIT) / BINS - LIMIT)


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of (page_id, url)."""
    host, path = parts(F.col("url"))
    named = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "verdict": verdict})
    decided = named.filter("rule is not null").withColumn("held", F.pmod(F.xxhash64("url"), F.lit(5)) == 0)
    buckets = buckets_for(named)
    table = tallied(decided.select("url", (F.col("verdict") == "allow").alias("good"), "held"), buckets)
    first, room = 0, KNOWN
    sizes = dict(table.groupBy("order").agg(F.sum("n")).collect())  # ORDER + 1 rows
    while first <= ORDER and (room := room - sizes.get(first, 0)) >= 0:
        first += 1
    known, counts = merged(table.filter(F.col("order") < first))  # ``KNOWN`` counts at most

    def score(rows: DataFrame, held: bool) -> DataFrame:
        model = Model(known, counts[:2] + counts[2:] if held else counts[:2])
        return scored(rows, model) if first > ORDER else scored_by_join(rows, model, first, table.filter(F.col("order") >= first), buckets, held)

    held = score(decided.filter("held").select("page_id", "url", "host", "path", "rule", "verdict"), False)
    cut = calibrated(held.select("score", (F.col("verdict") == "allow").alias("good")))
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return score(named, True).select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
