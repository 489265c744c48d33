"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by two hashes, of the text (so equal texts, a group, are neighbours) and of the id. Shard boundaries
are found by probing: each round counts the exact bytes between candidate boundaries over all rows, and refines the
probes of those boundaries that still miss their target by more than the tolerance. Groups over the tolerance are
placed first, each whole into the shard with the least room that takes it; the boundaries share out what room is left.
Only a group that no shard can take whole is cut, where the order meets a boundary. The driver sees counts alone:
``2**FIRST_BITS`` in the first round, ``2**NEXT_BITS`` for each open boundary in later ones, and those of the at most
``RANGES`` groups that are over a range's size.

Rows are exchanged once, after the boundaries stand, and not by shard: a shard is cut into ranges of at most about
``RANGE`` bytes, and no more than ``RANGES`` in all, by leading bits of the hashes, with a large group cut by the id's.
A row's slot is its place in its range plus the rows of the ranges before, so no task sorts a whole shard.

Defined cases: a null text has no bytes, so its size is the row's overhead, and goes with the empty ones; rows of one id
and text, null ids among them, have slots of their own in any order; an empty table gives an empty result; further
columns of any name are kept.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed, small_side

FIRST_BITS, NEXT_BITS = 12, 8
#: Bytes that a row takes besides its text.
OVERHEAD = 8
#: Bytes of a range, and ranges in all, about; a range grows only where there would be more of them.
RANGE, RANGES = 16 << 20, 1 << 16
#: Ranges whose offsets are broadcast; more are joined by a shuffle of the rows' own partitioning.
OFFSETS = 400_000


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(OVERHEAD).cast("long")


def unsigned(x: Column) -> Column:
    """The long whose unsigned order is the signed order of x."""
    return x.bitwiseXOR(F.lit(-(2**63)))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def probes(rows: DataFrame, depth: int, blocks: set[int], bits: int) -> dict[int, int]:
    """Exact bytes of each value of the leading depth + bits of (u, v), within the blocks that the leading depth bits name."""
    to = depth + bits
    if to <= 64:
        if depth:
            rows = rows.filter(F.shiftrightunsigned("u", 64 - depth).isin([signed(b) for b in blocks]))
        cell = [F.shiftrightunsigned("u", 64 - to).alias("a"), F.lit(0).cast("long").alias("b")]
    else:
        rows = rows.filter(F.col("u").isin(sorted({signed(b >> (depth - 64)) for b in blocks})))
        cell = [F.col("u").alias("a"), F.shiftrightunsigned("v", 128 - to).alias("b")]
    low = to - 64 if to > 64 else 0
    found = rows.groupBy(*cell).agg(F.sum("size").alias("n")).collect()
    counts = {((r["a"] % 2**64) << low) | (r["b"] % 2**64): r["n"] for r in found}
    return {c: n for c, n in counts.items() if not depth or c >> bits in blocks}


def splitters(rows: DataFrame, targets: list[float], slack: float) -> list[int]:
    """128-bit boundaries over (u, v), ascending; under the i-th lie about targets[i] bytes.

    A boundary is taken as soon as the bytes below it are within ``slack`` of its target, else the nearest one that the
    order of the rows allows.
    """
    open_at: dict[int, tuple[int, int]] = dict.fromkeys(range(len(targets)), (0, 0))  # boundary -> its block, bytes below that
    done: dict[int, int] = {}
    depth = 0
    while open_at and depth < 128:
        bits = min(NEXT_BITS if depth else FIRST_BITS, (64 if depth < 64 else 128) - depth)
        counts = probes(rows, depth, {b for b, _ in open_at.values()}, bits)
        if not depth and not counts:
            return [2**128] * len(targets)
        cells: dict[int, list[int]] = {}
        for c in sorted(counts):
            cells.setdefault(c >> bits, []).append(c)
        left = 128 - depth - bits
        for i, (block, below) in list(open_at.items()):
            target, at = targets[i], below
            for c in cells.get(block, []):
                if at + counts[c] > target:
                    break
                at += counts[c]
            else:
                done[i] = ((block + 1) << (128 - depth)) if cells.get(block) else block << (128 - depth)
                open_at.pop(i)
                continue
            lower, upper = target - at, at + counts[c] - target
            if min(lower, upper) <= slack or not left:
                done[i] = (c if lower <= upper else c + 1) << left
                open_at.pop(i)
            else:
                open_at[i] = (c, at)
        depth += bits
    return [done[i] for i in range(len(targets))]


def large_groups(rows: DataFrame, least: float) -> DataFrame:
    """(g, n): the texts' hashes whose rows hold over ``least`` bytes."""
    cell = F.shiftrightunsigned("u", 64 - FIRST_BITS)
    full = [r["c"] for r in rows.groupBy(cell.alias("c")).agg(F.sum("size").alias("n")).filter(F.col("n") > least).collect()]  # 2**FIRST_BITS at most
    return checkpointed(rows.filter(cell.isin(full)).groupBy(F.col("u").alias("g")).agg(F.sum("size").alias("n")).filter(F.col("n") > least))


def homes(groups: list[tuple[int, int]], shards: int, mean: float, slack: float) -> tuple[dict[int, int], list[float]]:
    """Groups (g, n) -> the shard of each that one takes whole, largest first into the least room; and the room left."""
    room, home = [mean] * shards, {}
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        fits = [(r, i) for i, r in enumerate(room) if n <= r + slack]
        if fits:
            home[g] = min(fits)[1]
            room[home[g]] = max(0.0, room[home[g]] - n)
    return home, room


def shard(docs: DataFrame, shards: int, tolerance: float = 0.01, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with their columns in the struct _doc, and size, shard (from 0) and slot (gapless from 0 in a shard)."""
    spark = docs.sparkSession
    order = [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("u"), F.xxhash64(F.col(key)).alias("v"), row_size(F.col(text)).alias("size")]
    rows = checkpointed(docs.select(*order))
    total = rows.agg(F.sum("size")).head()[0] or 0
    mean, slack, span = total / shards, tolerance * total / shards, max(RANGE, total / RANGES)

    large = large_groups(rows, min(slack, span))
    home, room = homes([(r["g"], r["n"]) for r in large.filter(F.col("n") > slack).collect()], shards, mean, slack / 2)  # shards / tolerance at most
    named = F.from_json(F.lit(json.dumps([{"h": g, "home": i} for g, i in home.items()])), "array<struct<h:long,home:int>>")
    placed = spark.range(1).select(F.inline(named))
    cuts = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(span))))).cast("int")
    known = small_side(checkpointed(large.join(F.broadcast(placed), F.col("g") == F.col("h"), "left").select("g", "home", cuts.alias("cuts"))), 2 * RANGES)

    light = checkpointed(rows.join(F.broadcast(placed), F.col("u") == F.col("h"), "left_anti")) if home else rows
    rest = light.agg(F.sum("size")).head()[0] or 0
    targets = [sum(room[:i]) * rest / max(sum(room), 1e-9) for i in range(1, shards)]
    edges = splitters(light.select(unsigned(F.col("u")).alias("u"), unsigned(F.col("v")).alias("v"), "size"), targets, slack / 2)

    at = F.lit(0)
    for edge in edges:
        if edge < 2**128:
            x, y = (edge >> 64) - 2**63, edge % 2**64 - 2**63
            at = at + ((F.col("u") > F.lit(x)) | ((F.col("u") == F.lit(x)) & (F.col("v") >= F.lit(y)))).cast("int")
    bits = max(0, min(30, math.ceil(math.log2(max(1.0, total / span)))))
    range_ = {
        "shard": F.coalesce("home", at).cast("int"),
        "cell": F.shiftrightunsigned(unsigned(F.col("u")), 64 - bits) if bits else F.lit(0).cast("long"),
        "group": F.when(F.col("cuts") > 0, F.col("u")).otherwise(F.lit(0).cast("long")),
        "part": F.when(F.col("cuts") > 0, 1 + F.expr("shiftrightunsigned(v, 64 - cuts)")).otherwise(F.lit(0).cast("long")),
    }
    keys = list(range_)

    def in_ranges(df: DataFrame) -> DataFrame:
        return df.join(known, F.col("u") == F.col("g"), "left").withColumns(range_)

    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "group", "part")) - F.col("n")
    offsets = checkpointed(in_ranges(rows).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("before", before).drop("n"))
    whole = in_ranges(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *order))
    numbered = whole.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("u", "v")) - 1)
    return numbered.join(small_side(offsets, OFFSETS), keys).select("_doc", "size", "shard", (F.col("before") + F.col("place")).alias("slot"))
