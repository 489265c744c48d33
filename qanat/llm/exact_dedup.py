"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary per input task names the digests that can hold more than 1/k of the rows. Their groups are
counted exactly, with map-side combining, and the at most ``k`` verified winners are broadcast, so the rows of large
groups are decided where they lie. All other digests, each with at most a k-th of the rows, meet by an ordinary
shuffle of narrow rows. To drop the copies from a table, the rows that go are named by id and broadcast, so texts stay
where they are; over ``GONE`` such rows are joined by a shuffle of the table.

Defined cases: a null text counts as the empty text; of equal texts the row with the most code points, then the
smallest id (null ids last), then the first row stays; of fully repeated rows exactly one stays; an empty table gives
an empty result; a table may carry further columns of any name, they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed

#: ASCII white space, as one class of code points.
SPACE = r"[\x20\x09-\x0D]"
#: Rows that go, named by id, digest and code points, that are broadcast.
GONE = 1_000_000


def normalised(text: Column) -> Column:
    """The text without any ASCII white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def misra_gries(digests: DataFrame, k: int) -> DataFrame:
    """Rows (digest, n): at most ``k`` counters for each task; every digest in over 1/(k+1) of all rows is among them.

    Batches are counted whole and merged; when over k counters are left, the (k+1)-th largest count is taken off all.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for entry in batch.column(0).value_counts().to_pylist():
                kept[entry["values"]] = kept.get(entry["values"], 0) + entry["counts"]
            if len(kept) > k:
                cut = int(np.partition(np.fromiter(kept.values(), np.int64, len(kept)), len(kept) - k - 1)[len(kept) - k - 1])
                kept = {d: n - cut for d, n in kept.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])

    return digests.select("digest").mapInArrow(summarise, "digest binary, n long")


def narrow(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, digest, points, row) of each row, written once to the shared folder."""
    return checkpointed(docs.select(F.col(key).alias("key"), *marks(text), F.monotonically_increasing_id().alias("row")))


def marks(text: str) -> list[Column]:
    return [F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("points")]


def decide(rows: DataFrame, k: int) -> DataFrame:
    """Adds best (the winner's struct) and size to (key, digest, points, row)."""
    rank = F.struct((-F.col("points")).alias("less"), F.col("key").isNull().alias("last"), "key", "row")
    found = misra_gries(rows, k).groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")
    heavy = rows.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("size"))
    heavy = checkpointed(heavy)  # k rows at most
    large = rows.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    small = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumns({"best": F.min(rank).over(group), "size": F.count("*").over(group)})
    return large.unionByName(small)


def exact_dedup(docs: DataFrame, k: int = 256, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (key, keep_id, group_size, kept, digest) for each row of ``docs``; ``k`` bounds the broadcast."""
    return decide(narrow(docs, text, key), k).select(
        F.col("key").alias(key), F.col("best.key").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"), "digest"
    )


def kept_rows(docs: DataFrame, k: int = 256, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is known by id, digest and code points together; only rows whose id names a row that goes are digested again.
    Where rows with all three equal are the winners, they are reduced to one of them.
    """
    decided = checkpointed(decide(narrow(docs, text, key), k))
    wins = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("points") == -F.col("best.less"))
    named = [F.col("key").alias("_wk"), F.col("digest").alias("_wd"), F.col("points").alias("_wp")]
    gone = decided.filter(~wins).select(*named).distinct()
    twins = checkpointed(decided.filter(wins).groupBy(*named).agg(F.count("*").alias("_same")).filter("_same > 1").drop("_same"))
    marked = checkpointed(gone.withColumn("_twin", F.lit(False)).unionByName(twins.withColumn("_twin", F.lit(True))))
    digest, points = marks(text)
    few = marked.limit(GONE + 1).count() <= GONE
    if few:
        ids = marked.select(F.col("_wk").alias("_id")).distinct().withColumn("_hit", F.lit(True))
        seen = docs.join(F.broadcast(ids), F.col(key).eqNullSafe(F.col("_id")), "left").withColumns({"_digest_": F.when(F.col("_hit"), digest), "_points_": points})
    else:
        seen = docs.withColumns({"_digest_": digest, "_points_": points})
    same = F.col(key).eqNullSafe(F.col("_wk")) & (F.col("_digest_") == F.col("_wd")) & (F.col("_points_") == F.col("_wp"))
    known = seen.join(F.broadcast(marked) if few else marked, same, "left")
    stay = known.filter("_twin is null")
    if twins.head(1):
        stay = stay.unionByName(known.filter("_twin").dropDuplicates(["_digest_"]))
    return stay.select([f"`{c}`" for c in docs.columns])
