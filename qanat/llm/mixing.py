"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. A source's target, in words, is met by taking all of its documents a whole
number of times and, once more, those whose hash lies below the source's threshold. Thresholds are found from
histograms: words by source and leading hash bits are summed over all documents, cumulated, and the bucket that holds
the boundary is refined by the next bits, until it holds one hash. Documents are never sorted; every shuffle carries
sums by source and bucket, combined before it. Documents meet the plan of their source where they lie: it has a row for
each source and is broadcast, but for over ``SOURCES`` of them.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; null ids hash as the
empty string; repeated rows share a hash and are taken together; an empty table gives an empty result; further columns
of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed, small_side

BITS, HASH_BITS = 12, 60
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Sources whose plan is broadcast; more are joined by a shuffle.
SOURCES = 200_000
SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def id_hash(key: Column) -> Column:
    """The first 15 hexadecimal digits of the id's MD5, a long from 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all words dealt by weight, at most ``most`` times a source's size.

    Capping a source and dealing its excess anew by weight, until none is above its cap, ends where the sources are
    capped in order of cap / weight: a source is capped if the level that is left, when all before it are, exceeds its
    own ratio. This runs over one row for each source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    nth = F.row_number().over(by_name) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "all": F.sum("source_size").over(everything) * F.lit(share), "weights": F.sum("weight").over(everything)})
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = ranked.withColumn("capped", level > F.col("ratio"))
    left = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weights = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * left / open_weights).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, more) -> (source, below): documents with a hash under ``below`` hold nearest to ``more`` words."""
    state = checkpointed(budgets).select("source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("under"), "more")
    depth = 0
    while True:
        bits = min(BITS, HASH_BITS - depth)
        left = HASH_BITS - depth - bits
        state = state.select(F.col("source").alias("s"), "block", "under", "more")
        inside = rows.join(small_side(state, SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", HASH_BITS - depth) == F.col("block")))
        cells = inside.groupBy("source", "under", "more", F.shiftright("h", left).alias("cell")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        up_to = F.sum("n").over(Window.partitionBy("source").orderBy("cell"))
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("cell"))) == 1
        cut = cells.withColumns({"to": F.col("under") + up_to, "last": last}).filter(((F.col("to") - F.col("n") <= F.col("more")) & (F.col("to") > F.col("more"))) | (F.col("last") & (F.col("to") <= F.col("more"))))
        state = checkpointed(cut.select("source", F.col("cell").alias("block"), (F.col("to") - F.col("n")).alias("under"), "more", "n", "lo", "hi"))
        depth += bits
        if depth == HASH_BITS or not state.filter((F.col("lo") != F.col("hi")) & (F.col("under") + F.col("n") > F.col("more"))).head(1):
            break
    with_it, without = F.col("under") + F.col("n") - F.col("more"), F.col("more") - F.col("under")
    return state.select("source", F.when(with_it < without, F.col("hi") + 1).otherwise(F.col("lo")).alias("below"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` in the struct _doc with size, source_size, target, times (0 to 2) and taken (size * times)."""
    marks = [F.col(source).alias("source"), id_hash(F.col(key)).alias("h"), word_count(F.col(text)).alias("size")]
    rows = checkpointed(docs.select(*marks))
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = checkpointed(aims.withColumn("whole", whole).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")))
    found = thresholds(rows, aims.select("source", "more")).withColumnRenamed("source", "s2")
    # a source that is taken a whole number of times has no threshold, or its documents without words would be taken once more
    plan = checkpointed(aims.join(found, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", F.when(F.col("more") > 0, F.coalesce("below", F.lit(0))).otherwise(0).alias("below")))
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *marks).join(small_side(plan, SOURCES), F.col("source").eqNullSafe(F.col("s")))
    times = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    return full.select("_doc", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    taken = mix(docs).filter("times > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_n")).select("_doc.*")
