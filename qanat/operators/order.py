"""Order without one task for a group or a table: exact order statistics by histogram selection, places by range offsets.

Order statistics: each round counts a group's values between probes, with map-side combining, finds the bucket that
holds the wanted place, and refines that bucket alone, until it holds one value. The first probes are the powers of two
of either sign, later ones even cuts between a bucket's smallest and largest value, so a bucket within two powers of two
takes about 52 / log2(CELLS) more rounds at most. No round sorts or gathers a group; what is known of a group is a few
numbers for each wanted place, and at most ``CELLS`` counts while a round lasts.

Places: rows are exchanged once by ranges of their order and sorted within a range; a row's place is the number of rows
in the ranges before, plus its place in its own. Only one count for each range reaches the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed, small_side

#: Buckets that a bucket is cut into; buckets to refine, and ranges, that are broadcast.
CELLS, OPEN = 4096, 100_000


def first_cell(x: Column) -> Column:
    """Never falls as x rises: powers of two of either sign, with cells of their own for the infinities and NaN."""
    power = F.floor(F.log2(F.abs(x))) + 1100
    return F.when(F.isnan(x), 5000).when(F.abs(x) == float("inf"), F.signum(x) * 4000).when(x == 0, 0).otherwise(F.signum(x) * power).cast("int")


def even_cell(x: Column, low: Column, high: Column) -> Column:
    """Never falls as x rises from low to high, which differ and lie within two powers of two of one sign."""
    return F.floor((x - low) / (high - low) * (CELLS - 1)).cast("int")


#: Places from 0 among n sorted values, as two neighbours and the share of the upper one.
Rule = Callable[[Column], tuple[Column, Column, Column]]


def interpolated(q: float) -> Rule:
    """Between the values around q (n - 1)."""

    def at(n: Column) -> tuple[Column, Column, Column]:
        place = F.lit(q) * (n - 1)
        return F.floor(place), F.ceil(place), place - F.floor(place)

    return at


def clipped(q: float) -> Rule:
    """The value number min(n - 1, floor(n q)), from 0."""

    def at(n: Column) -> tuple[Column, Column, Column]:
        place = F.least(n - 1, F.floor(n * F.lit(q)))
        return place, place, F.lit(0.0)

    return at


def lower(q: float) -> Rule:
    """The value number floor(q (n - 1)), from 0."""

    def at(n: Column) -> tuple[Column, Column, Column]:
        place = F.floor(F.lit(q) * (n - 1))
        return place, place, F.lit(0.0)

    return at


def counted(cells: DataFrame, *by: str) -> DataFrame:
    """Cells (by.., cell, n, lo, hi) with the values below each and up to it."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("cell"))
    return cells.withColumns({"below": upto - F.col("n"), "upto": upto})


def selected(data: DataFrame, places: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_g, _x) -> (_g, place, value) for the places (_g, place) that ``places`` makes of the groups' sizes (_g, n)."""
    span = [F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")]
    cells = checkpointed(data.groupBy("_g", first_cell(F.col("_x")).alias("cell")).agg(*span))
    wanted = places(cells.groupBy("_g").agg(F.sum("n").alias("n"))).distinct().withColumn("rest", F.col("place"))
    inside = (F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("upto"))
    found = checkpointed(counted(cells, "_g").join(wanted, "_g").filter(inside).select("_g", "place", (F.col("rest") - F.col("below")).alias("rest"), "lo", "hi"))
    one = F.col("lo") == F.col("hi")
    done = [found.filter(one)]
    while (found := found.filter(~one)).head(1):
        ranges = small_side(found.select("_g", F.col("lo").alias("from"), F.col("hi").alias("to")).distinct(), OPEN)
        among = data.join(ranges, "_g").filter(F.col("_x").between(F.col("from"), F.col("to")))
        cells = among.groupBy("_g", "from", "to", even_cell(F.col("_x"), F.col("from"), F.col("to")).alias("cell")).agg(*span)
        inner = counted(cells, "_g", "from", "to").withColumnsRenamed({"lo": "low", "hi": "high"})
        met = inner.join(found.withColumnsRenamed({"lo": "from", "hi": "to"}), ["_g", "from", "to"]).filter(inside)
        found = checkpointed(met.select("_g", "place", (F.col("rest") - F.col("below")).alias("rest"), F.col("low").alias("lo"), F.col("high").alias("hi")))
        done.append(found.filter(one))
    return functools.reduce(DataFrame.unionByName, done).select("_g", "place", F.col("lo").alias("value"))


def order_statistics(rows: DataFrame, by: list[str], x: str, rules: dict[str, Rule]) -> DataFrame:
    """(by.., a column for each rule) of the values that are not null; NaN is above all others, groups without values have no row.

    The rows are read once a round; write them first where they are costly.
    """
    group = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("_"))
    data = rows.filter(F.col(x).isNotNull()).select(group.alias("_g"), (F.col(x).cast("double") + 0.0).alias("_x"))
    named = [F.struct(F.lit(name).alias("name"), *[c.alias(f) for c, f in zip(rule(F.col("n")), ("a", "b", "share"), strict=True)]) for name, rule in rules.items()]

    def ends(sizes: DataFrame) -> DataFrame:
        return sizes.select("_g", F.inline(F.array(*named)))

    def places(sizes: DataFrame) -> DataFrame:
        return ends(sizes).select("_g", F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("place"))

    found = checkpointed(selected(data, places))
    sizes = data.groupBy("_g").agg(F.count("*").alias("n"))
    at = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))  # two places a rule at most
    met = ends(sizes).join(at, "_g")
    low, high = F.col("at")[F.col("a").cast("long")], F.col("at")[F.col("b").cast("long")]
    value = F.when((F.col("share") == 0) | (low == high), low).otherwise(low * (1 - F.col("share")) + high * F.col("share"))
    out = met.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in rules])
    return out.select(*[F.col(f"_g.`{c}`") for c in by], *rules)


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> tuple[DataFrame, int]:
    """The rows with their place from 0 in the order, and how many they are; rows of equal order in any, but whole, order."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    tie = F.xxhash64(F.monotonically_increasing_id())  # rows of equal order may be more than a range holds
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    kept = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))  # its upper bits name the range
    sizes = sorted(tuple(r) for r in kept.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # one for each range
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    met = kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return met.select(*columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name)), total
