"""Time series: rates, histograms and their quantiles, alerts with a duration, canary analysis, drift, moving averages, timings of requests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.functions.vectors import dot, norm, unit
from qanat.operators.order import interpolated, order_statistics

#: Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 60.0)


def increases(samples: DataFrame, series: list[str], slot: Column | None = None) -> DataFrame:
    """(series.., ts, value) of counters -> with delta; after a reset the new value itself.

    slot, which must not fall as ts rises, cuts long series into parts that are read apart; each part's first sample
    takes up the value that the part before it ended with.
    """
    cut = samples.withColumn("_slot", F.lit(0) if slot is None else slot)
    inside = F.lag(F.struct("value")).over(Window.partitionBy(*series, "_slot").orderBy("ts"))
    if slot is None:
        known = cut.withColumn("_before", inside["value"])
    else:
        ends = cut.groupBy(*series, "_slot").agg(F.max_by(F.struct("value"), "ts").alias("end"))
        carried = ends.withColumn("_end", F.lag("end").over(Window.partitionBy(*series).orderBy("_slot"))).drop("end")
        known = _beside(cut.withColumn("_in", inside), carried, [*series, "_slot"]).withColumn("_before", F.coalesce("_in", "_end")["value"])
    before = F.col("_before")
    delta = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return known.withColumn("delta", delta).select(*samples.columns, "delta")


def _beside(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with what is known of its part; keys may be null."""
    named = parts.withColumnsRenamed({c: f"_key{i}" for i, c in enumerate(keys)})
    same = [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)]
    return rows.join(named, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def over_windows(deltas: DataFrame, by: list[str], length: str, step: str, per_second: bool) -> DataFrame:
    """Sums of delta in sliding windows; per second for a rate, else an increase. length is a whole number of steps.

    Samples are summed by step first, so what falls into many windows is a sum for each step, not each sample.
    """
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    if length != step:
        deltas = deltas.groupBy(F.window("ts", step).alias("w"), *by).agg(F.sum("delta").alias("delta")).withColumn("ts", F.col("w.start"))
    out = deltas.groupBy(F.window("ts", length, step).alias("w"), *by).agg(F.sum("delta").alias("total"))
    return out.select(F.col("w.end").alias("at"), *by, (F.col("total") / seconds if per_second else F.col("total")).alias("value"))


def histogram(rows: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts: (by.., le, n), the last bucket's bound being infinite."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*counts, F.count(value).alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return wide.select(*by, F.inline(F.array(*cells, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Linear inside the bucket that the quantile falls in; in the last one, its lower bound."""
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    steps = buckets.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "under": F.coalesce(F.lag("n").over(w), F.lit(0)), "want": F.lit(q) * total})
    first = steps.filter((F.col("n") >= F.col("want")) & (F.col("n") > 0)).withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("under")) / F.nullif(F.col("n") - F.col("under"), F.lit(0))
    return first.select(*by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.coalesce(inside, F.col("le"))).alias("quantile"))


def latest(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def alerts_for(samples: DataFrame, breach: Column, hold: int, by: list[str], order: str = "ts", slot: Column | None = None) -> DataFrame:
    """Breaches that have lasted ``hold`` seconds: (by.., since, fired, until, n), in seconds, for each run of breaching samples.

    order tells samples of one ts apart. slot, which must not fall in that order, cuts long series into parts that are
    read apart: a run is known by how many good samples precede it, and each part adds those of the parts before it.
    """
    flagged = samples.withColumns({"_bad": F.coalesce(breach, F.lit(False)), "_slot": F.lit(0) if slot is None else slot})
    good = F.sum(F.when(F.col("_bad"), 0).otherwise(1))
    runs = flagged.withColumn("_run", good.over(Window.partitionBy(*by, "_slot").orderBy(order)))
    if slot is not None:
        totals = flagged.groupBy(*by, "_slot").agg(good.alias("_good"))
        earlier = totals.withColumn("_earlier", F.sum("_good").over(Window.partitionBy(*by).orderBy("_slot")) - F.col("_good")).drop("_good")
        runs = _beside(runs, earlier, [*by, "_slot"]).withColumn("_run", F.col("_run") + F.col("_earlier"))
    seconds = F.unix_timestamp("ts")
    spans = runs.filter("_bad").groupBy(*by, "_run").agg(F.min(seconds).alias("since"), F.max(seconds).alias("until"), F.count("*").alias("n"))
    return spans.filter(F.col("until") - F.col("since") >= hold).select(*by, "since", (F.col("since") + hold).alias("fired"), "until", "n")


def repeated(alerts: DataFrame, by: list[str], every: int) -> DataFrame:
    """Alerts without those within ``every`` seconds of the one before, of the same group."""
    before = F.lag("fired").over(Window.partitionBy(*by).orderBy("fired"))
    return alerts.withColumn("before", before).filter(F.col("before").isNull() | (F.col("fired") - F.col("before") >= every)).drop("before")


def canary(rows: DataFrame, step: str = "1 minute", most_p95: float = 10.0, most_errors: float = 0.05, failures: int = 1) -> DataFrame:
    """(ts, latency, error) -> one row: how many windows fail either test, and whether the release goes on."""
    cut = rows.withColumn("w", F.window("ts", step)["start"])
    errors = cut.groupBy("w").agg(F.avg(F.col("error").cast("int")).alias("errors"))
    by_window = errors.join(order_statistics(cut, ["w"], "latency", {"p95": interpolated(0.95)}), "w", "left")
    bad = F.count_if(~((F.col("p95") < most_p95) & (F.col("errors") < most_errors)))
    return by_window.agg(F.count("*").alias("windows"), bad.alias("failed")).withColumn("passed", F.col("failed") <= failures)


def split_traffic(key: Column, percent: int = 10) -> Column:
    """Which side a key goes to, by the first 32 bits of its MD5: the same side in every run and engine."""
    place = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100
    return F.when(place < percent, "canary").otherwise("stable")


def request_timings(marks: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """(by.., ts) -> (by.., latency, a column for each stage): seconds from a request's first mark to its last, and to
    the first mark of each stage; null for a stage that a request does not reach."""
    clock = F.unix_micros("ts")
    spans = {"latency": F.max(clock), **{name: F.min(F.when(mark, clock)) for name, mark in stages.items()}}
    found = marks.groupBy(*by).agg(F.min(clock).alias("_start"), *[x.alias(name) for name, x in spans.items()])
    return found.select(*by, *[((F.col(name) - F.col("_start")) / 1e6).alias(name) for name in spans])


def save_reference(rows: DataFrame, path: str) -> None:
    """The centroid of all vectors, for ``monitor``."""
    centroid(rows, []).write.mode("overwrite").parquet(path)


def monitor(spark: SparkSession, path: str, window: int = 100, threshold: float = 0.15) -> dict | None:
    """Reference and settings of a drift monitor; none, so no monitoring, where no reference was saved."""
    try:
        found = spark.read.parquet(path).head()  # one vector
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return {"reference": found["centroid"], "window": window, "threshold": threshold}


def moving_average(rows: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.2) -> DataFrame:
    """The exponential moving average of each group's values in order, the first one seeding it.

    A value's weight follows from its place counted from the last, so no group's values are gathered.
    """
    w = Window.partitionBy(*by)
    placed = rows.filter(F.col(value).isNotNull()).withColumns({"_back": F.row_number().over(w.orderBy(F.desc(order), F.desc(value))) - 1, "_n": F.count("*").over(w)})
    fade = F.pow(F.lit(1 - alpha), F.col("_back"))
    weight = F.when(F.col("_back") == F.col("_n") - 1, fade).otherwise(alpha * fade)
    return placed.groupBy(*by).agg(F.sum(weight * F.col(value)).alias("ema"), F.count("*").alias("n"))


def centroid(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """The unit mean of each group's unit vectors, and the group's size; means by dimension, combined before the shuffle."""
    parts = rows.select(*by, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return parts.groupBy(*by).agg(mean.alias("mean"), F.max("n").alias("n")).select(*by, unit(F.col("mean")).alias("centroid"), "n")


def drift(window: DataFrame, reference: Column, baseline: Column, least: int = 20, threshold: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """Each group's drift from the reference centroid: 1 - cosine, mean similarity, its drop; null under ``least`` samples."""
    by = by or []
    middles = centroid(window, by)
    similar = window.groupBy(*by).agg(F.avg(dot(unit(F.col("embedding")), reference)).alias("similarity"))
    both = middles.join(similar, by) if by else middles.join(similar, how="cross")
    enough = F.col("n") >= least
    distance = 1 - dot(F.col("centroid"), reference) / F.greatest(norm(reference), F.lit(1e-12))
    return both.select(*by, "n", F.when(enough, distance).alias("drift"), F.when(enough, F.col("similarity")).alias("similarity"), F.when(enough, baseline - F.col("similarity")).alias("similarity_drop"), F.when(enough, distance > threshold).alias("alert"))


def last_window(rows: DataFrame, by: list[str], order: str, n: int = 100) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def exposition(samples: DataFrame) -> DataFrame:
    """(metric, labels map, value) -> (line): one line of text for each sample."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return samples.select(F.concat("metric", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
