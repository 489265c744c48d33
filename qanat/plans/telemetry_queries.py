"""Telemetry over events: value is a latency, error events are failures, users are series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.functions.vectors import dot, unit
from qanat.operators import telemetry as T
from qanat.plans.base import query
from qanat.sources import sinks
from qanat.sources.tables import table


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


LE = ", ".join(f"({b}::DOUBLE)" for b in T.BUCKETS) + ", ('inf'::DOUBLE)"
HISTOGRAM = f"WITH b(le) AS (VALUES {LE}), h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY event_type, le)"


@query(HISTOGRAM + " SELECT event_type, le, n FROM h")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:  # T5
    return T.histogram(events(spark, sf), "value", ["event_type"])


@query(
    HISTOGRAM + ", s AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS under, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type) AS want FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS nth FROM s WHERE n >= want AND n > 0) "
    "SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (want - under) / (n - under) END, 6) AS quantile FROM f WHERE nth = 1"
)
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:  # T8
    return T.histogram_quantile(T.histogram(events(spark, sf), "value", ["event_type"]), 0.95, ["event_type"]).select("event_type", F.round("quantile", 6).alias("quantile"))


#: A counter for each event type: whole values, reset at each hundredth sample.
COUNTER = (
    "WITH c AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, (event_id % 100) * 1.0::DOUBLE AS value FROM events), "
    "d AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM c), "
    "i AS (SELECT event_type, ts, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS delta FROM d)"
)


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_type", F.struct(F.unix_timestamp("ts").alias("s"), "event_id").alias("ts"), (F.col("event_id") % 100).cast("double").alias("value"), F.col("ts").alias("time"))
    return T.increases(rows, ["event_type"], F.floor(F.col("ts.s") / 86400)).select("event_type", F.col("time").alias("ts"), "delta")


@query(COUNTER + " SELECT event_type, (ts // 15 + k) * 15 AS at, round(sum(delta) / 300.0::DOUBLE, 6) AS value FROM i, generate_series(1, 20) s(k) GROUP BY 1, 2")
def rate_5m(spark: SparkSession, sf: str) -> DataFrame:  # T6
    out = T.over_windows(_deltas(spark, sf), ["event_type"], "5 minutes", "15 seconds", per_second=True)
    return out.select("event_type", F.unix_timestamp("at").alias("at"), F.round("value", 6).alias("value"))


@query(COUNTER + " SELECT event_type, (ts // 1800 + k) * 1800 AS at, round(sum(delta), 6) AS value FROM i, (VALUES (1), (2)) s(k) GROUP BY 1, 2")
def increase_1h(spark: SparkSession, sf: str) -> DataFrame:  # T7
    out = T.over_windows(_deltas(spark, sf), ["event_type"], "1 hour", "30 minutes", per_second=False)
    return out.select("event_type", F.unix_timestamp("at").alias("at"), F.round("value", 6).alias("value"))


@query("SELECT event_type, count(*) AS n, round(arg_max(value, (ts, event_id)), 6) AS latest FROM events GROUP BY event_type")
def latest_gauges(spark: SparkSession, sf: str) -> DataFrame:  # T9
    rows = events(spark, sf)
    last = T.latest(rows.select("event_type", "value", F.struct("ts", "event_id").alias("ts")), ["event_type"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).join(last.select("event_type", F.round("value", 6).alias("latest")), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS error_rate FROM events GROUP BY 1")
def error_rate(spark: SparkSession, sf: str) -> DataFrame:  # T9 T13
    return events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("error_rate"))


ALERTS = (
    "WITH s AS (SELECT event_type, ts AS moment, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, value > 50 AS bad FROM events), r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY moment, event_id) AS run FROM s), "
    "a AS (SELECT event_type, run, min(ts) AS since, max(ts) AS until, count(*) AS n FROM r WHERE bad GROUP BY 1, 2)"
)


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select("event_type", "value", "ts", F.struct("ts", "event_id").alias("at"))
    return T.alerts_for(rows, F.col("value") > 50, 300, ["event_type"], "at", F.to_date("ts"))


@query(ALERTS + " SELECT event_type, since, since + 300 AS fired, until, n FROM a WHERE until - since >= 300")
def alert_for(spark: SparkSession, sf: str) -> DataFrame:  # T10, with the event id as the order of equal times
    return _alerts(spark, sf)


@query(ALERTS + ", f AS (SELECT event_type, since + 300 AS fired FROM a WHERE until - since >= 300), p AS (SELECT *, lag(fired) OVER (PARTITION BY event_type ORDER BY fired) AS before FROM f) SELECT event_type, fired FROM p WHERE before IS NULL OR fired - before >= 3600")
def alert_repeat(spark: SparkSession, sf: str) -> DataFrame:  # T11
    return T.repeated(_alerts(spark, sf).select("event_type", "fired"), ["event_type"], 3600)


@query("SELECT doc_id, quality FROM labels WHERE quality < 0.8")
def threshold_alert(spark: SparkSession, sf: str) -> DataFrame:  # T12 K12
    rows = table(spark, sf, "labels").select("doc_id", "quality", F.col("quality").cast("double").alias("faithfulness"))
    return sinks.alerts(rows, 0.8).select("doc_id", "quality")


@query(
    "WITH w AS (SELECT date_trunc('day', ts) AS d, quantile_cont(value, 0.95) AS p95, avg(CAST(event_type = 'error' AS INTEGER)) AS e FROM events GROUP BY 1) "
    "SELECT count(*) AS windows, count(*) FILTER (WHERE NOT (p95 < 10.0 AND e < 0.05)) AS failed, count(*) FILTER (WHERE NOT (p95 < 10.0 AND e < 0.05)) <= 1 AS passed FROM w"
)
def canary_analysis(spark: SparkSession, sf: str) -> DataFrame:  # T13
    return T.canary(events(spark, sf).select("ts", F.col("value").alias("latency"), (F.col("event_type") == "error").alias("error")), "1 day")


@query("SELECT CASE WHEN ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 10 THEN 'canary' ELSE 'stable' END AS side, count(*) AS n FROM events GROUP BY 1")
def traffic_split(spark: SparkSession, sf: str) -> DataFrame:  # T14
    return events(spark, sf).groupBy(T.split_traffic(F.col("event_id")).alias("side")).agg(F.count("*").alias("n"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL), "
    "e AS (SELECT user_id, i, CAST(value AS DOUBLE) AS ema FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, e.ema + 0.2::DOUBLE * (o.value - e.ema) FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1) "
    "SELECT user_id, round(arg_max(ema, i), 6) AS ema, max(i) AS n FROM e GROUP BY user_id"
)
def ema_online(spark: SparkSession, sf: str) -> DataFrame:  # T4
    return T.moving_average(events(spark, sf), ["user_id"], "event_id", "value").select("user_id", F.round("ema", 6).alias("ema"), "n")


UNITS = (
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v), "
    "p AS (SELECT vec_id, label, unnest(e) AS x, unnest(generate_series(1, len(e))) AS i FROM u), "
    "m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label), c AS (SELECT m.label, i, x / n AS x FROM m JOIN n USING (label)), "
    "am AS (SELECT i, avg(x) AS x FROM p GROUP BY i), ac AS (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM am) AS x FROM am)"
)


@query(UNITS + " SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM c")
def centroid(spark: SparkSession, sf: str) -> DataFrame:  # T1
    rows = T.centroid(table(spark, sf, "embeddings"), ["label"])
    return rows.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def _reference(spark: SparkSession, sf: str) -> DataFrame:
    return T.centroid(table(spark, sf, "embeddings"), []).select(F.col("centroid").alias("ref"))


@query(
    UNITS + ", s AS (SELECT p.label, p.vec_id, sum(p.x * ac.x) AS d FROM p JOIN ac USING (i) GROUP BY 1, 2), k AS (SELECT label, avg(d) AS similarity, count(*) AS n FROM s GROUP BY label), "
    "g AS (SELECT c.label, 1 - sum(c.x * ac.x) AS drift FROM c JOIN ac USING (i) GROUP BY 1) SELECT label, n, round(drift, 6) AS drift, round(similarity, 6) AS similarity, drift > 0.15 AS alert FROM g JOIN k USING (label)"
)
def drift_by_label(spark: SparkSession, sf: str) -> DataFrame:  # T2 T3: each label against the centroid of all
    ref = _reference(spark, sf).head()["ref"]  # one vector
    reference = F.array(*[F.lit(float(x)) for x in ref])
    out = T.drift(table(spark, sf, "embeddings"), reference, F.lit(1.0), by=["label"])
    return out.select("label", "n", F.round("drift", 6).alias("drift"), F.round("similarity", 6).alias("similarity"), "alert")


#: The last hundred vectors of each label against the centroid of all.
LAST = (
    UNITS + ", k AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings) WHERE r <= 100), l AS (SELECT p.* FROM p SEMI JOIN k USING (vec_id)), "
    "s AS (SELECT label, vec_id, sum(l.x * ac.x) AS d FROM l JOIN ac USING (i) GROUP BY 1, 2), q AS (SELECT label, avg(d) AS similarity, count(*) AS n FROM s GROUP BY label), "
    "wm AS (SELECT label, i, avg(x) AS x FROM l GROUP BY 1, 2), wn AS (SELECT label, sqrt(sum(x * x)) AS size FROM wm GROUP BY label), "
    "g AS (SELECT label, 1 - sum(wm.x * ac.x) / any_value(size) AS drift FROM wm JOIN wn USING (label) JOIN ac USING (i) GROUP BY label) "
)


@query(LAST + "SELECT label, n, round(CASE WHEN n >= 20 THEN drift END, 6) AS drift, round(CASE WHEN n >= 20 THEN similarity END, 6) AS similarity, CASE WHEN n >= 20 THEN drift > 0.15 END AS alert FROM q JOIN g USING (label)")
def drift_window(spark: SparkSession, sf: str) -> DataFrame:  # T2: the last vectors of each stream
    ref = _reference(spark, sf).head()["ref"]  # one vector
    last = T.last_window(table(spark, sf, "embeddings"), ["label"], "vec_id")
    out = T.drift(last, F.array(*[F.lit(float(x)) for x in ref]), F.lit(1.0), by=["label"])
    return out.select("label", "n", F.round("drift", 6).alias("drift"), F.round("similarity", 6).alias("similarity"), "alert")


@query(UNITS + " SELECT 'saved' AS monitor, true AS enabled, 100 AS window_size, 0.15::DOUBLE AS threshold, round(sum(x), 6) AS reference_sum FROM ac UNION ALL SELECT 'absent', false, NULL, NULL, NULL")
def drift_monitors(spark: SparkSession, sf: str) -> DataFrame:  # T2b: with a saved reference, and where none was saved
    from qanat.plans.table_queries import folder

    path = folder(spark)
    T.save_reference(table(spark, sf, "embeddings"), path)
    found = {"saved": T.monitor(spark, path), "absent": T.monitor(spark, f"{path}-absent")}
    rows = [(k, m is not None, m and m["window"], m and m["threshold"], m and sum(m["reference"])) for k, m in found.items()]
    out = spark.createDataFrame(rows, "monitor string, enabled boolean, window_size int, threshold double, reference_sum double")
    return out.withColumn("reference_sum", F.round("reference_sum", 6))


@query(
    "WITH m AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS e, min(epoch_us(ts)) FILTER (WHERE event_type = 'view') AS v, min(epoch_us(ts)) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1, 2) "
    "SELECT user_id, day, round((e - s) / 1e6::DOUBLE, 6) AS latency, round((v - s) / 1e6::DOUBLE, 6) AS retrieval, round((c - s) / 1e6::DOUBLE, 6) AS ttft FROM m"
)
def request_timings(spark: SparkSession, sf: str) -> DataFrame:  # T17: a user's day is a request, its first view the end of retrieval, its first click the first token
    marks = events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = T.request_timings(marks, ["user_id", "day"], {"retrieval": F.col("event_type") == "view", "ttft": F.col("event_type") == "click"})
    return out.select("user_id", "day", *[F.round(c, 6).alias(c) for c in ("latency", "retrieval", "ttft")])


@query(
    UNITS + ", s AS (SELECT p.vec_id, sum(p.x * ac.x) AS d FROM p JOIN ac USING (i) GROUP BY 1) SELECT round(avg(d), 6) AS baseline FROM s"
)
def drift_baseline(spark: SparkSession, sf: str) -> DataFrame:  # T1 T16
    rows = table(spark, sf, "embeddings").join(F.broadcast(_reference(spark, sf)))  # one vector
    return rows.agg(F.round(F.avg(dot(unit(F.col("embedding")), F.col("ref"))), 6).alias("baseline"))


@query("SELECT 'requests_total{status=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def exposition(spark: SparkSession, sf: str) -> DataFrame:  # K16
    rows = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("value"))
    return T.exposition(rows.select(F.lit("requests_total").alias("metric"), F.create_map(F.lit("status"), F.col("event_type")).alias("labels"), "value"))


@query(
    "WITH c AS (SELECT count(*) AS chunks, count(DISTINCT label) AS articles FROM embeddings) SELECT 'there' AS place, 'healthy' AS status, chunks, articles, articles AS documents, false AS failed FROM c "
    "UNION ALL SELECT 'empty', 'unhealthy', 0, 0, 0, false UNION ALL SELECT 'absent', 'unhealthy', 0, 0, 0, true"
)
def health(spark: SparkSession, sf: str) -> DataFrame:  # T15: of a table, of one without rows and of one that is not there
    from qanat.operators import index

    chunks = table(spark, sf, "embeddings").withColumnRenamed("label", "article_number")
    places = {"there": lambda: chunks, "empty": lambda: chunks.filter("false"), "absent": lambda: spark.read.parquet(f"{sf}/absent.parquet")}
    found = [(k, index.health(read, {}, 0.0)) for k, read in places.items()]
    rows = [(k, h["status"], h["chunks"], h["articles"], h["documents"], h["detail"] is not None) for k, h in found]
    return spark.createDataFrame(rows, "place string, status string, chunks long, articles long, documents long, failed boolean")
