"""Structured Streaming over events, embeddings and conversations, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.operators import telemetry
from qanat.plans import telemetry_queries
from qanat.plans.base import ORACLE_SQL, query
from qanat.session import shared_path
from qanat.sources.tables import table
from qanat.streaming import alerts, delivery, stateful
from qanat.streaming.run import drained, finished, latest, source


@query(
    "WITH w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS s, event_type, value, ts FROM events, generate_series(0, 4) g(k)), m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM events) "
    "SELECT epoch(s)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w, m WHERE s + INTERVAL '5 minutes' <= mark GROUP BY s, event_type"
)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:  # T6-T9 in event time: windows that the watermark has closed
    out = finished(stateful.windowed(source(spark, sf, "events")), "append")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(ORACLE_SQL["ema_online"])
def stream_ema(spark: SparkSession, sf: str) -> DataFrame:  # T4 as a stream
    rows = source(spark, sf, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), "value")
    out = latest(finished(stateful.average_stream(rows), "update"), ["stream"])
    return out.select(F.col("stream").cast("long").alias("user_id"), F.round("ema", 6).alias("ema"), "n")


@query(telemetry_queries.LAST + "SELECT CAST(label AS VARCHAR) AS stream, CAST(n AS INTEGER) AS n, round(drift, 6) AS drift, round(similarity, 6) AS similarity, round(1 - similarity, 6) AS similarity_drop, drift > 0.15 AS alert FROM q JOIN g USING (label) WHERE n >= 20")
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:  # T2 T3 as a stream: each label's last vectors against the centroid of all
    middle = telemetry.centroid(table(spark, sf, "embeddings"), []).head()["centroid"]  # one vector
    rows = source(spark, sf, "embeddings").select(F.col("label").cast("string").alias("stream"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = latest(finished(stateful.drift_stream(rows, middle, 1.0), "update"), ["stream"])
    return out.select("stream", "n", *[F.round(c, 6).alias(c) for c in ("drift", "similarity", "similarity_drop")], "alert")


@query("SELECT CAST(conv_id AS VARCHAR) AS request, ltrim(string_agg(text || ' a <', '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def stream_thinking(spark: SparkSession, sf: str) -> DataFrame:  # O12: each turn ends in what could begin a tag
    return _thinking(spark, sf)


def _thinking(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(F.lit("<thi"), F.concat(F.lit("nk>"), "role", F.lit("</thi")), F.concat(F.lit("nk>"), F.col("text"), F.lit(" a <")))
    ends = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("end"))
    rows = source(spark, sf, "conversations").join(ends, "conv_id").select(F.col("conv_id").cast("string").alias("request"), "turn", "end", F.posexplode(parts).alias("i", "delta"))
    deltas = rows.select("request", (F.col("turn") * 3 + F.col("i")).cast("long").alias("seq"), "delta", ((F.col("turn") == F.col("end")) & (F.col("i") == 2)).alias("last"))
    out = finished(stateful.thinking_stream(deltas), "append")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return out.groupBy("request").agg(F.array_join(shown, "").alias("text"))


#: Runs of bad samples among those that the last watermark has passed, with the good sample that ends each, if any.
PASSED = (
    "WITH m AS (SELECT max(epoch_us(ts)) // 1000 AS mark FROM events), s AS (SELECT event_type, epoch_us(ts) AS us, event_id, coalesce(value > 50, false) AS bad FROM events, m WHERE epoch_us(ts) // 1000 < mark), "
    "r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER w AS run, min(CASE WHEN NOT bad THEN us END) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS good FROM s WINDOW w AS (PARTITION BY event_type ORDER BY us, event_id)), "
    "b AS (SELECT *, us // 1000000 AS sec, min(us // 1000000) OVER (PARTITION BY event_type, run) AS since, row_number() OVER (PARTITION BY event_type, run ORDER BY us, event_id) AS k FROM r WHERE bad), "
    "f AS (SELECT event_type, run, since, since + 300 AS fired, min(k) FILTER (WHERE sec - since >= 300) AS fk, max(sec) AS last, count(*) AS n, min(good) // 1000000 AS ended FROM b GROUP BY event_type, run, since HAVING max(sec) - since >= 300), "
    "a AS (SELECT f.*, b.sec AS fsec, lag(fired) OVER (PARTITION BY f.event_type ORDER BY fired) AS before FROM f JOIN b ON b.event_type = f.event_type AND b.run = f.run AND b.k = f.fk) "
)


@query(
    PASSED + ", n AS (SELECT a.event_type, a.run, fired + 3600 * g AS at FROM a, m, generate_series(1, 100) t(g) WHERE fired + 3600 * g < coalesce(ended, mark // 1000)) "
    "SELECT event_type AS series, 'firing' AS kind, fired AS at, since, before FROM a UNION ALL SELECT event_type, 'resolved', ended, since, before FROM a WHERE ended IS NOT NULL "
    "UNION ALL SELECT n.event_type, 'repeat', n.at, since, before FROM n JOIN a USING (event_type, run)"
)
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:  # T10 T11 as a stream: notices of firing, hourly reminders and resolution by event-time timers
    return finished(_notices(spark, sf), "append").select("series", "kind", "at", "since", "before")


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    rows = source(spark, sf, "events").withColumn("id", F.col("event_id"))
    return alerts.alert_stream(rows, F.col("value") > 50, 300, "event_type")


@query(
    PASSED + ", e AS (SELECT 'firing' AS kind, fired AS moment, event_type FROM a UNION ALL SELECT 'resolved', ended, event_type FROM a WHERE ended IS NOT NULL "
    "UNION ALL SELECT 'repeat', fired + 3600 * g, event_type FROM a, m, generate_series(1, 100) t(g) WHERE fired + 3600 * g < coalesce(ended, mark // 1000)) "
    "SELECT 'LatencyHigh ' || kind || ' at ' || (moment // 10 * 10) || ': ' || string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS text, true AS delivered, 1 AS attempts FROM e GROUP BY kind, moment // 10"
)
def alert_delivery(spark: SparkSession, sf: str) -> DataFrame:  # K12 T11: notices of ten seconds in one message, each sent once
    folder = shared_path(spark, "alerts")
    drained(_notices(spark, sf), "append", folder, delivery.sink(folder, "LatencyHigh", delivery.accepted))
    return delivery.outcomes(spark, folder).select("text", "delivered", "attempts")
