"""Evaluation aggregates over labels, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.operators import evaluate as E
from qanat.operators.order import interpolated, order_statistics
from qanat.plans.base import query
from qanat.sources import sinks
from qanat.sources.tables import table

#: Labelled documents as scored answers: quality is one metric, a length share the other, null for toxic rows.
ROWS = "WITH r AS (SELECT doc_id, lang, source, CAST(quality AS DOUBLE) AS faithfulness, CASE WHEN toxic = 0 THEN least(n_chars, 4000) / 4000.0::DOUBLE END AS relevancy FROM documents JOIN labels USING (doc_id))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", F.col("quality").cast("double").alias("faithfulness"), F.when(F.col("toxic") == 0, F.least("n_chars", F.lit(4000)) / F.lit(4000.0)).alias("relevancy"))


@query(ROWS + " SELECT lang, round(avg(faithfulness), 6) AS faithfulness, count(faithfulness) AS faithfulness_n, round(avg(relevancy), 6) AS relevancy, count(relevancy) AS relevancy_n FROM r GROUP BY lang")
def metric_aggregate(spark: SparkSession, sf: str) -> DataFrame:  # A4 A8 A21
    out = E.metric_means(scored(spark, sf), ["faithfulness", "relevancy"], ["lang"])
    return out.select("lang", F.round("faithfulness", 6).alias("faithfulness"), "faithfulness_n", F.round("relevancy", 6).alias("relevancy"), "relevancy_n")


@query("SELECT round(avg(CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE CAST(quality = toxic AS INTEGER) END), 6) AS hit_rate, count(*) FILTER (WHERE l.doc_id % 5 <> 0) AS n FROM labels l")
def hit_rate(spark: SparkSession, sf: str) -> DataFrame:  # A9: quality is retrieved, toxic expected, nothing for each fifth
    rows = table(spark, sf, "labels").select(F.array("quality").alias("retrieved"), F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("toxic").cast("int"))).alias("expected"))
    return E.hit_rate(rows.withColumn("retrieved", F.col("retrieved").cast("array<int>"))).select(F.round("hit_rate", 6).alias("hit_rate"), "n")


PAIRS = "WITH p AS (SELECT doc_id // 2 AS pair_id, max(CASE WHEN doc_id % 2 = 0 THEN quality END) AS ar, max(CASE WHEN doc_id % 2 = 1 THEN quality END) AS en, count(*) = 2 AS \"both\" FROM labels GROUP BY 1) "


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 2).alias("pair_id"), F.when(F.col("doc_id") % 2 == 0, "ar").otherwise("en").alias("language"), F.col("quality").alias("top1"))


@query(PAIRS + "SELECT round(coalesce(avg(CAST(ar IS NOT DISTINCT FROM en AS INTEGER)) FILTER (WHERE \"both\"), 0), 6) AS complete, round(avg(CAST(\"both\" AND ar IS NOT DISTINCT FROM en AS INTEGER)), 6) AS every FROM p")
def bilingual_consistency(spark: SparkSession, sf: str) -> DataFrame:  # A5 A6 R17
    rows = _pairs(spark, sf)
    a, b = E.consistency(rows, "complete"), E.consistency(rows, "all")
    return a.select(F.round("consistency", 6).alias("complete")).join(b.select(F.round("consistency", 6).alias("every")))


@query(PAIRS + "SELECT pair_id, ar, en, \"both\" FROM p")
def bilingual_pivot(spark: SparkSession, sf: str) -> DataFrame:  # R17
    return E.pair_tops(_pairs(spark, sf)).select("pair_id", "ar", "en", "both")


@query("WITH p AS (SELECT doc_id // 2 AS pair_id, count(DISTINCT quality) AS tops, count(*) AS n FROM labels GROUP BY 1) SELECT round(coalesce(avg(CAST(tops = 1 AS INTEGER)), 0), 6) AS consistency, count(*) AS pairs FROM p WHERE n = 2")
def bilingual_by_id(spark: SparkSession, sf: str) -> DataFrame:  # A6b A7: the pair is the id before its last underscore
    rows = table(spark, sf, "labels").select(F.concat(F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, "_ar").otherwise("_en")).alias("id"), F.col("quality").alias("top1"))
    named = rows.select(E.pair_of(F.col("id")).alias("pair_id"), F.substring_index("id", "_", -1).alias("language"), "top1")
    return E.consistency(named, "strict").select(F.round("consistency", 6).alias("consistency"), "pairs")


@query(
    ROWS + ", m AS (SELECT source, count(*) AS n, avg(faithfulness) AS f, count(relevancy) AS scored FROM r GROUP BY source), "
    "p AS (SELECT source, list_filter([CASE WHEN n < 15 THEN n || ' questions, at least 15 needed' END, CASE WHEN f < 0.9 THEN 'faithfulness ' || printf('%.4f', f) || ' below 0.9' END, CASE WHEN scored < 0.8 * n THEN scored || ' of ' || n || ' questions scored for faithfulness' END], lambda x: x IS NOT NULL) AS problems FROM m) "
    "SELECT source, array_to_string(problems, '; ') AS problems, len(problems) = 0 AS passed FROM p"
)
def gate_problems(spark: SparkSession, sf: str) -> DataFrame:  # A19 A20
    means = scored(spark, sf).groupBy("source").agg(F.count("*").alias("n_questions"), F.avg("faithfulness").alias("faithfulness"), F.count("relevancy").alias("faithfulness_n"))
    return E.gate_problems(means, 0.9, 15).select("source", F.array_join("problems", "; ").alias("problems"), "passed")


@query(
    "WITH m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE 'after' END AS mode, avg(quality) AS quality, avg(toxic) AS toxic FROM labels GROUP BY 1) "
    "SELECT metric, round(max(CASE WHEN mode = 'before' THEN value END), 6) AS before, round(max(CASE WHEN mode = 'after' THEN value END), 6) AS after, round(max(CASE WHEN mode = 'after' THEN value END) - max(CASE WHEN mode = 'before' THEN value END), 6) AS delta "
    "FROM (SELECT mode, 'quality' AS metric, quality AS value FROM m UNION ALL SELECT mode, 'toxic', toxic FROM m) GROUP BY metric"
)
def improvement_delta(spark: SparkSession, sf: str) -> DataFrame:  # A13
    rows = table(spark, sf, "labels").groupBy(F.when(F.col("doc_id") % 2 == 0, "before").otherwise("after").alias("mode")).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    out = E.improvement(rows, "before", "after", ["quality", "toxic"])
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query(ROWS + " SELECT source FROM r GROUP BY source ORDER BY avg(faithfulness) DESC, avg(relevancy) DESC, source LIMIT 1")
def best_config(spark: SparkSession, sf: str) -> DataFrame:  # A14
    rows = scored(spark, sf).groupBy("source").agg(F.avg("faithfulness").alias("f"), F.avg("relevancy").alias("r"))
    return E.best_row(rows, ["f", "r"], "source").select("source")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:  # A11
    out = order_statistics(table(spark, sf, "events"), ["event_type"], "value", {"p50": interpolated(0.5), "p95": interpolated(0.95)})
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "WITH o AS (SELECT event_type AS label, quantile_cont(value, 0.5) AS p50, sum(event_id % 100) / 60.0::DOUBLE AS t, avg((event_id % 10) / 10.0::DOUBLE) AS f FROM events GROUP BY 1), b AS (SELECT * FROM o WHERE label = 'view') "
    "SELECT o.label, round(o.t, 6) AS tokens_per_s, round(b.f - o.f, 6) AS drop, b.f - o.f < 0.03 AS passed, round(b.p50 / o.p50, 6) AS speed FROM o, b"
)
def quantisation_report(spark: SparkSession, sf: str) -> DataFrame:  # A16 A17
    rows = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("value").alias("latency"), (F.col("event_id") % 100).alias("output_tokens"), F.lit(60.0).alias("wall"), ((F.col("event_id") % 10) / F.lit(10.0)).alias("faithfulness"))
    return E.quantisation(rows, "view").select("label", F.round("tokens_per_s", 6).alias("tokens_per_s"), F.round("drop", 6).alias("drop"), "passed", F.round("speed", 6).alias("speed"))


@query(
    "WITH r AS (SELECT CASE WHEN event_type = 'view' THEN 'big' ELSE 'small' END AS m, value AS ms, CAST(event_id % 3 = 0 AS INTEGER) AS r5, 1.0::DOUBLE / (1 + event_id % 4) AS rr FROM events) "
    "SELECT round(avg(ms) FILTER (WHERE m = 'big') / avg(ms) FILTER (WHERE m = 'small'), 6) AS speedup, 4.0::DOUBLE AS size_ratio, round(avg(r5) FILTER (WHERE m = 'small') / avg(r5) FILTER (WHERE m = 'big'), 6) AS retained_recall, round(avg(rr) FILTER (WHERE m = 'small'), 6) AS mrr FROM r"
)
def distillation_report(spark: SparkSession, sf: str) -> DataFrame:  # A15
    rows = table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "big").otherwise("small").alias("model"), F.col("value").alias("ms"), (F.col("event_id") % 3 == 0).cast("int").alias("r5"), (1 / (1 + F.col("event_id") % 4)).alias("rr"))
    out = E.distillation(rows, {"big": 400, "small": 100}, "big", "small")
    return out.select(F.round("speedup", 6).alias("speedup"), "size_ratio", F.round("retained_recall", 6).alias("retained_recall"), F.round("mrr", 6).alias("mrr"))


@query(
    "WITH r AS (SELECT user_id AS qid, value / 100.0::DOUBLE AS t, (event_id % 7) / 7.0::DOUBLE AS s FROM events), z AS (SELECT *, sum(exp(t)) OVER w AS tz, sum(exp(s)) OVER w AS sz FROM r WINDOW w AS (PARTITION BY qid)), "
    "k AS (SELECT qid, sum((t - s) ** 2) AS e, count(*) AS n, sum(exp(t) / tz * ((t - ln(tz)) - (s - ln(sz)))) AS kl FROM z GROUP BY qid) SELECT round(sum(e) / sum(n), 6) AS mse, round(avg(kl), 6) AS kl, round(sum(e) / sum(n) + avg(kl), 6) AS loss FROM k"
)
def distillation_loss(spark: SparkSession, sf: str) -> DataFrame:  # A23
    rows = table(spark, sf, "events").select(F.col("user_id").alias("qid"), (F.col("value") / F.lit(100.0)).alias("teacher"), ((F.col("event_id") % 7) / F.lit(7.0)).alias("student"))
    return E.distillation_loss(rows).select(*[F.round(c, 6).alias(c) for c in ("mse", "kl", "loss")])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS id, coalesce(CAST(l.quality AS DOUBLE), d.n_chars / 1000.0::DOUBLE) AS faithfulness FROM documents d FULL JOIN (SELECT * FROM labels WHERE toxic = 0) l ON d.doc_id = l.doc_id")
def score_merge(spark: SparkSession, sf: str) -> DataFrame:  # R16
    new = table(spark, sf, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("faithfulness"))
    return E.merge_scores(new, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / F.lit(1000.0)).alias("faithfulness")), ["faithfulness"])


@query(ROWS + " SELECT d.doc_id AS id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT doc_id FROM r WHERE relevancy IS NULL")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:  # R15 P17
    done = scored(spark, sf).select(F.col("doc_id").alias("id"), "faithfulness", "relevancy")
    return E.to_do(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), done, ["faithfulness", "relevancy"], retry=True)


@query("SELECT 'run' AS run_id, metric, round(value, 6) AS value FROM (SELECT 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM labels UNION ALL SELECT 'quality', avg(quality) FROM labels)")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:  # K9 S15: null and NaN metrics are left out
    row = table(spark, sf, "labels").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.lit(None).cast("double").alias("none"), F.lit(float("nan")).alias("nan"))
    return sinks.run_metrics("run", row).select("run_id", "metric", F.round("value", 6).alias("value"))


@query("SELECT n_name AS name, n_nationkey AS version, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1 THEN 'production' ELSE 'archived' END AS alias FROM nation")
def registry_alias(spark: SparkSession, sf: str) -> DataFrame:  # K10
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("name"), F.col("n_nationkey").alias("version"), "n_name")
    return sinks.registry(rows).select(F.col("n_name").alias("name"), "version", "alias")


@query("SELECT '| region | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name) AS report FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:  # K8 A24 A26
    rows = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"))
    return sinks.markdown(rows, ["region", "n"], "region")


@query(
    ROWS + ", m AS (SELECT lang, count(*) AS n, printf('%.3f', avg(faithfulness)) AS f FROM r GROUP BY lang), e AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) "
    "SELECT '# Evidence' || chr(10) || chr(10) || '## Quality by language' || chr(10) || chr(10) || '| lang | n | faithfulness |' || chr(10) || '|---|---|---|' || chr(10) || (SELECT string_agg('| ' || lang || ' | ' || n || ' | ' || f || ' |', chr(10) ORDER BY lang) FROM m) || chr(10) || chr(10) || 'Alert rule: faithfulness < 0.80' "
    "|| chr(10) || chr(10) || '## Requests' || chr(10) || chr(10) || '| event_type | n |' || chr(10) || '|---|---|' || chr(10) || (SELECT string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) FROM e) "
    "|| chr(10) || chr(10) || '## Missing' || chr(10) || chr(10) || '- Drift: run the drift demo' || chr(10) || '- Ablation: no file' AS report, 2 AS missing"
)
def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:  # A24: sections where there is something, a list of what there is not
    means = scored(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.format_string("%.3f", F.avg("faithfulness")).alias("faithfulness"))
    requests = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.evidence(
        spark, "Evidence",
        [
            sinks.Section("Quality by language", means, ("lang", "n", "faithfulness"), "lang", "run the evaluation", "Alert rule: faithfulness < 0.80"),
            sinks.Section("Drift", requests.limit(0), ("event_type", "n"), "event_type", "run the drift demo"),
            sinks.Section("Requests", requests, ("event_type", "n"), "event_type", "run the load test"),
            sinks.Section("Ablation", None, ("mode", "mrr"), "mode", "no file"),
        ],
    )
