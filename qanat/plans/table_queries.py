"""Readers, sinks and the vector table, through files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.operators import index
from qanat.plans.base import query
from qanat.session import ensure_checkpoint_dir
from qanat.sources import readers, sinks, versions
from qanat.sources.tables import table


def folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"


@query("SELECT 'q' || lpad(CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR), 3, '0') AS id, text AS question, '' AS reference, CAST([item_id] AS INTEGER[]) AS expected_articles FROM benchmark")
def evaluation_set(spark: SparkSession, sf: str) -> DataFrame:  # S4 S6 S7 S8: fifty questions to a file, each file one object with odd keys, read back
    path = folder(spark)
    record = F.struct(F.col("item_id"), F.struct(F.col("text").alias("user_input"), F.array(F.struct(F.col("item_id").alias("article_number"))).alias("articles")).alias("r"))
    shelf = F.lpad(F.floor(F.col("item_id") / 50).cast("string"), 9, "0").alias("shelf")
    files = table(spark, sf, "benchmark").groupBy(shelf).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("questions"))).alias("value"))
    files.write.partitionBy("shelf").text(path)
    return readers.evaluation_set(spark, f"{path}/shelf=*/part-*").drop("language", "category")


@query("SELECT doc_id, source, n_chars FROM documents")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:  # K1 S5
    path = folder(spark)
    sinks.write_json(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), path)
    return spark.read.schema("doc_id long, source string, n_chars long").json(path)


@query("SELECT doc_id, source FROM documents")
def csv_allow_list(spark: SparkSession, sf: str) -> DataFrame:  # K2
    path = folder(spark)
    sinks.write_results(table(spark, sf, "documents").select("doc_id", "source", "lang"), path, ["doc_id", "source", "absent"])
    return versions.read(spark, path, "csv")


@query("SELECT label AS article_number, CASE WHEN label = 3 THEN 1 ELSE count(*) END AS chunks, CASE WHEN label = 3 THEN 'new' ELSE 'old' END AS state FROM embeddings GROUP BY label")
def upsert_table(spark: SparkSession, sf: str) -> DataFrame:  # K3 K4 K5 V6 V9: all vectors twice, then one article anew
    path = folder(spark)
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("article_number"), "vec_id", F.lit("old").alias("state"))
    index.ensure(spark, path, lambda: rows, buckets=4)
    index.upsert(spark, path, rows, buckets=4)
    index.upsert(spark, path, rows.filter("article_number = 3").groupBy("article_number").agg(F.min("vec_id").alias("vec_id")).withColumn("state", F.lit("new")), buckets=4)
    return index.read(spark, path).groupBy("article_number", "state").agg(F.count("*").alias("chunks")).select("article_number", "chunks", "state")


@query("SELECT n_name AS name, CAST(n_nationkey + 1 AS BIGINT) AS spans, n_regionkey AS score FROM nation")
def traces(spark: SparkSession, sf: str) -> DataFrame:  # K13
    nation = table(spark, sf, "nation")
    log = nation.select(F.col("n_name").alias("trace_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.map_from_arrays(F.transform(F.sequence(F.lit(0), "n_nationkey"), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(0), "n_nationkey"), lambda i: i.cast("double"))).alias("stages"), F.create_map(F.lit("s"), "n_regionkey", F.lit("none"), F.lit(None).cast("int")).alias("scores"))
    parts = sinks.trace_rows(log)
    spans = parts["spans"].groupBy("trace_id").agg(F.count("*").alias("spans"))
    return parts["traces"].join(spans, "trace_id").join(parts["scores"], "trace_id").select(F.col("trace_id").alias("name"), "spans", F.col("value").alias("score"))


@query("SELECT n_name AS name, md5(n_name || chr(10)) AS md5 FROM nation")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:  # S14
    path = folder(spark)
    table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("name")).write.partitionBy("name").text(path)
    found = readers.file_digests(spark, f"{path}/name=*/part-*")
    return found.select(F.url_decode(F.regexp_extract("path", "name=([^/]*)/", 1)).alias("name"), "md5")


@query("SELECT event_type AS name, CAST(count(*) AS INTEGER) AS requests, CAST(count(*) FILTER (WHERE value > 90) AS INTEGER) AS failures, round(avg(value), 4) AS avg_s FROM events GROUP BY event_type")
def load_test_summary(spark: SparkSession, sf: str) -> DataFrame:  # S11 A26: written as a load generator does, with a row for all
    path, ms = folder(spark), F.col("value") * 1000
    own = lambda *by: table(spark, sf, "events").groupBy(*by).agg(F.count("*").alias("Request Count"), F.count_if(F.col("value") > 90).alias("Failure Count"), F.avg(ms).alias("Average Response Time"), *[F.percentile(ms, q).alias(f"{int(q * 100)}%") for q in (0.5, 0.95, 0.99)])
    rows = own(F.col("event_type").alias("Name")).unionByName(own(F.lit("Aggregated").alias("Name")))
    rows.withColumn("Requests/s", F.col("Request Count") / 60).write.option("header", True).csv(path)
    return readers.load_test(spark, path).select("name", "requests", "failures", F.round("avg_s", 4).alias("avg_s"))


@query("SELECT max(item_id) + 0.5::DOUBLE AS value FROM benchmark WHERE item_id % 7 = 3")
def log_number(spark: SparkSession, sf: str) -> DataFrame:  # S12: the first line of a log in many files that names a size
    path = folder(spark)
    line = F.when(F.col("item_id") % 7 == 3, F.concat(F.lit("weights take "), F.col("item_id") + F.lit(0.5), F.lit(" GiB"))).otherwise(F.concat(F.lit("step "), "item_id"))
    rows = table(spark, sf, "benchmark").withColumn("shelf", F.lpad((999 - F.floor(F.col("item_id") / 9)).cast("string"), 9, "0")).repartition("shelf").sortWithinPartitions("shelf", F.desc("item_id"))
    rows.select("shelf", line.alias("value")).write.partitionBy("shelf").text(path)
    return readers.first_number(spark.read.text(f"{path}/shelf=*/part-*"), r"weights take ([\d.]+) GiB")


@query("SELECT md5(n_name) AS md5 FROM nation WHERE n_nationkey = 4")
def locked_digest(spark: SparkSession, sf: str) -> DataFrame:  # S13
    path = folder(spark)
    entry = F.concat(F.lit("    - path: data/"), "n_nationkey", F.lit(".json\n      hash: md5\n      md5: "), F.md5(F.col("n_name").cast("binary")), F.lit("\n"))
    outs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("entry")))), lambda x: x["entry"]), "")
    table(spark, sf, "nation").agg(F.concat(F.lit("stages:\n  build:\n    outs:\n"), outs).alias("value")).write.text(path)
    return readers.locked_digest(spark, path, "data/4.json")


@query("SELECT n_nationkey AS article_number, n_name AS book FROM nation")
def snapshot_fallback(spark: SparkSession, sf: str) -> DataFrame:  # K7: the second place is the first that is there
    path = folder(spark)
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("article_number"), F.col("n_name").alias("book")))))
    table(spark, sf, "nation").agg(rows.alias("value")).write.text(path)
    return readers.first_readable(spark, [f"{path}-absent", path], "article_number int, book string")


#: Documents' texts as lines of pages: a page ends after every fortieth line.
LAID = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents) "


def _laid_out(spark: SparkSession, sf: str) -> str:
    """A folder with a layout file for each document."""
    path = folder(spark)
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.concat(F.when(k == 0, "").when(k % 40 == 0, "\f").otherwise("\n"), x))
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 8).alias("shelf"), F.concat(F.lit("doc "), "doc_id", F.lit("\n"), F.array_join(lines, ""), F.lit("\f")).alias("value"))
    rows.write.partitionBy("shelf").option("lineSep", "\f").text(path)
    return path


@query(LAID + "SELECT doc_id, k // 40 AS page, k % 40 AS line, x AS text FROM l WHERE trim(x) <> ''")
def layout_pages(spark: SparkSession, sf: str) -> DataFrame:  # S1 S2: texts written as layout files and read back by document, page and line
    found = readers.layout_lines(spark, f"{_laid_out(spark, sf)}/shelf=*/part-*").filter("trim(text) <> ''")
    start = F.when(F.col("text").rlike("^doc [0-9]+$"), F.struct(F.regexp_extract("text", "[0-9]+", 0).cast("long").alias("id"), "page", "line"))
    own = found.withColumn("at", F.last(start, ignorenulls=True).over(Window.partitionBy("document").orderBy("page", "line")))
    line = F.when(F.col("page") == F.col("at.page"), F.col("line") - F.col("at.line")).otherwise(F.col("line"))
    return own.filter(start.isNull()).select(F.col("at.id").alias("doc_id"), (F.col("page") - F.col("at.page")).cast("long").alias("page"), (line - 1).cast("long").alias("line"), "text")


@query("SELECT n_nationkey AS article_number, n_name AS book, 'version 2' AS origin FROM nation UNION ALL SELECT n_nationkey, n_name, 'copy' FROM nation")
def snapshot_restore(spark: SparkSession, sf: str) -> DataFrame:  # K7: copied, restored over a wrong version, and after the loss of all data fetched from the copy
    path, spare = folder(spark), folder(spark)
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("article_number"), F.col("n_name").alias("book"))
    versions.commit(spark, path, {"articles": (rows.limit(0), "json"), "chunks": (rows.limit(0), "parquet")})
    versions.commit(spark, path, {"articles": (rows, "json"), "chunks": (rows, "parquet")})
    versions.copy(spark, path, spare)
    versions.commit(spark, path, {"articles": (rows.withColumn("book", F.lit("wrong")), "json")})
    versions.restore(spark, path, 2)
    restored = versions.read(spark, path, "articles").withColumn("origin", F.lit("version 2"))
    lost = folder(spark)
    found = versions.ensure(spark, lost, ["articles", "chunks"], [f"{lost}-absent", spare])
    return restored.unionByName(versions.read(spark, lost, "chunks").withColumn("origin", F.lit("copy" if found == spare else found)))


@query("SELECT n_name AS key, n_nationkey AS faithfulness FROM nation")
def keyed_records(spark: SparkSession, sf: str) -> DataFrame:  # S6: a file that is one object of records by key
    path = folder(spark)
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_nationkey").alias("faithfulness")))))
    table(spark, sf, "nation").agg(F.to_json(entries).alias("value")).write.text(path)
    return readers.keyed_json(spark, path, "struct<faithfulness:int>")


@query("SELECT metric, 'nightly' AS job, round(value, 6) AS value FROM (SELECT 'quality' AS metric, avg(quality) AS value FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels)")
def pushed_gauges(spark: SparkSession, sf: str) -> DataFrame:  # K11: every metric that is there; the time of the push is left out here
    scores = table(spark, sf, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.lit(None).cast("double").alias("none"))
    return sinks.gauges(scores, "nightly").filter("metric <> 'last_run_timestamp'").select("metric", F.col("labels")["job"].alias("job"), F.round("value", 6).alias("value"))


@query("SELECT item_id, text FROM benchmark ORDER BY md5('42:' || item_id), item_id LIMIT 8")
def question_pool(spark: SparkSession, sf: str) -> DataFrame:  # S17: eight questions by a seed
    return readers.question_pool(table(spark, sf, "benchmark"), 8, 42, "item_id").select("item_id", "text")
