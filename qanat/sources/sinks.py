"""Sinks: JSON and CSV results, run and registry tables, metrics, alerts, traces, text reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed
from qanat.sources import versions
from qanat.sources.files import exists


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_results(rows: DataFrame, path: str, fields: list[str]) -> None:
    """JSON with all columns and CSV with the listed ones, as parts of one version: committed both or not at all."""
    rows = checkpointed(rows)  # both hold the same rows
    listed = rows.select([f for f in fields if f in rows.columns])
    versions.commit(rows.sparkSession, path, {"json": (rows, "json"), "csv": (listed, "csv")})


def run_metrics(run_id: str, values: DataFrame) -> DataFrame:
    """A one-row table of results -> (run_id, metric, value): numbers that are there and not NaN."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [n for n, t in values.dtypes if t in kinds]
    long = values.select(*[F.col(n).cast("double") for n in names]).unpivot([], names, "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.lit(run_id).alias("run_id"), "metric", "value")


def log_run(path: str, run_id: str, params: dict[str, str], values: DataFrame) -> None:
    spark = values.sparkSession
    spark.createDataFrame([(run_id, k, str(v)) for k, v in params.items()], "run_id string, param string, value string").write.mode("append").parquet(f"{path}/params")
    run_metrics(run_id, values).write.mode("append").parquet(f"{path}/metrics")


def promote(path: str, spark: SparkSession, name: str, config: str) -> None:
    """Appends the next version of a registered configuration; earlier ones are archived by ``registry``."""
    top = 0
    if exists(spark, path):
        top = spark.read.parquet(path).filter(F.col("name") == name).agg(F.max("version")).head()[0] or 0
    spark.createDataFrame([(name, top + 1, config)], "name string, version int, config string").write.mode("append").parquet(path)


def registry(rows: DataFrame) -> DataFrame:
    """Versions with their alias: production for the newest of each name, archived for the others."""
    newest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version"))) == 1
    return rows.withColumn("alias", F.when(newest, "production").otherwise("archived"))


def gauges(scores: DataFrame, job: str) -> DataFrame:
    """A row of scores -> (metric, labels, value), and when they were pushed."""
    found = run_metrics(job, scores).select("metric", F.create_map(F.lit("job"), F.lit(job)).alias("labels"), "value")
    return found.unionByName(scores.limit(1).select(F.lit("last_run_timestamp").alias("metric"), F.create_map(F.lit("job"), F.lit(job)).alias("labels"), F.unix_timestamp(F.current_timestamp()).cast("double").alias("value")))


def alerts(scores: DataFrame, threshold: float, metric: str = "faithfulness") -> DataFrame:
    """The rows whose score is there and below the threshold."""
    return scores.filter(F.col(metric) < threshold).withColumn("message", F.format_string(f"{metric} %.3f is below {threshold}", metric))


def append_alerts(found: DataFrame, path: str) -> None:
    found.write.mode("append").json(path)


def trace_rows(log: DataFrame) -> dict[str, DataFrame]:
    """A request log (trace_id, question, answer, stages map, scores map) -> traces, spans and scores."""
    return {
        "traces": log.select("trace_id", "question", "answer"),
        "spans": log.select("trace_id", F.explode("stages").alias("span", "seconds")),
        "scores": log.select("trace_id", F.explode("scores").alias("name", "value")).filter("value is not null"),
    }


def _head(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"


def markdown(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row with a Markdown table."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = _head(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("report"))


@dataclass(frozen=True)
class Section:
    """A part of a summary: a table of rows (at most about a page of them), or what to do where there are none."""

    title: str
    rows: DataFrame | None
    columns: tuple[str, ...]
    order: str
    hint: str
    note: str = ""


def evidence(spark: SparkSession, title: str, sections: list[Section]) -> DataFrame:
    """(report, missing): Markdown of the sections that have rows, in order, and a list of those that have none."""
    empty = spark.createDataFrame([], "report string")
    out = None
    for i, s in enumerate(sections):
        table = empty if s.rows is None else markdown(s.rows, list(s.columns), s.order).filter(F.length("report") > len(_head(list(s.columns))))
        found = table.agg(F.max("report").alias("body"))
        text = F.concat(F.lit(f"## {s.title}\n\n"), "body", F.lit(f"\n\n{s.note}" if s.note else ""))
        part = found.select(F.lit(i).alias("i"), text.alias("text"), F.when(F.col("body").isNull(), F.lit(f"- {s.title}: {s.hint}")).alias("missing"))
        out = part if out is None else out.unionByName(part)
    ordered = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("i", c)))), lambda x: x[c]), by)
    parts = out.agg(ordered("text", "\n\n").alias("text"), ordered("missing", "\n").alias("missing"))
    lacking = F.when(F.col("missing") != "", F.concat(F.lit("\n\n## Missing\n\n"), "missing")).otherwise("")
    return parts.select(F.concat(F.lit(f"# {title}\n\n"), "text", lacking).alias("report"), F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", "\n"))).alias("missing"))


def stream_text(answer: Column, sources: Column) -> Column:
    return F.concat(answer, F.lit("\n\nSources: "), F.array_join(sources, "; "), F.lit("\n"))
