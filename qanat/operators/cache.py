"""Results by content, kept over runs: what was computed for a request once is read, the rest is computed and added.

A request is known by a hash of its key columns and of a fingerprint of what computes it, so another model or setting
never meets old results. The store is a versioned table (``sources.versions``) of two kinds of parts, which are only
added: the requests of a run, with the run's number, and their results. A request without results is kept as well.
Of a request that was computed again the results of the last run count; two runs at one time may both compute a
request, then those of the higher number count.

Defined cases: rows of equal key columns are one request; null key columns are values like others; an empty request
table computes and adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.session import checkpointed
from qanat.sources import versions


def content_key(columns: list[str], fingerprint: str) -> Column:
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(fingerprint + "\n"), whole), 256)


def _parts(spark: SparkSession, path: str, kind: str, now: dict) -> DataFrame | None:
    """All parts of a kind that hold rows, as one table."""
    names = [name for name, part in now["parts"].items() if name.startswith(kind) and part["rows"]]
    if not names:
        return None
    schema = versions.read(spark, path, names[0], now["version"]).schema
    return spark.read.schema(schema).parquet(*[f"{path}/{now['parts'][n]['folder']}" for n in names])


def stored(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(_key) of the requests that are there, and the results (_key, ..) of each one's last run."""
    now = versions.current(spark, path)
    asked = _parts(spark, path, "asked-", now) if now else None
    if asked is None:
        return None, None
    last = asked.groupBy("_key").agg(F.max("_run").alias("_run"))
    found = _parts(spark, path, "found-", now)
    return last.select("_key"), None if found is None else found.join(last, ["_key", "_run"]).drop("_run")


def cached(requests: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame], path: str, fingerprint: str = "", complete: str | None = None) -> DataFrame:
    """``compute`` of the requests, as far as the store at ``path`` does not have it.

    compute takes requests (key columns) and gives rows with the key columns and any others. complete: a condition on
    results; a request with a result that fails it is computed again. Returns the results of all requests.
    """
    spark = requests.sparkSession
    asked = checkpointed(requests.select(*key, content_key(key, fingerprint).alias("_key")).dropDuplicates(["_key"]))
    known, found = stored(spark, path)
    todo = asked
    if known is not None:
        if complete and found is not None:
            known = known.join(found.filter(~F.coalesce(F.expr(complete), F.lit(False))).select("_key"), "_key", "left_anti")
        todo = asked.join(known, "_key", "left_anti")
    if todo.head(1):
        run = versions.top_number(spark, path) + 1
        new = compute(todo.select(*key)).withColumns({"_key": content_key(key, fingerprint), "_run": F.lit(run)})
        name = uuid.uuid4()
        parts = {f"asked-{name}": (todo.select("_key", F.lit(run).alias("_run")), "parquet"), f"found-{name}": (new, "parquet")}
        versions.commit(spark, path, parts, append=True)
        _, found = stored(spark, path)
    if found is None:
        return compute(asked.limit(0).select(*key))
    return found.join(asked.select("_key"), "_key", "left_semi").drop("_key")


def reused(dataset: DataFrame, results: DataFrame, metrics: list[str]) -> DataFrame:
    """Answers of ``dataset`` (id, ..) whose ``results`` (id, metrics..) are complete, with the results, and as free of cost.

    Of an id's rows in either table the last by its content counts.
    """
    one = lambda df: df.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*[F.desc(c) for c, t in df.dtypes if not t.startswith("map")]))).filter("_r = 1").drop("_r")
    scored = one(results.select("id", *[F.col(m).cast("double").alias(m) for m in metrics])).dropna(subset=metrics)
    free = {"cost_usd": F.lit(0.0), "tokens": F.lit(0), "latency_s": F.lit(0.0)}
    return one(dataset.drop(*metrics, *free)).join(scored, "id").withColumns(free)
