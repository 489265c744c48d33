"""Runs a streaming query over what is there now and hands back what it put out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.session import shared_path


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.[p]arquet")  # a pattern may name a file or a folder


def drained(stream: DataFrame, mode: str, folder: str, put: Callable[[DataFrame, int], None]) -> None:
    """Hands all there is to ``put``, batch by batch; run again over more input, it goes on where it ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def finished(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All output rows with their batch number, written batch by batch to the shared folder, where state lies as well."""
    folder = folder or shared_path(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch that is run again replaces itself

    drained(stream, mode, folder, put)
    return stream.sparkSession.read.parquet(f"{folder}/out")


def latest(out: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, the row of the last batch."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
