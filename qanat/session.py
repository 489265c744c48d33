"""Session factory, the shared checkpoint folder, and broadcasts behind a check of size."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "qanat", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, Arrow and AQE; a cluster's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only in local mode, where it is unset in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "qanat-checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(rows: DataFrame, most: int = 1000, most_bytes: int = 4 << 20) -> DataFrame:
    """``rows``, whose session from here on hands fewer of them, and of their bytes, to Python at a time, unless its own configuration says how many.

    A batch of texts is held by the executor outside its heap and by the worker, so its size adds to both.
    """
    spark = rows.sparkSession
    for name, value in ((BATCH, most), (BATCH_BYTES, most_bytes)):
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, str(value))
    return rows


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of this name in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared checkpoint folder; unlike a checkpoint it can be read by column."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be broadcast if it has ``most`` rows or fewer, else as it is; it is counted, so it should be written already."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def cleared(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more; it does so only after a collection of the driver's heap, which may come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
