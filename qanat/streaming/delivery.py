"""Delivery of notices to a hook, batch by batch: grouped, keyed by content, and not sent again when a batch is replayed.

What a batch has to send is its own messages and those that the batch before could not deliver. The outcome of each is
written under the batch's number in the shared folder, and a batch whose outcome is there sends nothing. As the key is a
hash of the message, a receiver can tell a message that was sent just before a crash kept its outcome from being
written. The hook runs in tasks; one that raises counts as undelivered, it stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.sources.files import exists

#: (key, text) -> whether it was delivered.
Hook = Callable[[str, str], bool]
OUTCOME = "key string, text string, delivered boolean, attempts int"


def accepted(key: str, text: str) -> bool:
    """The stand-in for a hook."""
    return True


def messages(notices: DataFrame, rule: str, wait: int = 10) -> DataFrame:
    """Notices -> (key, text): one message for each kind and ``wait`` seconds, naming the series in order."""
    start = (F.floor(F.col("at") / wait) * wait).alias("start")
    names = F.array_join(F.array_sort(F.collect_set(F.coalesce("series", F.lit("-")))), ", ")
    grouped = notices.groupBy("kind", start).agg(names.alias("names"))
    text = F.concat(F.lit(f"{rule} "), "kind", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "names")
    return grouped.select(F.sha2(text, 256).alias("key"), text.alias("text"))


def try_hook(send: Hook) -> Callable:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for key, text in zip(part["key"], part["text"], strict=True):
                try:
                    done.append(bool(send(key, text)))
                except Exception:  # noqa: BLE001 - hooks are plugged in and may raise anything
                    done.append(False)
            yield part.assign(delivered=done, attempts=part["attempts"] + 1)[["key", "text", "delivered", "attempts"]]

    return run


def deliver(new: DataFrame, number: int, folder: str, send: Hook) -> None:
    """Sends a batch's messages (key, text) and what the batch before left; safe to run again.

    The batch is read once and whole, also when it was delivered before, as a stateful stream needs it to be.
    """
    spark = new.sparkSession
    outbox, outcome = f"{folder}/outbox/batch={number}", lambda n: f"{folder}/outcome/batch={n}"
    new.dropDuplicates(["key"]).write.mode("overwrite").parquet(outbox)
    if exists(spark, f"{outcome(number)}/_SUCCESS"):
        return
    todo = spark.read.schema("key string, text string").parquet(outbox).withColumn("attempts", F.lit(0))
    if exists(spark, f"{outcome(number - 1)}/_SUCCESS"):
        left = spark.read.schema(OUTCOME).parquet(outcome(number - 1)).filter("not delivered").select("key", "text", "attempts")
        todo = left.unionByName(todo.join(left.select("key"), "key", "left_anti"))
    todo.mapInPandas(try_hook(send), OUTCOME).write.mode("overwrite").parquet(outcome(number))


def sink(folder: str, rule: str, send: Hook, wait: int = 10) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``."""

    def put(batch: DataFrame, number: int) -> None:
        deliver(messages(batch, rule, wait), number, folder, send)

    return put


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every attempt, with its batch."""
    return spark.read.schema(OUTCOME + ", batch long").parquet(f"{folder}/outcome")
