"""Sums of long count vectors over all tasks, as a tree of bounded steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts of a piece of a vector, and rows of one piece that a task adds up.
CHUNK, FAN = 1 << 14, 1024
SCHEMA = "chunk int, at binary, counts binary"


def pieces(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counts that are not 0 of a vector, piece by piece: (chunk, places, counts)."""
    out: list[list] = [[], [], []]
    for c in range(0, len(counts), CHUNK):
        at = np.flatnonzero(counts[c : c + CHUNK])
        if len(at):
            for to, v in zip(out, (c // CHUNK, at.astype(np.uint16).tobytes(), counts[c : c + CHUNK][at].astype(np.int64).tobytes()), strict=True):
                to.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["chunk", "at", "counts"])


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' vectors, of ``size`` places. Only this one vector reaches the driver."""

    def add(own: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for at, n in zip(own.column("at").to_pylist(), own.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        at = np.flatnonzero(total)
        return pa.table({"chunk": own.column("chunk").slice(0, 1), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "counts": pa.array([total[at].tobytes()], pa.binary())})

    def step(key: tuple, own: pa.Table) -> pa.Table:
        return add(own).append_column("group", pa.array([key[1].as_py()], pa.int32()))

    numbered = rows.withColumn("group", F.spark_partition_id())
    for _ in range(2):  # up to FAN * FAN tasks
        numbered = numbered.withColumn("group", F.floor(F.col("group") / FAN).cast("int")).groupBy("chunk", "group").applyInArrow(step, SCHEMA + ", group int")
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
    for r in numbered.select("chunk", "at", "counts").collect():
        out[r["chunk"] * CHUNK + np.frombuffer(r["at"], np.uint16).astype(np.int64)] += np.frombuffer(r["counts"], np.int64)
    return out[:size]
