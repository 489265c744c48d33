"""Follow the regularised leader, per coordinate, with elastic-net penalties; and the bounded samples models learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.session import checkpointed, small_side


class Ftrl:
    """Weights of shape (features,) or (features, classes); l1 keeps those of little use at exactly 0."""

    def __init__(self, shape: tuple[int, ...], alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, rows: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """rows must be distinct."""
        n = self.n[rows]
        more = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[rows] = more


#: Labels whose shares are broadcast; more of them are joined by a shuffle.
LABELS = 100_000


def bounded_sample(rows: DataFrame, key: Column, label: Column, most: int, size: Column, most_size: int) -> DataFrame:
    """About ``most`` rows of each label at most, and rows of about ``most_size`` by ``size`` of each label, the same at every run.

    They are the rows whose hash lies below the label's share.
    """
    named = checkpointed(rows.groupBy(label.alias("_label")).agg(F.count("*").alias("_n"), F.sum(size).alias("_size")))
    shares = named.select("_label", F.least(most / F.col("_n"), most_size / F.greatest(F.col("_size"), F.lit(1))).alias("_share"))
    part = (F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) / float(1 << 30)).alias("_u")
    marked = rows.withColumns({"_key_label": label, "_u": part})
    return marked.join(small_side(shares, LABELS), F.col("_key_label") == F.col("_label")).filter(F.col("_u") < F.col("_share")).drop("_key_label", "_label", "_share", "_u")


def packed(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The arrays of a binary column, without copies."""
    return [np.frombuffer(v.as_buffer(), kind) for v in column]
