"""The vector table: embedding, point ids, idempotent upsert by article partition, and its checks."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qanat.functions.vectors import point_id
from qanat.session import checkpointed
from qanat.sources import versions

Embed = Callable[[list[str]], np.ndarray]


def hashed(size: int = 64) -> Embed:
    """The stand-in embedder: words hashed by MD5, as any engine can, to signed dimensions, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "big")
                row[h % size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


EMBEDDERS: dict[str, Callable[[], Embed]] = {"hash": hashed}


def embedder(name: str) -> Callable[[], Embed]:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[name]


def embed(rows: DataFrame, text: str = "embed_text", name: str = "hash") -> DataFrame:
    """Adds embedding to rows with a text; one model for each task, batch by batch."""
    make = embedder(name)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            yield pd.Series(list(model(b.fillna("").tolist())))

    return rows.filter(F.length(text) > 0).withColumn("embedding", run(text))


def points(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks with embeddings -> rows of the table; a vector of another length fails."""
    bad = F.raise_error(F.concat(F.lit("vector length of "), F.col("chunk_id"))).cast("array<float>")
    meta = ["book", "chapter", "section", "topic", "is_repealed", "source_page", "citation", "source_status"]
    out = chunks.filter("embedding is not null").withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(bad))
    known = [F.col(f"metadata.{m}") for m in meta] if "metadata" in chunks.columns else [F.col(m) for m in meta if m in chunks.columns]
    return out.select(point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "article_number", "language", "chunk_index", "n_chunks", "chunk_type", "text", *known, "embedding")


def bucket(number: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(buckets)).cast("int")


def _buckets(parts: dict) -> dict[int, dict]:
    return {int(name.removeprefix("bucket=")): part for name, part in parts.items()}


def read(spark: SparkSession, path: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The table, of a version or the current one; of some buckets only, if they are given."""
    parts = _buckets(versions.version(spark, path, version)["parts"])
    schema = next(iter(parts.values()))["schema"]
    folders = [f"{path}/{part['folder']}" for b, part in parts.items() if part["rows"] and (buckets is None or b in buckets)]
    fields = StructType.fromJson(json.loads(schema))
    return spark.read.schema(fields).parquet(*folders) if folders else spark.createDataFrame([], fields)


def replace(spark: SparkSession, path: str, numbers: DataFrame, rows: DataFrame | None, buckets: int) -> int:
    """Commits a version in which the articles ``numbers`` have ``rows`` and no others.

    The table is a version of buckets of articles (``sources.versions``). Only the buckets that the numbers touch are
    read, and written anew beside the old; readers see the old version until the new one is verified and committed.
    """
    place = lambda df: df.withColumn("bucket", bucket(F.col("article_number"), buckets))
    numbers = checkpointed(place(numbers.select("article_number").distinct()))
    touched = {r[0] for r in numbers.select("bucket").distinct().collect()}  # ``buckets`` rows at most
    base, now = versions.top_number(spark, path), versions.current(spark, path)
    if now and any(part["of"] != buckets for part in now["parts"].values()):
        raise ValueError(f"{path} does not have {buckets} buckets")
    new = place(rows) if rows is not None else None
    if now:
        kept = place(read(spark, path, now["version"], touched)).join(numbers.select("article_number"), "article_number", "left_anti")
        new = kept if new is None else kept.select(new.columns).unionByName(new)
    if new is None:
        return 0
    new = checkpointed(new)
    columns = [c for c in new.columns if c != "bucket"]
    sums = lambda df: {r["bucket"]: (r["rows"], r["digest"]) for r in df.groupBy("bucket").agg(*versions.digests(columns)).collect()}
    wanted, folder = sums(new), f"data/{uuid.uuid4()}"
    new.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    if wanted and sums(spark.read.schema(new.schema).parquet(f"{path}/{folder}")) != wanted:
        raise versions.DamagedError(f"{path}: what was written does not verify")
    schema = new.drop("bucket").schema.json()
    part = lambda b, n, d: {"folder": f"{folder}/bucket={b}", "format": "parquet", "schema": schema, "rows": n, "digest": d, "of": buckets}
    written = {f"bucket={b}": part(b, *wanted.get(b, (0, "0"))) for b in touched}
    return versions.advance(spark, path, lambda old: old | written, base=base)


def upsert(spark: SparkSession, path: str, rows: DataFrame, buckets: int = 64, attempts: int = 3) -> None:
    """Replaces all chunks of the articles in ``rows``; running it twice changes nothing; begins anew if another was faster."""
    for attempt in range(attempts):
        try:
            replace(spark, path, rows, rows, buckets)
            return
        except versions.ConflictError:
            if attempt == attempts - 1:
                raise


def delete(spark: SparkSession, path: str, numbers: DataFrame, buckets: int = 64) -> None:
    """Removes all chunks of the articles (article_number)."""
    replace(spark, path, numbers, None, buckets)


def ensure(spark: SparkSession, path: str, build: Callable[[], DataFrame], buckets: int = 64) -> bool:
    """Builds the table if it is absent or empty; whether it did."""
    now = versions.current(spark, path)
    if now and any(part["rows"] for part in now["parts"].values()):
        return False
    upsert(spark, path, build(), buckets)
    return True


def scroll(table: DataFrame, where: Column) -> DataFrame:
    """The payload of the table's matching rows, without their vectors; filter and columns reach the scan."""
    return table.filter(where).drop("embedding")


def counts(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("chunks"), F.countDistinct("article_number").alias("articles"))


def health(read: Callable[[], DataFrame], cache: dict[str, float | dict], now: float, ttl: float = 60) -> dict:
    """Counts of the table and whether it serves; counted again only when the last good count is older than ttl seconds.

    A table that can't be read is unhealthy, with the failure as detail, and leaves the cache as it is.
    """
    if "counts" not in cache or now - cache["at"] > ttl:
        try:
            cache |= {"at": now, "counts": counts(read()).head().asDict()}
        except PySparkException as e:
            return {"status": "unhealthy", "chunks": 0, "articles": 0, "documents": 0, "detail": str(e)}
    found = cache["counts"]
    return {"status": "healthy" if found["articles"] > 0 else "unhealthy", **found, "documents": found["articles"], "detail": None}


def missing(numbers: DataFrame, table: DataFrame) -> DataFrame:
    """Article numbers without a row in the table."""
    return numbers.select("article_number").distinct().join(table, "article_number", "left_anti")


def half_precision(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vector packed as 16-bit floats."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.asarray(v, np.float16).tobytes(), na_action="ignore")

    return rows.withColumn(vector, pack(vector))


def full_precision(rows: DataFrame, vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    """Unpacked again, rounded unless ``digits`` is None."""

    def plain(v: bytes) -> list[float]:
        x = np.frombuffer(v, np.float16).astype(np.float64)
        return (x if digits is None else np.round(x, digits)).tolist()

    @F.pandas_udf("array<float>")
    def unpack(x: pd.Series) -> pd.Series:
        return x.map(plain, na_action="ignore")

    return rows.withColumn(vector, unpack(vector))
