"""The few file operations that tables need besides Spark's readers and writers, by the path's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    at, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file that must not be there yet; whether it was not."""
    at, fs = _at(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    return spark.read.text(path, wholetext=True).head()[0]


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
