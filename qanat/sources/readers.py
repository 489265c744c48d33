"""Readers: JSON record lists, tolerant evaluation sets, load-test CSV, logs, file digests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qanat.operators.order import placed
from qanat.sources.files import exists

ARTICLE = "article_number int, book string, chapter string, section string, topic string, text_ar string, text_en string, text_ar_raw string, is_repealed boolean, source_page int, citation string, source_status string, repeal_note_en string, repeal_note_ar string"


def json_list(spark: SparkSession, paths: str | list[str], schema: str | T.StructType = ARTICLE) -> DataFrame:
    """Files that hold a JSON list of records each; anything else fails."""
    wrong = spark.read.text(paths, wholetext=True).filter(~F.col("value").rlike(r"^\s*\["))
    if wrong.head(1):
        raise ValueError("a file does not hold a list")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of records by key -> (key, record columns)."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return rows.select(F.explode("m").alias("key", "v")).select("key", "v.*")


def tolerant_list(spark: SparkSession, path: str, names: tuple[str, ...] = ("results", "items", "questions", "data", "articles")) -> DataFrame:
    """(file, pos, record as JSON) of each file's list, list under one of the names, or object's values."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    listed = F.from_json(F.col("value"), "array<string>")
    under = [F.from_json(F.get_json_object("value", f"$.{n}"), "array<string>") for n in names]
    values = F.map_values(F.from_json("value", "map<string,string>"))
    found = F.when(F.col("value").rlike(r"^\s*\["), listed).otherwise(F.coalesce(*under, values))
    return rows.select("file", F.posexplode(found).alias("pos", "record"))


def numbers(value: Column) -> Column:
    """A JSON scalar, list, object with article_number, or list of these -> array of whole numbers; the rest is dropped."""
    items = F.when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>")).when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))
    own = lambda v: F.coalesce(v.try_cast("int"), F.get_json_object(v, "$.article_number").try_cast("int"))
    return F.filter(F.transform(items, own), lambda x: x.isNotNull())


def evaluation_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, question, reference, expected_articles, language, category) in file order, whatever its keys are called.

    Of a folder, files are taken in order of their paths.
    """
    get = lambda *names: F.coalesce(*[F.get_json_object("record", f"$.{n}") for n in names])
    rows, _ = placed(tolerant_list(spark, path), [F.col("file"), F.col("pos")], "nth")
    rows = rows.drop("pos").withColumnRenamed("nth", "pos")
    expected = get("expected_articles", "expected_article", "articles", "gold_articles", "article_numbers", "article_number", "article")
    keys = F.filter(F.json_object_keys("record"), lambda k: k.contains("article") & ~k.contains("citation"))
    last = F.element_at(F.from_json("record", "map<string,string>"), F.try_element_at(keys, F.lit(1)))
    out = rows.select(
        "pos",
        F.coalesce(get("id"), F.concat(F.lit("q"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0"))).alias("id"),
        get("question", "user_input", "query", "question_ar").alias("question"),
        F.coalesce(get("reference", "reference_answer", "ground_truth", "answer"), F.lit("")).alias("reference"),
        numbers(F.coalesce(expected, last)).alias("expected_articles"),
        get("language").alias("language"),
        get("category").alias("category"),
    )
    out = out.withColumn("question", F.when(F.coalesce("question", F.lit("")) == "", F.raise_error(F.concat(F.lit("no question in "), F.col("id")))).otherwise(F.col("question")))
    out = out.filter(F.col("pos") < limit) if limit else out
    return out.orderBy("pos").drop("pos")


def load_test(spark: SparkSession, path: str) -> DataFrame:
    """Load-test statistics without the aggregated row, milliseconds as seconds."""
    rows = spark.read.option("header", True).csv(path).filter("Name <> 'Aggregated'")
    ms = lambda c, n: (F.col(f"`{c}`").cast("double") / 1000).alias(n)
    return rows.select(F.col("Name").alias("name"), F.col("`Request Count`").cast("int").alias("requests"), F.col("`Failure Count`").cast("int").alias("failures"), F.col("`Requests/s`").cast("double").alias("per_second"), ms("Average Response Time", "avg_s"), ms("50%", "p50_s"), ms("95%", "p95_s"), ms("99%", "p99_s"))


def first_number(lines: DataFrame, pattern: str) -> DataFrame:
    """The number in the first line that the pattern matches; null if none does.

    lines: a text scan; files count in order of their paths, whatever parts of them the scan reads where.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()) if "_metadata" not in lines.columns and lines.inputFiles() else F.monotonically_increasing_id()
    found = lines.select("value", place.alias("at")).withColumn("n", F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).try_cast("double"))
    return found.filter("n is not null").agg(F.min_by("n", "at").alias("value"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def first_readable(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the paths that is there."""
    for p in paths:
        if exists(spark, p):
            return json_list(spark, p, schema)
    raise FileNotFoundError(", ".join(paths))


def layout_texts(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary documents by a function that reads one; it runs in the tasks."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(extract)

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("text"))


def layout_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


LINES = "document string, page int, line int, text string"


def layout_lines(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]] | None = None) -> DataFrame:
    """(document, page, line, text) of layout documents: pages and lines from 1, lines with text only.

    extract: a function from a document's bytes to its pages' texts, one after the other; without it documents are
    UTF-8 text with form feeds between pages. A task holds one document's bytes and one page at a time. What cannot be
    read is one line, of page 0, with the failure.
    """

    def plain(content: bytes) -> Iterable[str]:
        return content.decode("utf-8").split("\f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for page, body in enumerate((extract or plain)(content.as_py()), 1):
                        found = [(n, x) for n, x in enumerate(re.split("\r?\n", body), 1) if x.strip()]
                        yield lines(document, page, found)
                except Exception as e:  # noqa: BLE001 - extractors are plugged in and may raise anything
                    yield lines(document, 0, [(0, f"{type(e).__name__}: {e}")])

    def lines(document: str, page: int, found: list[tuple[int, str]]) -> pa.RecordBatch:
        columns = [[document] * len(found), [page] * len(found), [n for n, _ in found], [x for _, x in found]]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["document", "page", "line", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, LINES)


def line_texts(lines: DataFrame) -> DataFrame:
    """Lines of documents -> (document, text) with form feeds, as a dump holds it; a document's lines are gathered."""
    pages = lines.groupBy("document", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    return pages.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\f").alias("text"))


def locked_digest(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The md5 that a YAML lock file holds for an output path; null if it has none."""
    rows = spark.read.text(path, wholetext=True)
    own = rf"path: {re.escape(target)}\n(?:[ ]+(?!- )[^\n]*\n)*?[ ]+md5: (\w+)"
    return rows.select(F.nullif(F.regexp_extract("value", own, 1), F.lit("")).alias("md5"))


def question_pool(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows drawn by the hash of seed and key: the same ones however the rows are dealt."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.orderBy(order)) - 1)
