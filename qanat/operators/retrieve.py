"""Retrieval: routing, exact lookup, dense top-k, grouping by article, reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.functions.text import detect_article
from qanat.operators.order import placed

#: Queries and vectors of a block, in expectation; blocks meet in tasks, STRIPE queries at a time.
BLOCK, VECTORS, STRIPE = 8_192, 65_536, 128
#: Chunks that a lookup by number takes.
LOOKED_UP = 100


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """row_number in each group; with k, Catalyst limits each group before its shuffle."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col(name) <= k) if k else out


def candidates(top_k: int) -> int:
    """Chunks that dense retrieval takes for ``top_k`` articles."""
    return max(4 * top_k, 15)


def exact_lookup(queries: DataFrame, chunks: DataFrame, skip_own: bool = False) -> DataFrame:
    """The first LOOKED_UP chunks of each query's article, in order of language and place, with score 1; skip_own leaves out chunk qid.

    An article's first chunks are chosen before queries meet them, so what is joined grows with the queries and not
    with the articles' sizes too. What skip_own takes from a query are at most LOOKED_UP of them, as no more rows of an id are kept.
    """
    order = [F.col("language"), F.col("chunk_index"), *[F.col(c) for c in ("chunk_id",) if c in chunks.columns]]
    first = chunks.filter("article_number is not null")
    if skip_own:
        first = ranked(first.filter("chunk_id is not null"), ["article_number", "chunk_id"], order, LOOKED_UP, "_nth")
    first = ranked(first, ["article_number"], order, LOOKED_UP * (2 if skip_own else 1), "_nth").drop("_nth")
    found = queries.join(first, "article_number")
    found = found.filter("chunk_id <> qid") if skip_own else found
    return ranked(found.withColumn("score", F.lit(1.0)), ["qid"], order, LOOKED_UP)


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int, skip_own: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank): each query's k best chunks by dot product; ties by chunk id.

    Queries and chunks are dealt into blocks; each pair of blocks is a matrix product in a task of its own, which k
    rows for each query leave, with ties. skip_own leaves out chunk qid, where questions are chunks themselves.
    """
    found = _tiles(queries, chunks.select(F.col("chunk_id").cast("long").alias("id"), F.col("chunk_id").cast("long"), "embedding"), k, False, skip_own)
    return ranked(found.withColumnRenamed("id", "chunk_id"), ["qid"], [F.desc("score"), F.col("chunk_id")], k)


def dense_top_articles(queries: DataFrame, chunks: DataFrame, k: int = 15, skip_own: bool = False) -> DataFrame:
    """(qid, article_number, score, rank): each query's k best articles by their best chunk, over all chunks.

    A block's chunks are merged into articles before its k best are chosen, so no more leaves it than in dense_top_k: an
    article among a query's k best is among the k best of the block that holds its best chunk.
    """
    vectors = chunks.filter("article_number is not null").select(F.col("article_number").cast("long").alias("id"), F.col("chunk_id").cast("long"), "embedding")
    return distinct_articles(_tiles(queries, vectors, k, True, skip_own).withColumnRenamed("id", "article_number"), k)


def _tiles(queries: DataFrame, vectors: DataFrame, k: int, merge: bool, skip_own: bool) -> DataFrame:
    """(qid, id, score) of (qid, embedding) and (id, chunk_id, embedding): the k best of each query and block, with ties."""
    y, x = max(1, -(-queries.count() // BLOCK)), max(1, -(-vectors.count() // VECTORS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    e = F.col("embedding").cast("array<double>").alias("e")
    asked = queries.select(F.col("qid").cast("long"), e, deal("qid", y).alias("y"), every(x).alias("x"))
    held = vectors.select("id", "chunk_id", e, deal("chunk_id", x).alias("x"), every(y).alias("y"))

    def matrix(rows: pa.Table) -> np.ndarray:
        return rows.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = [pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        right = right.sort_by([("id", "ascending"), ("chunk_id", "ascending")])
        ids, own, qids = (t.column(c).to_numpy() for t, c in ((right, "id"), (right, "chunk_id"), (left, "qid")))
        places, starts = np.unique(ids, return_index=True)
        for i in range(0, left.num_rows if right.num_rows else 0, STRIPE):
            part = left.slice(i, STRIPE)
            scores = matrix(part) @ matrix(right).T
            if skip_own:
                scores[own[None] == qids[i : i + STRIPE, None]] = -np.inf
            if merge:
                scores = np.maximum.reduceat(scores, starts, axis=1)
            n = min(k, scores.shape[1])
            edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
            out.append(pa.table({"qid": qids[i : i + STRIPE][row], "id": (places if merge else ids)[col], "score": scores[row, col]}))
        return pa.concat_tables(out)

    return asked.groupBy("x", "y").cogroup(held.groupBy("x", "y")).applyInArrow(run, "qid long, id long, score double")


def group_by_article(hits: DataFrame) -> DataFrame:
    """Chunk hits (qid, rank, article_number, language, chunk_index, text, score, ...) -> one row for each article.

    The best score, the first hit's other columns, and each language's texts in their order; first_rank keeps the order.
    """
    known = {"qid", "rank", "article_number", "language", "chunk_index", "text", "score", "chunk_id"}
    first = F.min_by(F.struct(*[c for c in hits.columns if c not in known]), "rank").alias("first") if set(hits.columns) - known else None
    text = lambda lang: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("language") == lang, F.struct("chunk_index", "rank", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"]), " "))
    aggs = [F.max("score").alias("score"), F.min("rank").alias("first_rank"), text("ar").alias("text_ar"), text("en").alias("text_en")]
    out = hits.filter("article_number is not null").groupBy("qid", "article_number").agg(*aggs, *([first] if first is not None else []))
    return out.select("*", "first.*").drop("first") if first is not None else out


#: What a result row holds of a chunk's payload, with the value that stands in for a missing one.
RESULT = {"book": None, "chapter": None, "section": None, "topic": None, "citation": None, "source_status": None, "source_page": None, "is_repealed": False}


def result_rows(hits: DataFrame) -> DataFrame:
    """Hits with whatever payload they carry -> the fixed columns of a result, and the score."""
    kept = [F.coalesce(F.col(c), F.lit(d)).alias(c) if d is not None else F.col(c) for c, d in RESULT.items() if c in hits.columns]
    absent = [F.lit(d).cast("boolean" if c == "is_repealed" else "int" if c == "source_page" else "string").alias(c) for c, d in RESULT.items() if c not in hits.columns]
    return hits.select("qid", "article_number", "score", *kept, *absent)


def passage(number: Column, ar: Column, en: Column) -> Column:
    """What a reranker reads of an article."""
    return F.concat(F.lit("Article "), number.cast("string"), F.lit("\nArabic:\n"), F.coalesce(ar, F.lit("")), F.lit("\nEnglish:\n"), F.coalesce(en, F.lit("")))


def rerank(articles: DataFrame, score: Column | None, k: int, order: str = "first_rank") -> DataFrame:
    """The k best by score, ties in the order before; without a score, the first k."""
    best = [F.desc("rerank_score"), F.col(order)] if score is not None else [F.col(order)]
    return ranked(articles.withColumn("rerank_score", F.lit(None).cast("double") if score is None else score), ["qid"], best, k)


def distinct_articles(hits: DataFrame, k: int = 15) -> DataFrame:
    """(qid, article_number, score, rank): the k first distinct articles of ranked hits over a full scan."""
    best = hits.filter("article_number is not null").groupBy("qid", "article_number").agg(F.max("score").alias("score"))
    return ranked(best, ["qid"], [F.desc("score"), F.col("article_number")], k)


def route(questions: DataFrame, chunks: DataFrame, dense: Callable[[DataFrame], DataFrame], most: int = 1149) -> DataFrame:
    """Grouped articles for (qid, question): by the number that a question names, if it has chunks, else by ``dense``.

    ``dense`` maps the questions left over to grouped articles, already reranked and cut; exact answers are neither.
    """
    named = questions.withColumn("article_number", detect_article(F.col("question"), most))
    exact = group_by_article(exact_lookup(named.filter("article_number is not null").select("qid", "article_number"), chunks))
    rest = questions.join(exact.select("qid").distinct(), "qid", "left_anti")
    return exact.withColumn("path", F.lit("exact")).unionByName(dense(rest).withColumn("path", F.lit("dense")), allowMissingColumns=True)


def in_order(rows: DataFrame, numbers: str, articles: DataFrame, value: str, strict: bool = True) -> DataFrame:
    """(id, numbers array) -> (id, values array): looked up in order; strict fails on a missing number, else it is skipped."""
    pairs = rows.select("id", F.posexplode(numbers).alias("pos", "n"))
    joined = pairs.join(articles.select(F.col("article_number").alias("n"), F.col(value).alias("v")), "n", "left")
    if strict:
        joined = joined.withColumn("v", F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("no article "), F.col("n").cast("string")))).otherwise(F.col("v")))
    else:
        joined = joined.filter("v is not null")
    return joined.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("values"))


def precedence(keys: DataFrame, *sources: DataFrame, value: str = "value") -> DataFrame:
    """(key) and any number of (key, value): the first source's value that is not null; null is work to do."""
    out, columns = keys, []
    for i, s in enumerate(sources):
        out = out.join(s.select("key", F.col(value).alias(f"_{i}")), "key", "left")
        columns.append(F.col(f"_{i}"))
    return out.select("key", F.coalesce(*columns).alias(value))


def hard_negatives(hits: DataFrame, gold: DataFrame, n: int = 16) -> DataFrame:
    """(qid, group): the gold article first, then the best hits without it, n at most."""
    best = hits.filter(F.col("rank") <= n).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_number"))), lambda x: x["article_number"]).alias("hits"))
    both = gold.join(best, "qid", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))
    own = F.when(F.array_contains("hits", F.col("gold")), F.col("hits")).otherwise(F.concat(F.array("gold"), F.slice("hits", 1, n - 1)))
    return both.select("qid", F.slice(F.array_distinct(own), 1, n).alias("group"))


def even_subset(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even distances: numbers floor(i * total / n) in order."""
    numbered, total = placed(rows, [F.col(order)], "_i")
    i = F.ceil(F.col("_i") * n / F.lit(float(max(1, total))))
    return numbered.filter((i < n) & (F.floor(i * total / F.lit(float(n))) == F.col("_i"))).drop("_i")


def alternate(rows: DataFrame, order: str) -> DataFrame:
    """Adds side: reference and live in turn, in order."""
    numbered, _ = placed(rows, [F.col(order)], "_i")
    return numbered.withColumn("side", F.when(F.col("_i") % 2 == 0, "reference").otherwise("live")).drop("_i")


def part_of(rows: DataFrame, order: str, start: int, limit: int | None = None) -> DataFrame:
    """Rows from number ``start`` on, in order, ``limit`` at most."""
    numbered, total = placed(rows, [F.col(order)], "_i")
    return numbered.filter(F.col("_i").between(start, total if limit is None else start + limit - 1)).drop("_i")
