"""Retrieval, vector table and joins over embeddings, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.functions import vectors as V
from qanat.operators import evaluate as E
from qanat.operators import cache, index, retrieve
from qanat.plans.base import query
from qanat.session import shared_path
from qanat.sources.tables import table

#: Every fiftieth vector asks, of all vectors but itself; a vector's label is its article.
SCORES = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, q.label AS gold, c.vec_id AS chunk_id, c.label AS article_number, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s),
g AS (SELECT qid, gold, article_number, max(score) AS score, min(rank) AS first_rank FROM h WHERE rank <= 20 GROUP BY qid, gold, article_number),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_rank) AS pos FROM g),
l AS (SELECT qid, gold, list(article_number ORDER BY pos) AS articles FROM o GROUP BY qid, gold)
"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold"), "embedding")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("article_number"), "embedding")


def hits(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    c = chunks(spark, sf)
    return retrieve.dense_top_k(asked(spark, sf), c, k, skip_own=True).join(c.drop("embedding"), "chunk_id")


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    rows = hits(spark, sf).withColumns({"language": F.when(F.col("chunk_id") % 2 == 0, "ar").otherwise("en"), "chunk_index": F.col("chunk_id").cast("int"), "text": F.col("chunk_id").cast("string")})
    return retrieve.group_by_article(rows)


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, gold, articles): each question's articles in order."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("first_rank", "article_number"))), lambda x: x["article_number"])
    return grouped(spark, sf).groupBy("qid").agg(order.alias("articles")).join(asked(spark, sf).select("qid", "gold"), "qid")


@query(
    SCORES + "SELECT qid, CAST(list_contains(articles[1:1], gold) AS INTEGER) AS hit1, CAST(list_contains(articles[1:3], gold) AS INTEGER) AS hit3, CAST(list_contains(articles[1:5], gold) AS INTEGER) AS hit5, "
    "CASE WHEN list_contains(articles[1:5], gold) THEN 1.0::DOUBLE ELSE 0.0 END AS recall5, round(coalesce(1.0::DOUBLE / list_position(articles, gold), 0), 6) AS rr FROM l"
)
def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:  # A1 A2 A3 R2 R3
    gold = F.array("gold")
    hit = [E.hit_at(F.col("articles"), gold, k).alias(f"hit{k}") for k in (1, 3, 5)]
    return answered(spark, sf).select("qid", *hit, E.recall_at(F.col("articles"), gold, 5).alias("recall5"), F.round(E.reciprocal_rank(F.col("articles"), gold), 6).alias("rr"))


@query(SCORES + "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM h WHERE rank <= 20")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:  # R2 V5
    return hits(spark, sf).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    SCORES + "SELECT qid, article_number, round(max(score), 6) AS score, min(rank) AS first_rank, coalesce(string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY chunk_id) FILTER (WHERE chunk_id % 2 = 0), '') AS text_ar, "
    "coalesce(string_agg(CAST(chunk_id AS VARCHAR), ' ' ORDER BY chunk_id) FILTER (WHERE chunk_id % 2 = 1), '') AS text_en FROM h WHERE rank <= 20 GROUP BY qid, article_number"
)
def group_by_article(spark: SparkSession, sf: str) -> DataFrame:  # R3
    return grouped(spark, sf).select("qid", "article_number", F.round("score", 6).alias("score"), F.col("first_rank").cast("long").alias("first_rank"), "text_ar", "text_en")


@query(SCORES + "SELECT qid, article_number, round(1 / (1 + exp(-score)), 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY 1 / (1 + exp(-score)) DESC, first_rank) AS rank FROM g QUALIFY rank <= 5")
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:  # R5 R6 with the score's sigmoid as scorer
    out = retrieve.rerank(grouped(spark, sf), V.sigmoid(F.col("score")), 5)
    return out.select("qid", "article_number", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@query(
    "WITH q AS (SELECT vec_id AS qid, label AS article_number FROM embeddings WHERE vec_id % 50 = 0), f AS (SELECT q.qid, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.qid ORDER BY e.vec_id) AS rank FROM q JOIN embeddings e ON e.label = q.article_number AND e.vec_id <> q.qid) "
    "SELECT qid, chunk_id, CAST(rank AS INTEGER) AS rank, 1.0::DOUBLE AS score FROM f WHERE rank <= 100"
)
def exact_lookup(spark: SparkSession, sf: str) -> DataFrame:  # R1
    rows = chunks(spark, sf).select("chunk_id", "article_number", F.lit("en").alias("language"), F.col("chunk_id").alias("chunk_index"))
    return retrieve.exact_lookup(asked(spark, sf).select("qid", F.col("gold").alias("article_number")), rows, skip_own=True).select("qid", "chunk_id", "rank", "score")


@query(
    SCORES + ", x AS (SELECT qid, gold AS article_number, 'exact' AS path FROM (SELECT DISTINCT qid, gold FROM s) WHERE qid % 100 = 0 AND gold BETWEEN 1 AND 1149) "
    "SELECT qid, article_number, path FROM x UNION ALL SELECT qid, article_number, 'dense' FROM o WHERE pos <= 5 AND qid NOT IN (SELECT qid FROM x)"
)
def router_union(spark: SparkSession, sf: str) -> DataFrame:  # R4
    q = asked(spark, sf)
    questions = q.select("qid", F.when(F.col("qid") % 100 == 0, F.concat(F.lit("article "), "gold")).otherwise("what is due?").alias("question"))
    rows = chunks(spark, sf).select("chunk_id", "article_number", F.lit("en").alias("language"), F.col("chunk_id").alias("chunk_index"), F.lit("t").alias("text"))
    dense = lambda rest: retrieve.rerank(grouped(spark, sf), None, 5).join(rest.select("qid"), "qid", "left_semi").drop("rank")
    return retrieve.route(questions, rows, dense).select("qid", "article_number", "path")


@query(SCORES + ", b AS (SELECT qid, article_number, max(score) AS score FROM s GROUP BY qid, article_number) SELECT qid, article_number, row_number() OVER (PARTITION BY qid ORDER BY score DESC, article_number) AS rank FROM b QUALIFY rank <= 5")
def distinct_articles(spark: SparkSession, sf: str) -> DataFrame:  # R7
    best = retrieve.dense_top_articles(asked(spark, sf), chunks(spark, sf), 5, skip_own=True)
    return best.select("qid", F.col("article_number").cast("int").alias("article_number"), F.col("rank").cast("long").alias("rank"))


@query(SCORES + ", b AS (SELECT qid, article_number, max(score) AS score FROM s GROUP BY qid, article_number) SELECT qid, article_number, row_number() OVER (PARTITION BY qid ORDER BY score DESC, article_number) AS rank, 'kept' AS origin FROM b QUALIFY rank <= 5")
def cached_retrieval(spark: SparkSession, sf: str) -> DataFrame:  # R10: half of the questions, then all, then all again without a retriever
    path = shared_path(spark, "cache")
    questions = asked(spark, sf)

    def dense(todo: DataFrame) -> DataFrame:
        best = retrieve.dense_top_articles(questions.join(todo, "qid", "left_semi"), chunks(spark, sf), 5, skip_own=True)
        return best.select("qid", F.col("article_number").cast("int").alias("article_number"), F.col("rank").cast("long").alias("rank"), F.lit("kept").alias("origin"))

    def none(todo: DataFrame) -> DataFrame:
        return todo.select("qid", F.lit(None).cast("int").alias("article_number"), F.lit(None).cast("long").alias("rank"), F.lit("computed again").alias("origin"))

    cache.cached(questions.filter("qid % 100 = 0").select("qid"), ["qid"], dense, path, fingerprint="dense 5")
    cache.cached(questions.select("qid"), ["qid"], dense, path, fingerprint="dense 5")
    return cache.cached(questions.select("qid"), ["qid"], none, path, fingerprint="dense 5")


@query(
    "SELECT d.doc_id AS id, d.source AS answer, CAST(l.quality AS DOUBLE) AS faithfulness, 0.0::DOUBLE AS cost_usd, 0 AS tokens, 0.0::DOUBLE AS latency_s FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0"
)
def reuse_results(spark: SparkSession, sf: str) -> DataFrame:  # R13: answers whose scores are all there, at no cost; a toxic row lacks its score
    dataset = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("answer"), F.col("n_chars").alias("tokens"), F.lit(0.5).alias("cost_usd"))
    results = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.col("quality")).alias("faithfulness"))
    return cache.reused(dataset, results, ["faithfulness"])


@query("SELECT vec_id, label AS article_number FROM embeddings WHERE label IN (2, 5)")
def vector_scroll(spark: SparkSession, sf: str) -> DataFrame:  # S9
    rows = table(spark, sf, "embeddings").withColumnRenamed("label", "article_number")
    return index.scroll(rows, F.col("article_number").isin(2, 5)).select("vec_id", "article_number")


@query(SCORES + "SELECT qid, article_number, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS topic, CASE WHEN article_number > 3 THEN 'Annex' END AS citation, false AS is_repealed FROM g")
def result_projection(spark: SparkSession, sf: str) -> DataFrame:  # P13 P15
    rows = grouped(spark, sf).withColumns({"citation": F.when(F.col("article_number") > 3, "Annex"), "is_repealed": F.lit(None).cast("boolean"), "other": F.lit(1)})
    return retrieve.result_rows(rows).select("qid", "article_number", F.round("score", 6).alias("score"), "topic", "citation", "is_repealed")


@query("SELECT doc_id AS article_number FROM documents WHERE doc_id IN (1, 3, 5) OR doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND trim(text) <> '' ORDER BY md5('42' || doc_id), doc_id LIMIT 15) ORDER BY 1")
def spot_check(spark: SparkSession, sf: str) -> DataFrame:  # R25
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("article_number"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text_ar"), F.col("text").alias("text_en"))
    return E.spot_check(rows, [1, 3, 5], 15).select("article_number")


@query(SCORES + "SELECT qid, article_number, greatest(round(max(score), 6), -1.0) AS score FROM h WHERE rank <= 15 GROUP BY qid, article_number")
def sweep_retrieval(spark: SparkSession, sf: str) -> DataFrame:  # R9
    return hits(spark, sf, 15).groupBy("qid", "article_number").agg(F.greatest(F.round(F.max("score"), 6), F.lit(-1.0)).alias("score"))


@query(
    SCORES + ", m AS (SELECT 'baseline' AS mode, qid, gold, article_number, pos FROM o WHERE pos <= 5 UNION ALL SELECT 'reranked', qid, gold, article_number, row_number() OVER (PARTITION BY qid ORDER BY -article_number, first_rank) FROM g) "
    "SELECT mode, round(avg(hit), 6) AS r1, round(avg(rr), 6) AS mrr FROM (SELECT mode, qid, max(CASE WHEN pos = 1 AND article_number = gold THEN 1.0::DOUBLE ELSE 0.0 END) AS hit, max(CASE WHEN article_number = gold THEN 1.0::DOUBLE / pos ELSE 0.0 END) AS rr FROM m WHERE pos <= 5 GROUP BY mode, qid) GROUP BY mode"
)
def ablation(spark: SparkSession, sf: str) -> DataFrame:  # R8 A4, with the article number as the second scorer
    rows = grouped(spark, sf)
    both = retrieve.rerank(rows, None, 5).withColumn("mode", F.lit("baseline")).unionByName(retrieve.rerank(rows, F.col("article_number").cast("double"), 5).withColumn("mode", F.lit("reranked")))
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_number"))), lambda x: x["article_number"])
    each = both.groupBy("mode", "qid").agg(order.alias("articles")).join(asked(spark, sf).select("qid", "gold"), "qid")
    gold = F.array("gold")
    return each.groupBy("mode").agg(F.round(F.avg(E.recall_at(F.col("articles"), gold, 1)), 6).alias("r1"), F.round(F.avg(E.reciprocal_rank(F.col("articles"), gold)), 6).alias("mrr"))


@query(SCORES + ", n AS (SELECT qid, gold, list(article_number ORDER BY pos) AS a FROM o GROUP BY qid, gold) SELECT qid, CASE WHEN list_contains(a, gold) THEN a[1:16] ELSE list_concat([gold], a[1:15]) END AS \"group\" FROM n")
def hard_negative_groups(spark: SparkSession, sf: str) -> DataFrame:  # R18 R19
    rows = retrieve.rerank(grouped(spark, sf), None, 16)
    return retrieve.hard_negatives(rows, asked(spark, sf).select("qid", "gold"))


@query(
    "SELECT vec_id, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(u, 17, 1)) - 1) % 4 + 1, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS point_id "
    "FROM (SELECT vec_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk-' || vec_id)) AS u FROM embeddings)"
)
def point_uuid(spark: SparkSession, sf: str) -> DataFrame:  # V2
    return table(spark, sf, "embeddings").select("vec_id", V.point_id(F.concat(F.lit("chunk-"), F.col("vec_id").cast("string"))).alias("point_id"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def unit_normalise(spark: SparkSession, sf: str) -> DataFrame:  # V4
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("length"), F.round(V.unit(F.col("embedding"))[0], 6).alias("first"))


@query("SELECT count(*) AS chunks, count(DISTINCT label) AS articles FROM embeddings")
def count_articles(spark: SparkSession, sf: str) -> DataFrame:  # V8
    return index.counts(table(spark, sf, "embeddings").withColumnRenamed("label", "article_number"))


@query("SELECT CAST(o_custkey AS BIGINT) AS article_number FROM (SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def missing_keys_antijoin(spark: SparkSession, sf: str) -> DataFrame:  # V7
    return index.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("article_number")), table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("article_number")))


@query("SELECT k AS key, side FROM (SELECT doc_id AS k, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:  # V10
    key = F.col("doc_id").alias("key")
    return E.set_difference(table(spark, sf, "documents").select(key), table(spark, sf, "labels").select(key), "key")


@query("SELECT o_orderkey AS id, list(p_name ORDER BY l_linenumber, l_partkey) AS \"values\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def lookup_join_ordered(spark: SparkSession, sf: str) -> DataFrame:  # R11 R12: an order's part numbers to their names, in order
    nums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("numbers"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).join(nums, "id")
    return retrieve.in_order(rows, "numbers", table(spark, sf, "part").select(F.col("p_partkey").alias("article_number"), "p_name"), "p_name")


@query(
    "SELECT c_custkey AS key, coalesce(a.v, b.v) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey "
    "LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS v FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey"
)
def precedence_merge(spark: SparkSession, sf: str) -> DataFrame:  # R10 R13 R14
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    first = orders.filter("o_orderstatus = 'F'").groupBy("key").agg(F.max("o_totalprice").alias("value"))
    return retrieve.precedence(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), first, orders.groupBy("key").agg(F.min("o_totalprice").alias("value")))


@query("WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS t FROM benchmark) SELECT item_id FROM n WHERE i IN (SELECT CAST(floor(k * t / 7.0) AS BIGINT) FROM generate_series(0, 6) s(k))")
def even_subset(spark: SparkSession, sf: str) -> DataFrame:  # R20
    return retrieve.even_subset(table(spark, sf, "benchmark"), "item_id", 7).select("item_id")


@query("SELECT item_id, CASE WHEN (row_number() OVER (ORDER BY item_id) - 1) % 2 = 0 THEN 'reference' ELSE 'live' END AS side FROM benchmark")
def alternate_split(spark: SparkSession, sf: str) -> DataFrame:  # R21
    return retrieve.alternate(table(spark, sf, "benchmark"), "item_id").select("item_id", "side")


@query("SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5")
def start_offset(spark: SparkSession, sf: str) -> DataFrame:  # R22
    return retrieve.part_of(table(spark, sf, "benchmark").select("item_id"), "item_id", 5, 10)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 5")
def weakest(spark: SparkSession, sf: str) -> DataFrame:  # R24
    return E.weakest(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("SELECT source, arg_max(doc_id, (quality, doc_id)) AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY source")
def latest_report(spark: SparkSession, sf: str) -> DataFrame:  # R26
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return E.latest_of(rows, ["source"], ["quality", "doc_id"], "doc_id")


@query(
    r"WITH f AS (SELECT doc_id, source AS a, CASE WHEN regexp_matches(t, '^.*?[.!?؟۔]\s') THEN substr(regexp_extract(t, '^(.*?[.!?؟۔])\s', 1), 1, 220) ELSE substr(t, 1, 220) END AS b FROM (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)) "
    "SELECT doc_id, a AS question FROM f WHERE length(a) >= 5 UNION SELECT doc_id, b FROM f WHERE length(b) >= 5"
)
def synthetic_queries(spark: SparkSession, sf: str) -> DataFrame:  # R27
    from qanat.functions.text import first_sentence

    rows = table(spark, sf, "documents")
    found = F.array_distinct(F.filter(F.array("source", first_sentence(F.col("text"))), lambda x: F.length(x) >= 5))
    return rows.select("doc_id", F.explode(found).alias("question"))


@query(
    "WITH b AS (SELECT item_id, CASE WHEN item_id % 9 = 4 THEN NULL WHEN item_id % 9 = 5 THEN '' ELSE text END AS text, 'b' || item_id AS chunk_id FROM benchmark), w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM b WHERE text <> ''), "
    "s AS (SELECT item_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM w), v AS (SELECT item_id, CAST(h % 64 AS INTEGER) AS i, sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END) AS x FROM s GROUP BY 1, 2), "
    "n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), u AS (SELECT item_id, chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS u FROM b WHERE text <> '') "
    "SELECT substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-5' || substr(u, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(u, 17, 1)) - 1) % 4 + 1, 1) || substr(u, 18, 3) || '-' || substr(u, 21, 12) AS point_id, "
    "chunk_id, CAST(item_id AS INTEGER) AS article_number, CAST(g AS INTEGER) AS i, round(coalesce(x / n, 0), 5) AS x FROM u JOIN n USING (item_id), generate_series(0, 63) t(g) LEFT JOIN v ON v.item_id = u.item_id AND v.i = g"
)
def embed_texts(spark: SparkSession, sf: str) -> DataFrame:  # V1 V3 V11 P18: two ninths of the chunks have no text
    text = F.when(F.col("item_id") % 9 == 5, "").when(F.col("item_id") % 9 != 4, F.col("text"))
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("chunk_id"), F.col("item_id").cast("int").alias("article_number"), F.lit("en").alias("language"), F.lit(0).alias("chunk_index"), F.lit(1).alias("n_chunks"), F.lit("article").alias("chunk_type"), text.alias("text"))
    points = index.points(index.embed(rows, "text"), 64)
    return points.select("point_id", "chunk_id", "article_number", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 5) + 0.0)


@query(
    "WITH d AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END AS step FROM d), "
    "r AS (SELECT *, x / step AS q, floor(x / step) AS low FROM b) SELECT vec_id, CAST(i AS INTEGER) AS i, step * (low + CASE WHEN q - low > 0.5 OR (q - low = 0.5 AND low % 2 <> 0) THEN 1 ELSE 0 END) AS x FROM r"
)
def half_precision(spark: SparkSession, sf: str) -> DataFrame:  # K6 S10: packed to 16-bit floats, which hold 11 bits, and unpacked again
    back = index.full_precision(index.half_precision(table(spark, sf, "embeddings").select("vec_id", "embedding")), digits=None)
    return back.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))
