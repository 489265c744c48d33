"""The registered queries of the llm operators, thin over the operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.llm.exact_dedup import exact_dedup
from qanat.llm.html import extract
from qanat.llm.jaccard_join import jaccard_components
from qanat.llm.language_id import identify
from qanat.llm.lexical import ranked
from qanat.llm.line_dedup import applied, line_dedup
from qanat.llm.mixing import mix
from qanat.llm.packing import pack
from qanat.llm.repair import repair, summary
from qanat.llm.sharding import shard
from qanat.llm.topk import top_k
from qanat.llm.toxicity import toxicity
from qanat.llm.urls import judge
from qanat.sources.tables import spread, table

#: Folder-independent place of the public vocabularies; a parameter of every operator that tokenises.
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE_SQL["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the law ``bytes``: sizes near equal."""
    return shard(table(spark, sf_dir, "documents"), shards=24).select(
        "_doc.doc_id",
        "size",
        F.crc32(F.coalesce("_doc.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("_doc.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS everything FROM s),
c AS (
  SELECT *, (everything - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) > cap / weight AS capped
  FROM r WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    weight * (everything - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM c),
a AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) * source_size AS more FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
u AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g)
SELECT d.doc_id, d.size, a.source_size, a.target,
       CAST(d.size * (a.whole + CASE WHEN u.upto <= a.more OR (u.upto - u.n <= a.more AND u.upto - a.more < a.more - (u.upto - u.n)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.h = d.h
"""


@register
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(table(spark, sf_dir, "documents")), width=5, percent=80)


@register
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return top_k(rows, k=5, is_query=F.col("id") % 50 == 0)


ORACLE_SQL["op3_exact_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")), tokenizer_path())


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spread(table(spark, sf_dir, "documents")))


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread(table(spark, sf_dir, "pages")), URL_RULES)


@register
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = applied(docs, line_dedup(docs, least_points=40, least_docs=5))
    return left.select("_doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op12_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + CASE WHEN count(*) > count(doc_id) THEN 1 ELSE 0 END >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND c.last IS DISTINCT FROM k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (c.key IS NULL OR c.last IS NOT DISTINCT FROM k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.r, k.doc_id
"""


@register
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_SQL["op11_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
size AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
s AS (
  SELECT q.item_id, size.r, size.doc_id,
         CAST(sum(q.times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df.df + 1 AS DOUBLE))) AS BIGINT)
                  * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * size.n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN df ON df.term = q.term JOIN tf ON tf.term = q.term JOIN size ON size.r = tf.r, whole
  GROUP BY q.item_id, size.r, size.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(repair(table(spark, sf_dir, "conversations")))
