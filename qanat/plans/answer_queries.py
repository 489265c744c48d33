"""Requests, prompts, answers and cost over conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.functions.text import prompt_tokens
from qanat.operators import answer as A
from qanat.plans.base import query
from qanat.sources import sinks
from qanat.sources.tables import table

PAIRS = (
    "WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "p AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM n WHERE role = 'user' AND next_role = 'assistant')"
)
SYSTEM = "You answer from the given sources alone and name the articles you rely on."


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


@query(PAIRS + " SELECT conv_id, turn, question, answer FROM p")
def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'no question' WHEN length(trim(text)) < 2 THEN 'question too short' WHEN turn NOT BETWEEN 1 AND 20 THEN 'top_k out of range' END AS reject_reason FROM conversations")
def request_checks(spark: SparkSession, sf: str) -> DataFrame:  # S16
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("turn").alias("top_k"))
    return A.checked_requests(rows).select("conv_id", "turn", "reject_reason")


TOKENS = "greatest(1, CAST(round(length({}) / 3.0) AS INTEGER))"


@query(PAIRS + f", t AS (SELECT conv_id, turn, {TOKENS.format('question')} AS i, {TOKENS.format('answer')} AS o FROM p) SELECT conv_id, turn, i AS input_tokens, o AS output_tokens, round((i * 0.29::DOUBLE + o * 0.59::DOUBLE) / 1000000, 9) AS cost_usd FROM t")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:  # G10 G11
    rows = pairs(spark, sf).withColumns({"input_tokens": prompt_tokens(F.col("question")), "output_tokens": A.used_tokens(F.lit(0), F.col("answer"))})
    return rows.select("conv_id", "turn", "input_tokens", "output_tokens", F.round(A.cost(F.lit("groq"), F.col("input_tokens"), F.col("output_tokens")), 9).alias("cost_usd"))


@query(PAIRS + f", t AS (SELECT {TOKENS.format('question')} + {TOKENS.format('answer')} AS k FROM p) SELECT count(*) AS answers, CAST(sum(k) AS BIGINT) AS tokens FROM t")
def answer_totals(spark: SparkSession, sf: str) -> DataFrame:  # A10
    rows = pairs(spark, sf).select((prompt_tokens(F.col("question")) + prompt_tokens(F.col("answer"))).alias("k"))
    return rows.agg(F.count("*").alias("answers"), F.sum("k").alias("tokens"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's suppliers as a question's ranked sources; every third carries a citation of its own."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("qid"), F.col("s_suppkey").cast("int").alias("rank"), (F.col("s_suppkey") % 7).cast("int").alias("article_number"), F.when(F.col("s_suppkey") % 3 == 0, "Annex").alias("citation"), F.col("s_name").alias("text_en"))
    return rows.withColumns({"text_ar": F.lit(""), "is_repealed": F.lit(False), "source_status": F.lit(None).cast("string")})


BLOCKS = (
    "WITH s AS (SELECT s_nationkey AS qid, s_suppkey AS rank, s_suppkey % 7 AS a, s_name AS t, CASE WHEN s_suppkey % 3 = 0 THEN 'Annex' ELSE 'Civil Code, Article ' || (s_suppkey % 7) END AS c FROM supplier), "
    "b AS (SELECT *, chr(10) || '--- SOURCE ---' || chr(10) || 'Citation: ' || c || chr(10) || 'Article: ' || a || chr(10) || 'Repealed: False' || chr(10) || 'Source status: normal' || chr(10) || chr(10) || 'Arabic:' || chr(10) || chr(10) || chr(10) || 'English:' || chr(10) || t || chr(10) || '--- END SOURCE ---' || chr(10) AS block FROM s), "
    "j AS (SELECT qid, string_agg(block, chr(10) ORDER BY rank) AS context FROM b GROUP BY qid), "
    "f AS (SELECT qid, c, min(rank) AS r FROM s GROUP BY qid, c), l AS (SELECT qid, list(c ORDER BY r) AS cites FROM f GROUP BY qid) "
)


@query(
    BLOCKS + f"SELECT n.n_nationkey::BIGINT AS qid, '{SYSTEM}' || chr(10) || chr(10) || 'SOURCES:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || n.n_name || chr(10) || chr(10) || 'Answer in English, from these sources alone, and name the articles.' || chr(10) AS prompt FROM nation n LEFT JOIN j ON j.qid = n.n_nationkey"
)
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:  # G1 G2 G12
    questions = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("question"))
    return A.prompts(questions, _sources(spark, sf), SYSTEM, "English").select("qid", "prompt")


@query(BLOCKS + "SELECT n.n_nationkey::BIGINT AS qid, coalesce(cites, []) AS sources FROM nation n LEFT JOIN l ON l.qid = n.n_nationkey")
def citation_dedupe(spark: SparkSession, sf: str) -> DataFrame:  # G5 R23
    questions = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("question"))
    return A.prompts(questions, _sources(spark, sf), SYSTEM).select("qid", "sources")


PROMPT = f"'{SYSTEM}' || chr(10) || chr(10) || 'SOURCES:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || n.n_name || chr(10) || chr(10) || 'Answer in the language of the question, from these sources alone, and name the articles.' || chr(10)"


@query(
    BLOCKS + f", w AS (SELECT qid, arg_min(c, rank) || ': ' || arg_min(t, rank) AS answer FROM s GROUP BY qid), p AS (SELECT n.n_nationkey::BIGINT AS qid, {PROMPT} AS prompt, w.answer, coalesce(cites, []) AS sources FROM nation n LEFT JOIN j ON j.qid = n.n_nationkey LEFT JOIN l ON l.qid = n.n_nationkey LEFT JOIN w ON w.qid = n.n_nationkey) "
    f"SELECT qid, coalesce(answer, '{A.NO_SOURCES}') AS answer, sources, coalesce({TOKENS.format('prompt')}, 0) * CAST(prompt IS NOT NULL AS INTEGER) AS input_tokens, coalesce({TOKENS.format('answer')}, 0) * CAST(prompt IS NOT NULL AS INTEGER) AS output_tokens, 0.0::DOUBLE AS cost_usd FROM p"
)
def answers(spark: SparkSession, sf: str) -> DataFrame:  # G6 G8 G9
    questions = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("qid"), F.col("n_name").alias("question"))
    return A.answers(A.prompts(questions, _sources(spark, sf), SYSTEM)).select("qid", "answer", "sources", "input_tokens", "output_tokens", "cost_usd")


@query("SELECT item_id, 'Article ' || item_id || chr(10) || 'Arabic:' || chr(10) || chr(10) || chr(10) || 'English:' || chr(10) || text AS judge, 'Article ' || item_id || chr(10) || 'Arabic:' || chr(10) || chr(10) || 'English:' || chr(10) || text AS passage FROM benchmark")
def contexts(spark: SparkSession, sf: str) -> DataFrame:  # G3 G4
    from qanat.operators.retrieve import passage

    n, none = F.col("item_id"), F.lit(None).cast("string")
    return table(spark, sf, "benchmark").select("item_id", A.judge_context(n, none, F.col("text")).alias("judge"), passage(n, none, F.col("text")).alias("passage"))


@query(
    "WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS d FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, unnest(generate_series(0, len(d) + 1)) AS seq, d FROM c) "
    "SELECT conv_id AS qid, CAST(seq AS INTEGER) AS seq, CASE WHEN seq < len(d) THEN 'event: token' || chr(10) || 'data: ' || d[seq + 1] || chr(10) || chr(10) WHEN seq = len(d) THEN 'event: sources' || chr(10) || 'data: [\"s\"]' || chr(10) || chr(10) END AS message FROM e"
)
def sse_format(spark: SparkSession, sf: str) -> DataFrame:  # G7 K14
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("deltas")).withColumn("sources", F.array(F.lit("s")))
    return A.events(rows).select("qid", "seq", A.sse(F.col("event"), F.col("data")).alias("message"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) || chr(10) || chr(10) || 'Sources: a; b' || chr(10) AS body FROM conversations GROUP BY conv_id")
def stream_text(spark: SparkSession, sf: str) -> DataFrame:  # K15
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("answer"))
    return rows.select("conv_id", sinks.stream_text(F.col("answer"), F.array(F.lit("a"), F.lit("b"))).alias("body"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'truncation' WHEN turn % 3 = 1 THEN 'rate_limit' ELSE 'other' END AS error FROM conversations")
def error_classes(spark: SparkSession, sf: str) -> DataFrame:  # P16
    message = F.when(F.col("turn") % 3 == 0, "finish_reason was length").when(F.col("turn") % 3 == 1, "HTTP 429").otherwise("broken pipe")
    return table(spark, sf, "conversations").select("conv_id", "turn", A.error_class(F.lit("Error"), message).alias("error"))


@query("SELECT nation.n_name, region.r_name, round(sum(c_acctbal * CASE r_name WHEN 'ASIA' THEN 2.0::DOUBLE ELSE 1.0 END), 2) AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def cost_join(spark: SparkSession, sf: str) -> DataFrame:  # G11 as a join with a price table
    price = table(spark, sf, "region").select("r_regionkey", "r_name", F.when(F.col("r_name") == "ASIA", 2.0).otherwise(1.0).alias("price"))
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(price, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("c_acctbal") * F.col("price")), 2).alias("cost"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'span' ELSE 'event' END AS kind FROM conversations")
def trace_kinds(spark: SparkSession, sf: str) -> DataFrame:  # K13
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") > 200, "span").otherwise("event").alias("kind"))


#: The four metrics' pairs of texts: the answer is also the context, the question also the reference.
JUDGED = PAIRS + ", j AS (SELECT conv_id, turn, unnest(['faithfulness', 'answer_relevancy', 'context_precision', 'context_recall']) AS metric, unnest([answer, question, answer, question]) AS a, unnest([answer, answer, question, answer]) AS b FROM p)"
OVERLAP = (
    "w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(a), '[\\s]+'), lambda x: x <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(lower(b), '[\\s]+'), lambda x: x <> '')) AS r FROM j), "
    "o AS (SELECT *, CASE WHEN length(a) > 0 AND length(b) > 0 THEN round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, r))::DOUBLE / len(q) ELSE 0 END, 6) END AS value FROM w)"
)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("conv_id", "turn", F.col("question").alias("user_input"), F.col("answer").alias("response"), F.array(F.col("answer")).alias("contexts"), F.col("question").alias("reference"))


@query(JUDGED + f", {OVERLAP} SELECT conv_id, turn, max(value) FILTER (metric = 'faithfulness') AS faithfulness, max(value) FILTER (metric = 'answer_relevancy') AS answer_relevancy, max(value) FILTER (metric = 'context_precision') AS context_precision, max(value) FILTER (metric = 'context_recall') AS context_recall FROM o GROUP BY conv_id, turn")
def judge_scores(spark: SparkSession, sf: str) -> DataFrame:  # A22 R5
    from qanat.operators.judge import METRICS, judged

    return judged(_judged(spark, sf)).select("conv_id", "turn", *[F.round(m, 6).alias(m) for m in METRICS])


@query(
    JUDGED.replace("WITH ", "WITH RECURSIVE ", 1) + f", {OVERLAP}, t AS (SELECT conv_id, turn, metric, length(a) AS la, length(b) AS lb, 1 AS k, 4096 AS tokens FROM o WHERE value IS NOT NULL UNION ALL "
    "SELECT conv_id, turn, metric, la, lb, k + 1, CASE WHEN la % 2 = 0 AND tokens > 3000 THEN greatest(512, tokens // 2) ELSE least(16384, tokens * 2) END FROM t WHERE k < 4 AND ((la % 2 = 0 AND tokens > 3000) OR tokens < 40 * lb)), "
    "e AS (SELECT conv_id, turn, metric, max(k) AS attempts, arg_max(tokens, k) AS tokens, arg_max(CASE WHEN la % 2 = 0 AND tokens > 3000 THEN 'too_large' WHEN tokens < 40 * lb THEN 'truncation' END, k) AS fault, arg_max((la % 2 = 0 AND tokens > 3000) OR tokens < 40 * lb, k) AS bad FROM t GROUP BY ALL) "
    "SELECT conv_id, turn, metric, CASE WHEN NOT coalesce(bad, true) THEN value END AS value, coalesce(attempts, 0) AS attempts, coalesce(tokens, 4096) AS tokens, CASE WHEN bad THEN fault END AS error FROM o LEFT JOIN e USING (conv_id, turn, metric)"
)
def judge_retries(spark: SparkSession, sf: str) -> DataFrame:  # A22: attempts and token budgets of a judge that refuses large requests and cuts answers off
    from qanat.operators.judge import METRICS, judged

    rows = judged(_judged(spark, sf), "strained", detail=True)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value"), F.col(f"{m}_took").alias("took")) for m in METRICS])
    return rows.select("conv_id", "turn", F.inline(each)).select("conv_id", "turn", "metric", "value", "took.attempts", "took.tokens", "took.error")
