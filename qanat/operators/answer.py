"""Answers: request checks, context and prompt assembly, pluggable generation, citations, cost, event output."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.functions.text import prompt_tokens, strip_think
from qanat.operators.judge import CUT_NAME, CUT_WORDS, SLOW_DOWN

# The answer without sources, and prices by provider.
NO_SOURCES = "لم يتم العثور على مصادر قانونية كافية للإجابة عن السؤال."
#: USD for a million input and output tokens.
PRICES = {"GROQ": (0.29, 0.59), "GOOGLE_GENAI": (0.30, 2.50), "OLLAMA": (0.0, 0.0), "VLLM": (0.10, 0.25)}


def checked_requests(rows: DataFrame, default_k: int = 5) -> DataFrame:
    """(question, top_k) -> with the trimmed question, top_k, and reject_reason, null for a valid request."""
    q, k = F.trim(F.regexp_replace("question", r"(?U)^\s+|\s+$", "")), F.coalesce("top_k", F.lit(default_k))
    reason = F.when(q.isNull(), "no question").when(F.length(q) < 2, "question too short").when(~k.between(1, 20), "top_k out of range")
    return rows.withColumns({"question": q, "top_k": k, "reject_reason": reason})


def citation(number: Column, given: Column | None = None, work: str = "Civil Code") -> Column:
    own = F.concat(F.lit(f"{work}, Article "), number.cast("string"))
    return own if given is None else F.coalesce(F.nullif(given, F.lit("")), own)


def source_block(work: str = "Civil Code") -> Column:
    """One source of the context, of (article_number, citation, is_repealed, source_status, text_ar, text_en)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(
        F.lit("\n--- SOURCE ---\nCitation: "), citation(F.col("article_number"), F.col("citation"), work),
        F.lit("\nArticle: "), F.col("article_number").cast("string"),
        F.lit("\nRepealed: "), F.initcap(F.coalesce("is_repealed", F.lit(False)).cast("string")),
        F.lit("\nSource status: "), F.coalesce(F.nullif(F.col("source_status"), F.lit("")), F.lit("normal")),
        F.lit("\n\nArabic:\n"), text("text_ar"), F.lit("\n\nEnglish:\n"), text("text_en"), F.lit("\n--- END SOURCE ---\n"),
    )


def judge_context(number: Column, ar: Column, en: Column) -> Column:
    return F.concat(F.lit("Article "), number.cast("string"), F.lit("\nArabic:\n"), F.coalesce(ar, F.lit("")), F.lit("\n\nEnglish:\n"), F.coalesce(en, F.lit("")))


def prompts(questions: DataFrame, sources: DataFrame, system: str, language: str = "the language of the question", work: str = "Civil Code") -> DataFrame:
    """(qid, question) and ranked sources -> (qid, question, prompt, sources): sources hold citations in rank order."""
    blocks = sources.withColumns({"block": source_block(work), "cite": citation(F.col("article_number"), F.col("citation"), work)})
    own = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block", "cite"))).alias("s"))
    context = F.array_join(F.transform("s", lambda x: x["block"]), "\n")
    joined = questions.join(own, "qid", "left")
    prompt = F.concat(F.lit(f"{system}\n\nSOURCES:\n"), context, F.lit("\n\nQUESTION:\n"), F.col("question"), F.lit(f"\n\nAnswer in {language}, from these sources alone, and name the articles.\n"))
    return joined.select("qid", "question", F.when(F.col("s").isNotNull(), prompt).alias("prompt"), F.coalesce(F.array_distinct(F.transform("s", lambda x: x["cite"])), F.array().cast("array<string>")).alias("sources"))


def extractive(prompts: pd.Series) -> pd.Series:
    """The stand-in generator: the first source's citation and text."""
    return prompts.str.extract(r"Citation: ([^\n]*)", expand=False).fillna("") + ": " + prompts.str.extract(r"English:\n([^\n]*)", expand=False).fillna("")


GENERATORS: dict[str, Callable[[pd.Series], pd.Series]] = {"extractive": extractive}


def generator(name: str) -> Callable[[pd.Series], pd.Series]:
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; known: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name]


def answers(asked: DataFrame, name: str = "extractive", provider: str = "OLLAMA") -> DataFrame:
    """Prompts -> answers with tokens and cost; without sources the fixed refusal, and no call."""
    make = generator(name)

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield make(b)

    found, none = asked.filter("prompt is not null"), asked.filter("prompt is null")
    full = found.withColumn("answer", strip_think(call("prompt"))).withColumns({"input_tokens": prompt_tokens(F.col("prompt")), "output_tokens": prompt_tokens(F.col("answer"))})
    empty = none.withColumns({"answer": F.lit(NO_SOURCES), "input_tokens": F.lit(0), "output_tokens": F.lit(0)})
    return full.unionByName(empty).withColumn("cost_usd", cost(F.lit(provider), F.col("input_tokens"), F.col("output_tokens")))


def used_tokens(reported: Column, text: Column) -> Column:
    """The provider's count where it is there and not 0, else the estimate."""
    return F.coalesce(F.nullif(reported, F.lit(0)), prompt_tokens(text))


def cost(provider: Column, input_tokens: Column, output_tokens: Column, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """USD; a provider without a price costs nothing."""
    key = F.upper(F.coalesce(provider, F.lit("")))
    side = lambda i: F.coalesce(F.create_map(*[F.lit(x) for p, v in prices.items() for x in (p, float(v[i]))])[key], F.lit(0.0))
    return (input_tokens * side(0) + output_tokens * side(1)) / 1_000_000


def events(rows: DataFrame) -> DataFrame:
    """(qid, deltas array, sources) -> (qid, seq, event, data): tokens, then sources, then done; no done without sources."""
    tokens = F.transform("deltas", lambda d: F.struct(F.lit("token").alias("event"), d.alias("data")))
    tail = F.array(F.struct(F.lit("sources").alias("event"), F.to_json("sources").alias("data")))
    done = F.when(F.size("sources") > 0, F.array(F.struct(F.lit("done").alias("event"), F.lit("").alias("data")))).otherwise(F.array().cast("array<struct<event:string,data:string>>"))
    return rows.select("qid", F.posexplode(F.concat(tokens, tail, done)).alias("seq", "e")).select("qid", "seq", "e.event", "e.data")


def sse(event: Column, data: Column) -> Column:
    """One server-sent event; done is not shown."""
    return F.when(event != "done", F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n")))


def error_class(name: Column, message: Column) -> Column:
    """How a failed judge call is taken: cut off, told to slow down, or other."""
    both = F.lower(F.concat_ws(" ", name, message))
    cut = (name == CUT_NAME) | functools.reduce(Column.__and__, [message.contains(x) for x in CUT_WORDS])
    slow = functools.reduce(Column.__or__, [both.contains(x) for x in SLOW_DOWN])
    return F.when(cut, "truncation").when(slow, "rate_limit").otherwise("other")
