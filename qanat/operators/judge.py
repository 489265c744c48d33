"""Pluggable scorers: rerankers of (query, passage) pairs and judges of answers, with deterministic local stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.session import text_batches

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
# What providers' failures say.
TOO_LARGE = "request too large"
CUT_NAME, CUT_WORDS = "IncompleteOutputException", ("finish_reason", "length")
SLOW_DOWN = ("ratelimit", "429", "rate limit", "resource_exhausted")
Score = Callable[[str, str], float]
#: A scorer that is told how many tokens its answer may take.
Budgeted = Callable[[str, str, int], float]


def overlap(a: str, b: str) -> float:
    """Share of the first text's distinct words that the second holds."""
    own = set(a.lower().split())
    return len(own & set(b.lower().split())) / len(own) if own else 0.0


def strained(a: str, b: str, tokens: int) -> float:
    """The stand-in for a judge under limits: 40 tokens a character of the second text are needed, and if the first is of even length no more than 3,000 may be asked for."""
    if len(a) % 2 == 0 and tokens > 3000:
        raise ValueError("request too large")
    if tokens < 40 * len(b):
        raise ValueError("finish_reason: length")
    return overlap(a, b)


SCORERS: dict[str, Score] = {"overlap": overlap}
BUDGETED: dict[str, Budgeted] = {"strained": strained}


def scorer(name: str) -> Budgeted:
    if name in BUDGETED:
        return BUDGETED[name]
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {', '.join(sorted([*SCORERS, *BUDGETED]))}")
    plain = SCORERS[name]
    return lambda a, b, tokens: plain(a, b)


@dataclass(frozen=True)
class Retry:
    """How often a scorer is asked, with how many tokens, and how long it is left alone in between, in seconds."""

    # The defaults.
    attempts: int = 4
    tokens: int = 4096
    least: int = 512
    most: int = 16384
    pause: float = 2
    slow: float = 5
    longest: float = 60
    sleep: Callable[[float], None] = time.sleep


#: For scorers that answer at once.
QUICK = Retry(pause=0, slow=0)
OUTCOME = "value double, attempts int, tokens int, waited double, error string"


def failure(e: Exception) -> str:
    """What a scorer's failure asks for: a smaller request, a larger answer, time, or just another attempt."""
    text = f"{type(e).__name__} {e}"
    if TOO_LARGE in text.lower():
        return "too_large"
    if type(e).__name__ == CUT_NAME or all(x in text for x in CUT_WORDS):
        return "truncation"
    if any(x in text.lower() for x in SLOW_DOWN):
        return "rate_limit"
    return "other"


def attempted(score: Budgeted, pairs: list[tuple[str, str]], retry: Retry) -> list[tuple[float | None, int, int, float, str | None]]:
    """(value, attempts, tokens, waited, error) of each pair, tried in rounds over all that are open.

    Each open pair is asked once a round. A pair whose request was too large asks for half the tokens next, one whose
    answer was cut off for twice as many, within limits. Between rounds the batch waits once for all its pairs: ever
    longer, up to ``longest``, if any was told to slow down, else ``pause`` if any failed otherwise. A pair that fails
    ``attempts`` times has no value; nothing a scorer raises ends the task.
    """
    value: list[float | None] = [None] * len(pairs)
    asked, tokens, waited = [0] * len(pairs), [retry.tokens] * len(pairs), [0.0] * len(pairs)
    error: list[str | None] = [None] * len(pairs)
    open_ = list(range(len(pairs)))
    for number in range(1, retry.attempts + 1):
        failed, kinds = [], set()
        for i in open_:
            asked[i] += 1
            try:
                value[i], error[i] = float(score(*pairs[i], tokens[i])), None
                continue
            except Exception as e:  # noqa: BLE001 - scorers are plugged in and may raise anything
                error[i] = kind = failure(e)
            failed.append(i)
            last = number == retry.attempts
            if kind == "too_large" and tokens[i] > retry.least:
                tokens[i] = tokens[i] if last else max(retry.least, tokens[i] // 2)
            elif kind == "truncation" and tokens[i] < retry.most:
                tokens[i] = tokens[i] if last else min(retry.most, tokens[i] * 2)
            else:
                kinds.add("rate_limit" if kind == "rate_limit" else "other")
        open_ = failed
        if not open_ or number == retry.attempts:
            break
        wait = min(retry.longest, retry.slow * 2 ** (number - 1)) if "rate_limit" in kinds else retry.pause if kinds else 0
        if wait:
            retry.sleep(wait)
            for i in open_:
                waited[i] += wait
    return list(zip(value, asked, tokens, waited, error, strict=True))


def pair_outcome(query: Column, passage: Column, name: str = "overlap", retry: Retry = QUICK) -> Column:
    """The scorer's value for each pair with what it took, batch by batch; null for a pair without a text."""
    score = scorer(name)
    fields = [f.split()[0] for f in OUTCOME.split(", ")]

    @F.pandas_udf(OUTCOME)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, p in batches:
            given = [(a, b) for a, b in zip(q, p, strict=True) if a is not None and b is not None]
            done = iter(attempted(score, given, retry))
            none = (None, 0, retry.tokens, 0.0, None)
            yield pd.DataFrame([none if a is None or b is None else next(done) for a, b in zip(q, p, strict=True)], columns=fields)

    return run(query, passage)


def pair_score(query: Column, passage: Column, name: str = "overlap", retry: Retry = QUICK) -> Column:
    """The scorer's value for each pair; null where it fails, and a missing text is empty."""
    return pair_outcome(F.coalesce(query, F.lit("")), F.coalesce(passage, F.lit("")), name, retry)["value"]


def judged(rows: DataFrame, name: str = "overlap", retry: Retry = QUICK, detail: bool = False) -> DataFrame:
    """(user_input, response, contexts array, reference) -> with the four metrics; one that cannot be had is null.

    detail: also attempts, tokens, waited and error of each metric, in a struct of its name and ``_took``.
    """
    text_batches(rows)
    text = F.array_join("contexts", " ")
    response, reference, asked = F.col("response"), F.col("reference"), F.col("user_input")
    pairs = {"faithfulness": (response, text), "answer_relevancy": (asked, response), "context_precision": (text, reference), "context_recall": (reference, text)}

    def outcome(a: Column, b: Column) -> Column:
        there = (F.length(a) > 0) & (F.length(b) > 0)
        return pair_outcome(F.when(there, a), F.when(there, b), name, retry)

    out = rows.withColumns({f"{m}_took": outcome(*pairs[m]) for m in METRICS}).withColumns({m: F.col(f"{m}_took.value") for m in METRICS})
    return out.withColumns({f"{m}_took": F.col(f"{m}_took").dropFields("value") for m in METRICS}) if detail else out.drop(*[f"{m}_took" for m in METRICS])


def provider_config(presets: Mapping[str, Mapping[str, str]], name: str, env: Mapping[str, str], explicit: bool = False, always: tuple[str, ...] = ("vllm",)) -> dict[str, str]:
    """url, key and model of a preset: JUDGE_* variables come first, unless the provider was chosen explicitly."""
    if name not in presets:
        raise ValueError(f"unknown judge provider {name!r}; known: {', '.join(sorted(presets))}")
    own, general = presets[name], not explicit or name in always
    pick = lambda *values: next((v for v in values if v), None)
    return {
        "base_url": pick(general and env.get("JUDGE_BASE_URL"), own["base_url"]),
        "api_key": pick(general and env.get("JUDGE_API_KEY"), env.get(own["key_env"]), "EMPTY"),
        "model": pick(general and env.get("JUDGE_MODEL"), env.get(own["model_env"]), own["model"]),
    }
