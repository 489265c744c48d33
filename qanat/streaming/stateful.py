"""Streaming twins: drift over the last vectors, moving averages, reasoning tags cut out of token streams, windowed rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


def drift_stream(rows: DataFrame, reference: list[float], baseline: float, window: int = 100, least: int = 20, threshold: float = 0.15) -> DataFrame:
    """(stream, seq, embedding) -> drift of each stream's last vectors after each batch, once there are enough.

    State is the last ``window`` unit vectors of a stream; while a batch is read, no more of it is kept.
    """
    middle = np.asarray(reference, np.float64)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], np.float64).reshape(-1, len(middle)) if state.exists else np.zeros((0, len(middle)))
        new = None
        for part in parts:
            new = (part if new is None else pd.concat((new, part))).sort_values("seq").tail(window)
        vectors = np.array(new["embedding"].tolist(), np.float64)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        held = np.concatenate((held, vectors))[-window:]
        state.update((held.tobytes(),))
        if len(held) >= least:
            mean = held.mean(0)
            gap = 1 - float(mean @ middle) / max(np.linalg.norm(mean), 1e-12)
            similar = float((held @ middle).mean())
            yield pd.DataFrame({"stream": [key[0]], "n": [len(held)], "drift": [gap], "similarity": [similar], "similarity_drop": [baseline - similar], "alert": [gap > threshold]})

    return rows.groupBy("stream").applyInPandasWithState(update, "stream string, n int, drift double, similarity double, similarity_drop double, alert boolean", "held binary", "update", GroupStateTimeout.NoTimeout)


def average_stream(rows: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(stream, seq, value) -> each stream's moving average after each batch; the first value seeds it."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        held = [(p["seq"].to_numpy(np.int64), p["value"].to_numpy(np.float64)) for p in parts]  # 16 bytes a row
        seq, values = (np.concatenate(x) for x in zip(*held, strict=True))
        values = values[np.argsort(seq, kind="stable")]
        for v in values[~np.isnan(values)].tolist():
            average, n = (v if average is None else average + alpha * (v - average)), n + 1
        if average is not None:
            state.update((average, n))
            yield pd.DataFrame({"stream": [key[0]], "ema": [average], "n": [n]})

    return rows.groupBy("stream").applyInPandasWithState(update, "stream string, ema double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)


def cut_thinking(held: str, inside: bool, started: bool, delta: str) -> tuple[str, str, bool, bool]:
    """(what is shown, held back, inside, started) after one more delta; a tag may be split over deltas."""
    held, shown = held + delta, ""
    while True:
        tag = CLOSE if inside else OPEN
        before, found, after = held.partition(tag)
        if not found:
            break
        shown += "" if inside else before
        held, inside = after, not inside
    back = next((k for k in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-k:])), 0)
    if not inside:
        shown += held[: len(held) - back]
    held = held[len(held) - back :] if back else ""
    shown = shown if started else shown.lstrip()
    return shown, held, inside, started or bool(shown)


def thinking_stream(rows: DataFrame) -> DataFrame:
    """(request, seq, delta, last) -> (request, seq, text): deltas without reasoning; what is held back comes with the last."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside, started = state.get if state.exists else ("", False, False)
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            shown, held, inside, started = cut_thinking(held, inside, started, r.delta)
            if r.last and not inside:
                shown, held = shown + (held if started or shown else held.lstrip()), ""
            out.append((key[0], r.seq, shown))
        state.update((held, inside, started))
        yield pd.DataFrame(out, columns=["request", "seq", "text"])

    return rows.groupBy("request").applyInPandasWithState(update, "request string, seq long, text string", "held string, inside boolean, started boolean", "append", GroupStateTimeout.NoTimeout)


def windowed(rows: DataFrame, late: str = "10 minutes", length: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """(ts, event_type, value) -> counts and sums in sliding event-time windows; later rows than the watermark are dropped."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(rows: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")
