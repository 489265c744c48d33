"""Alert rules with a duration as a stream: pending, firing, hourly repeats and resolution, by event-time timers.

Samples of a series are held until the watermark has passed them, so they take effect in the order of their times
whatever batch they came in. A timer at the earliest held sample's time releases them; a timer at the next reminder's
time sends it although no sample comes; a timer after ``quiet`` seconds without samples ends a series' alert and forgets
the series. State lies in RocksDB: the current run of bad samples (six numbers) and what is held, 17 bytes a sample.

A run of bad samples without a good one between fires once it has lasted ``hold`` seconds, as ``alerts_for`` has it. The
work of one series is sequential; series run in parallel.

Defined cases: a null breach is a good sample; samples without a time are left out; samples of one time are taken in
the order of their ids; a sample that comes after the watermark has passed its time is dropped; a series key may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NOTICE = "series string, kind string, at long, since long, until long, n long, before long"
NAMES = [c.split()[0] for c in NOTICE.split(", ")]
SAMPLE = np.dtype([("ts", "<i8"), ("id", "<i8"), ("bad", "u1")])
#: Of state stores only this one knows timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertRule(StatefulProcessor):
    """Samples (series, ts, id, bad) -> notices; times in state are seconds, those of samples microseconds."""

    def __init__(self, hold: int, every: int, quiet: int | None):
        self.hold, self.every, self.quiet = hold, every, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "samples binary")
        self.run = handle.getValueState("run", "since long, until long, n long, fired long, reminder long, before long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = np.array([(int(r["us"]), int(r["id"]), bool(r["bad"])) for r in rows], SAMPLE)
        if self.held.exists():
            new = np.concatenate((np.frombuffer(self.held.get()[0], SAMPLE), new))
        self.held.update((new.tobytes(),))
        self.timer(int(new["ts"].min()) // 1000, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def timer(self, at: int, mark: int) -> None:
        """A timer that the next watermark can pass; the engine looks at no time that an earlier one has passed."""
        self.handle.registerTimer(max(at, mark + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        state = list(self.run.get()) if self.run.exists() else [None] * 7
        out: list[tuple] = []
        due = np.zeros(0, SAMPLE)
        if self.held.exists():
            held = np.frombuffer(self.held.get()[0], SAMPLE)
            passed = held["ts"] // 1000 < mark
            due, rest = np.sort(held[passed], order=["ts", "id"]), held[~passed]
            if len(rest):
                self.held.update((rest.tobytes(),))
                self.timer(int(rest["ts"].min()) // 1000, mark)
            else:
                self.held.clear()
        quiet = np.iinfo(np.int64).max if self.quiet is None else self.quiet
        edges = np.flatnonzero((np.diff(due["bad"]) != 0) | (np.diff(due["ts"] // 1_000_000) > quiet)) + 1
        for part in np.split(due, edges) if len(due) else []:
            seconds = part["ts"] // 1_000_000
            if state[6] is not None and int(seconds[0]) - state[6] > quiet:
                self.good(state, state[6] + quiet, out, "silent")
            self.bad(state, seconds, out) if part["bad"][0] else self.good(state, int(seconds[0]), out, "resolved")
            state[6] = int(seconds[-1])
        end = None if self.quiet is None or state[6] is None else state[6] + self.quiet
        if end is not None and end < mark // 1000:
            self.good(state, end, out, "silent")
            self.run.clear()
        else:
            self.remind(state, mark // 1000, out)
            self.run.update(tuple(state))
            for at in (state[4], None if end is None else end + 1):
                if at is not None:
                    self.timer(at * 1000, mark)
        for notice in out:
            yield Row(**dict(zip(NAMES, (*key, *notice), strict=True)))

    def bad(self, state: list, seconds: np.ndarray, out: list) -> None:
        """One or more bad samples in a row."""
        if state[0] is None:
            state[0], state[2] = int(seconds[0]), 0
        since = state[0]
        lasting = seconds - since >= self.hold
        if state[3] is None and lasting.any():
            at = int(np.argmax(lasting))
            state[3] = since + self.hold
            out.append(("firing", state[3], since, int(seconds[at]), state[2] + at + 1, state[5]))
            state[4] = state[3] + self.every
        state[1], state[2] = int(seconds[-1]), state[2] + len(seconds)
        self.remind(state, state[1], out)

    def remind(self, state: list, upto: int, out: list) -> None:
        """Reminders of an alert that fires, before ``upto``."""
        while state[4] is not None and state[4] < upto:
            out.append(("repeat", state[4], state[0], state[1], state[2], state[5]))
            state[4] += self.every

    def good(self, state: list, at: int, out: list, kind: str) -> None:
        """A good sample, or none any more, ends the run."""
        if state[3] is not None:
            self.remind(state, at, out)
            out.append((kind, at, state[0], state[1], state[2], state[5]))
            state[5] = state[3]
        state[:5] = [None] * 5

    def close(self) -> None:
        pass


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def alert_stream(samples: DataFrame, breach: Column, hold: int, series: str, every: int = 3600, late: str = "0 seconds", quiet: int | None = None) -> DataFrame:
    """(series, ts, id, ..) -> notices (series, kind, at, since, until, n, before), in seconds.

    kind: firing, repeat (every so many seconds while it fires), resolved (by a good sample) or silent (after ``quiet``
    seconds). since, until, n: the run of bad samples as known by then; before: when the series' alert before fired.
    """
    use_timers(samples.sparkSession)
    bad = F.coalesce(breach, F.lit(False)).alias("bad")
    rows = samples.filter("ts is not null").select(F.col(series).cast("string").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("id").cast("long").alias("id"), bad)
    return rows.withWatermark("ts", late).groupBy("series").transformWithState(AlertRule(hold, every, quiet), NOTICE, "Append", "EventTime")


def unrepeated(notices: DataFrame, every: int = 3600) -> DataFrame:
    """Firing notices without those within ``every`` seconds of the series' alert before."""
    return notices.filter((F.col("kind") == "firing") & (F.col("before").isNull() | (F.col("at") - F.col("before") >= every)))
