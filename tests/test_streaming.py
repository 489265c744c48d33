import random

import pytest
from pyspark.sql import functions as F

from qanat.operators import telemetry
from qanat.streaming import alerts, delivery, stateful
from qanat.streaming.run import drained, finished


def play(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize(
    ("deltas", "text"),
    [(["<thi", "nk>secret ", "reasoning</th", "ink>\n\nالمادة ", "147", " تنص"], "المادة 147 تنص"), (["a < b ", "and <", "b>"], "a < b and <b>"), (["x<th"], "x<th"), (["<think>never closed"], "")],
)
def test_thinking_is_cut(deltas, text):
    held, inside, started, out = "", False, False, ""
    for d in deltas:
        shown, held, inside, started = stateful.cut_thinking(held, inside, started, d)
        out += shown
    assert out + ("" if inside else held) == text


def test_thinking_stream(spark, tmp_path):
    deltas = ["<thi", "nk>x</think>", "\n a", "b <"]
    rows = [("r", i, d, i == 3) for i, d in enumerate(deltas)]
    got = play(stateful.thinking_stream(stream(spark, tmp_path, rows, "request string, seq long, delta string, last boolean")), "thinking")
    assert "".join(r["text"] for r in got.orderBy("seq").collect()) == "ab <"


def test_average_stream(spark, tmp_path):
    rows = [("s", i, v) for i, v in enumerate([1.0, 0.0, None, 1.0])]
    got = play(stateful.average_stream(stream(spark, tmp_path, rows, "stream string, seq long, value double")), "averages", "update").collect()
    assert [(r["n"], round(r["ema"], 4)) for r in got] == [(3, 0.84)]


def test_drift_stream(spark, tmp_path):
    rows = [("in", i, [1.0, 0.01 * i]) for i in range(25)] + [("out", i, [0.0, 1.0]) for i in range(25)] + [("few", 0, [0.0, 1.0])]
    got = {r["stream"]: r for r in play(stateful.drift_stream(stream(spark, tmp_path, rows, "stream string, seq long, embedding array<double>"), [1.0, 0.0], 1.0), "drifts", "update").collect()}
    assert not got["in"]["alert"] and got["out"]["alert"] and abs(got["out"]["drift"] - 1) < 1e-9 and "few" not in got


def test_windows_and_sessions(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert play(stateful.windowed(events), "windows").count() > 0
    assert play(stateful.sessions(events), "sessions").count() > 0


SAMPLES = "kind string, ts timestamp, id long, value double"


def samples(spark, rows):
    return spark.createDataFrame(rows, "kind string, s long, id long, value double").select("kind", F.timestamp_seconds("s").alias("ts"), "id", "value")


@pytest.fixture(scope="module")
def series():
    rng = random.Random(8)
    rows, now = [], dict.fromkeys("abc", 1_700_000_000)
    for i in range(900):
        kind = rng.choice("aabc")
        now[kind] += rng.choice([0, 30, 60, 200, 900])
        rows.append((kind, now[kind], i, rng.choice([60.0, 70.0, 80.0, 10.0 if rng.random() < 0.4 else 90.0, None])))
    end = max(now.values())
    return [*rows, *[(k, end + 10, 10_000, 0.0) for k in "abc"], ("a", end + 100_000, 10_001, 0.0)]


def notices_of(spark, tmp_path, files, **how):
    """Each file is a micro-batch; the stream is stopped and started again before each."""
    for k, rows in enumerate(files):
        samples(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = alerts.alert_stream(spark.readStream.schema(SAMPLES).parquet(f"{tmp_path}/in"), F.col("value") > 50, 300, "kind", **how)
        out = finished(found, "append", f"{tmp_path}/run")
    return out


def test_alerts_equal_the_batch_over_restarts_and_late_samples(spark, tmp_path, series):
    rows = sorted(series, key=lambda r: (r[1], r[2]))
    mixed = sorted(rows[:-1], key=lambda r: r[1] + random.Random(r[2]).randrange(1800))  # out of order by half an hour
    files = [mixed[:200], mixed[200:201], mixed[201:600], [*mixed[600:], rows[-1]]]
    got = notices_of(spark, tmp_path, files, late="30 minutes")
    batch = telemetry.alerts_for(samples(spark, series).withColumn("at", F.struct("ts", "id")), F.col("value") > 50, 300, ["kind"], "at")
    want = {tuple(r) for r in batch.select("kind", "since", "fired", "until", "n").collect()}
    assert len(want) > 20
    assert {(r["series"], r["since"], r["since"] + 300, r["until"], r["n"]) for r in got.filter("kind = 'resolved'").collect()} == want
    firing = got.filter("kind = 'firing'")
    assert {(r["series"], r["at"]) for r in firing.collect()} == {(k, fired) for k, _, fired, _, _ in want}
    silent = telemetry.repeated(batch.select("kind", "fired"), ["kind"], 3600)
    assert {(r["series"], r["at"]) for r in alerts.unrepeated(got).collect()} == {tuple(r) for r in silent.collect()}
    assert firing.count() == len(want)


def test_reminders_come_by_the_clock_and_silence_ends_a_series(spark, tmp_path):
    rows = [("x", 10**9, 1, 60.0), ("x", 10**9 + 400, 2, 60.0), ("y", 10**9 + 4000, 3, 0.0), ("y", 10**9 + 20_000, 4, 0.0)]
    got = notices_of(spark, tmp_path, [rows[:2], rows[2:3], rows[3:]], every=3600, quiet=10_000)
    assert sorted((r["batch"], r["kind"], r["at"] - 10**9) for r in got.collect()) == [(3, "firing", 300), (3, "repeat", 3900), (5, "repeat", 7500), (5, "silent", 10_400)]


def test_short_runs_and_null_samples_do_not_fire(spark, tmp_path):
    rows = [("x", 0, 1, 60.0), ("x", 200, 2, None), ("x", 310, 3, 60.0), ("x", 400, 4, 0.0), ("x", 9000, 5, 0.0), ("x", 9001, 6, 0.0)]
    assert notices_of(spark, tmp_path, [rows]).count() == 0


def test_null_series_and_samples_without_a_time(spark, tmp_path):
    base = 10**9
    rows = [(None, base, 1, 60.0), (None, base + 400, 2, 60.0), (None, None, 3, 0.0), (None, base + 500, 4, 0.0), ("x", None, 5, 60.0), ("x", base + 9000, 6, 0.0)]
    got = notices_of(spark, tmp_path, [rows])
    assert sorted((r["series"], r["kind"], r["at"] - base, r["n"]) for r in got.collect()) == [(None, "firing", 300, 2), (None, "resolved", 500, 2)]


def notes(spark, rows):
    return spark.createDataFrame(rows, alerts.NOTICE)


def note(series, kind, at):
    return (series, kind, at, 0, 0, 1, None)


def test_replayed_batches_send_nothing_twice(spark, tmp_path):
    log, folder = str(tmp_path / "sent"), str(tmp_path / "out")

    def hook(key, text):
        with open(log, "a") as f:
            f.write(text + "\n")
        return True

    put = delivery.sink(folder, "Low", hook)
    one = notes(spark, [note("a", "firing", 100), note("b", "firing", 105), note("b", "firing", 105), note("a", "firing", 110), note(None, "resolved", 100)])
    for _ in range(3):
        put(one, 0)
    put(notes(spark, [note("a", "resolved", 300)]), 1)
    put(one, 0)
    assert sorted(open(log).read().split("\n")[:-1]) == ["Low firing at 100: a, b", "Low firing at 110: a", "Low resolved at 100: -", "Low resolved at 300: a"]


def test_what_a_hook_refuses_is_sent_with_the_next_batch(spark, tmp_path):
    folder, flag = str(tmp_path / "out"), tmp_path / "up"

    def hook(key, text):
        if not flag.exists():
            raise OSError("down")
        return True

    put = delivery.sink(folder, "Low", hook)
    put(notes(spark, [note("a", "firing", 100)]), 0)
    put(notes(spark, [note("a", "firing", 100)]), 1)
    flag.touch()
    put(notes(spark, []), 2)
    put(notes(spark, []), 3)
    got = sorted((r["batch"], r["text"], r["delivered"], r["attempts"]) for r in delivery.outcomes(spark, folder).collect())
    assert got == [(k, "Low firing at 100: a", k == 2, k + 1) for k in range(3)]


def test_a_crash_before_the_batch_is_committed_replays_it(spark, tmp_path, series):
    """The stream fails after the hook was called and the outcome written, so the engine runs the batch again."""
    log, folder = str(tmp_path / "sent"), str(tmp_path / "run")

    def hook(key, text):
        with open(log, "a") as f:
            f.write(key + "\n")
        return True

    put, failed = delivery.sink(folder, "Low", hook), []

    def fails_once(batch, number):
        put(batch, number)
        if not failed and delivery.outcomes(spark, folder).head(1):
            failed.append(number)
            raise OSError("lost")

    samples(spark, series).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: alerts.alert_stream(spark.readStream.schema(SAMPLES).parquet(f"{tmp_path}/in"), F.col("value") > 50, 300, "kind")
    with pytest.raises(Exception, match="lost"):
        drained(stream(), "append", folder, fails_once)
    drained(stream(), "append", folder, fails_once)
    sent = open(log).read().split()
    assert failed and len(sent) == len(set(sent)) == delivery.outcomes(spark, folder).count() > 20
