import math

import pytest
from pyspark.sql import functions as F

from qanat.operators import answer, evaluate, index, retrieve, telemetry
from qanat.sources import readers, sinks


def test_group_by_article_keeps_order_and_best_score(spark):
    hits = spark.createDataFrame(
        [(1, 1, 7, "en", 1, "b", 0.9, "c7"), (1, 2, 8, "ar", 0, "x", 0.8, "c8"), (1, 3, 7, "en", 0, "a", 0.95, "other"), (1, 4, None, "en", 0, "z", 1.0, "n")],
        "qid long, rank int, article_number int, language string, chunk_index int, text string, score double, citation string",
    )
    got = retrieve.group_by_article(hits).orderBy("first_rank").collect()
    assert [(r["article_number"], r["score"], r["text_en"], r["text_ar"], r["citation"]) for r in got] == [(7, 0.95, "a b", "", "c7"), (8, 0.8, "", "x", "c8")]


def test_hits_and_ranks(spark):
    row = spark.range(1).select(F.array(F.lit(3), F.lit(1), F.lit(2)).alias("r"), F.array(F.lit(1), F.lit(9)).alias("g"), F.array().cast("array<int>").alias("none"))
    got = row.select(evaluate.hit_at(F.col("r"), F.col("g"), 1), evaluate.hit_at(F.col("r"), F.col("g"), 2), evaluate.recall_at(F.col("r"), F.col("g"), 3), evaluate.recall_at(F.col("r"), F.col("none"), 3), evaluate.reciprocal_rank(F.col("r"), F.col("g")), evaluate.reciprocal_rank(F.col("r"), F.col("none"))).head()
    assert list(got) == [0, 1, 0.5, 0.0, 0.5, 0.0]


def test_consistencies_differ(spark):
    rows = spark.createDataFrame([("a", "ar", 1), ("a", "en", 1), ("b", "ar", None), ("b", "en", None), ("c", "ar", 2), (None, "ar", 1), (None, "en", 1)], "pair_id string, language string, top1 int")
    got = [evaluate.consistency(rows, k).head()["consistency"] for k in ("complete", "all", "strict")]
    assert got[0] == 1.0 and math.isclose(got[1], 2 / 3) and got[2] == 0.5
    assert [evaluate.consistency(rows.limit(0), k).head()["consistency"] for k in ("complete", "all", "strict")] == [0.0, None, 0.0]


@pytest.mark.parametrize(("n", "score", "scored", "md5", "problems"), [(20, 0.75, 20, "a", 0), (20, 0.74, 20, "a", 1), (10, 0.75, 10, "a", 1), (20, 0.75, 20, "b", 1), (20, 0.75, 10, "a", 1), (20, None, 0, "a", 2)])
def test_gate(spark, n, score, scored, md5, problems):
    row = spark.createDataFrame([(n, score, scored)], "n_questions int, faithfulness double, faithfulness_n int")
    got = evaluate.gate_problems(row, 0.75, 15, stale=[("corpus", "a", md5), ("questions", None, "x")]).head()
    assert len(got["problems"]) == problems and got["passed"] == (problems == 0)


def test_alert_edge_and_cost(spark):
    rows = spark.createDataFrame([(0.79,), (0.80,), (None,)], "faithfulness double")
    assert [r[0] for r in sinks.alerts(rows, 0.8).collect()] == [0.79]
    assert spark.range(1).select(answer.cost(F.lit("p"), F.lit(1_000_000), F.lit(500_000), {"P": (1.0, 2.0)})).head()[0] == 2.0
    assert spark.range(1).select(answer.cost(F.lit(None).cast("string"), F.lit(5), F.lit(5))).head()[0] == 0.0


@pytest.mark.parametrize(("q", "k", "reason"), [("", 5, "question too short"), ("   ", 5, "question too short"), (None, 5, "no question"), ("a", 5, "question too short"), (" ok ", 0, "top_k out of range"), (" ok ", 21, "top_k out of range"), (" ok ", None, None)])
def test_requests(spark, q, k, reason):
    assert answer.checked_requests(spark.createDataFrame([(q, k)], "question string, top_k int")).head()["reject_reason"] == reason


def test_answers_cite_once_and_refuse_without_sources(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "none")], "qid long, question string")
    sources = spark.createDataFrame([(1, 1, 147, None, "T"), (1, 2, 148, "", "U"), (1, 3, 147, None, "V")], "qid long, rank int, article_number int, citation string, text_en string")
    sources = sources.withColumns({"text_ar": F.lit(None).cast("string"), "is_repealed": F.lit(None).cast("boolean"), "source_status": F.lit("")})
    got = {r["qid"]: r for r in answer.answers(answer.prompts(questions, sources, "S"), provider="VLLM").collect()}
    assert got[1]["sources"] == ["Civil Code, Article 147", "Civil Code, Article 148"] and got[1]["answer"] == "Civil Code, Article 147: T" and got[1]["cost_usd"] > 0
    assert got[2]["answer"] == answer.NO_SOURCES and got[2]["cost_usd"] == 0
    with pytest.raises(ValueError, match="extractive"):
        answer.generator("nobody")
    with pytest.raises(ValueError, match="hash"):
        index.embedder("nobody")


def test_events_without_sources_have_no_end(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["s"]), (2, ["x"], [])], "qid long, deltas array<string>, sources array<string>")
    got = {q: [r["event"] for r in answer.events(rows).orderBy("seq").collect() if r["qid"] == q] for q in (1, 2)}
    assert got == {1: ["token", "token", "sources", "done"], 2: ["token", "sources"]}


def test_upsert_twice_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ar"), (1, "en"), (2, "ar"), (3, "en")], "article_number int, language string").withColumn("text", F.lit("old"))
    path = f"{tmp_path}/index"
    for _ in range(2):
        index.upsert(spark, path, rows, buckets=2)
        assert tuple(index.counts(index.read(spark, path)).head()) == (4, 3)
    index.upsert(spark, path, rows.filter("article_number = 1 and language = 'en'").withColumn("text", F.lit("new")), buckets=2)
    assert sorted((r["article_number"], r["text"]) for r in index.read(spark, path).collect()) == [(1, "new"), (2, "old"), (3, "old")]
    assert not index.ensure(spark, path, lambda: rows)


def test_points_check_their_length(spark):
    rows = spark.createDataFrame([("a", 1, "en", 0, 1, "article", "t", [1.0, 2.0])], "chunk_id string, article_number int, language string, chunk_index int, n_chunks int, chunk_type string, text string, embedding array<float>")
    assert index.points(rows, 2).count() == 1
    with pytest.raises(Exception, match="vector length of a"):
        index.points(rows, 3).collect()


def test_counter_reset_and_quantile(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate([5.0, 7.0, 3.0, 4.0])], "series string, ts long, value double")
    assert [r["delta"] for r in telemetry.increases(rows, ["series"]).orderBy("ts").collect()] == [0.0, 2.0, 3.0, 1.0]
    buckets = spark.createDataFrame([("m", 1.0, 5), ("m", 2.0, 10), ("m", float("inf"), 10)], "m string, le double, n long")
    assert telemetry.histogram_quantile(buckets, 0.75, ["m"]).head()["quantile"] == 1.5
    tail = spark.createDataFrame([("m", 1.0, 5), ("m", float("inf"), 10)], "m string, le double, n long")
    assert telemetry.histogram_quantile(tail, 0.9, ["m"]).head()["quantile"] == 1.0


def test_counters_cut_into_parts_give_the_same(spark):
    rows = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate([5.0, 7.0, 3.0, None, 4.0, 9.0, 1.0, 1.0])], "series string, ts long, value double")
    whole = sorted(map(tuple, telemetry.increases(rows, ["series"]).collect()), key=repr)
    for width in (1, 2, 3, 100):
        assert sorted(map(tuple, telemetry.increases(rows, ["series"], F.floor(F.col("ts") / width)).collect()), key=repr) == whole


def test_moving_average_of_long_and_short_series(spark):
    values = {"one": [4.0], "two": [1.0, 2.0], "long": [float(i % 13) for i in range(3000)]}
    rows = spark.createDataFrame([(k, i, v) for k, own in values.items() for i, v in enumerate(own)] + [("one", 9, None)], "k string, i int, v double")
    for r in telemetry.moving_average(rows, ["k"], "i", "v").collect():
        want = values[r["k"]][0]
        for x in values[r["k"]][1:]:
            want += 0.2 * (x - want)
        assert math.isclose(r["ema"], want, rel_tol=1e-12) and r["n"] == len(values[r["k"]])


def test_drift_of_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    cluster = lambda c, n: [(c + 0.3 * rng.normal(size=32) / np.sqrt(32)).tolist() for _ in range(n)]
    a, b = rng.normal(size=32), rng.normal(size=32)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    ref = spark.createDataFrame([(v,) for v in cluster(a, 60)], "embedding array<double>")
    middle = telemetry.centroid(ref, []).head()["centroid"]
    live = spark.createDataFrame([("in", v) for v in cluster(a, 30)] + [("out", v) for v in cluster(b, 30)] + [("few", v) for v in cluster(b, 5)], "stream string, embedding array<double>")
    got = {r["stream"]: r for r in telemetry.drift(live, F.array(*map(F.lit, middle)), F.lit(1.0), by=["stream"]).collect()}
    assert got["in"]["drift"] < 0.05 and not got["in"]["alert"] and got["out"]["drift"] > 0.5 and got["out"]["alert"] and got["few"]["drift"] is None


def test_tolerant_evaluation_set(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"questions": [{"user_input": "a?", "ground_truth": "t", "expected_article": "5"}, {"id": "x", "query": "b?", "articles": [{"article_number": 7}, "x", 9]}, {"question_ar": "c?", "my_article_no": 3}]}')
    got = readers.evaluation_set(spark, f"{tmp_path}/e.json").collect()
    assert [(r["id"], r["question"], r["reference"], r["expected_articles"]) for r in got] == [("q001", "a?", "t", [5]), ("x", "b?", "", [7, 9]), ("q003", "c?", "", [3])]
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="list"):
        readers.json_list(spark, f"{tmp_path}/bad.json")


def test_runs_and_registry(spark, tmp_path):
    row = spark.createDataFrame([(1.5, None, float("nan"), "s")], "a double, b double, c double, d string")
    sinks.log_run(f"{tmp_path}/runs", "r1", {"k": 5}, row)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/runs/metrics").collect()] == [("r1", "a", 1.5)]
    for cfg in ("x", "y"):
        sinks.promote(f"{tmp_path}/registry", spark, "chunking", cfg)
    assert {r["config"]: r["alias"] for r in sinks.registry(spark.read.parquet(f"{tmp_path}/registry")).collect()} == {"x": "archived", "y": "production"}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_best_articles_of_all_chunks(spark, batch):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, (60, 4)).astype(float)  # small whole numbers, so that scores tie
    articles = [None if i == 7 else int(a) for i, a in enumerate(rng.integers(1, 12, 60))]
    asked = rng.integers(-3, 4, (5, 4)).astype(float)
    chunks = spark.createDataFrame([(i, a, v.tolist()) for i, (a, v) in enumerate(zip(articles, vectors, strict=True))], "chunk_id long, article_number int, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r["qid"], r["rank"], r["article_number"], r["score"]) for r in retrieve.dense_top_articles(queries, chunks, 4).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q, v in enumerate(asked):
        best = {}
        for a, s in zip(articles, vectors @ v, strict=True):
            if a is not None:
                best[a] = max(best.get(a, -1e9), s)
        want += [(q, i + 1, a, s) for i, (a, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert got == want


def test_scroll_reads_no_vectors(spark, sf):
    found = index.scroll(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("label") == 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "embedding:" not in plan


def test_result_rows_have_every_column(spark):
    row = spark.createDataFrame([(1, 2, 0.5, "b", None)], "qid long, article_number int, score double, book string, is_repealed boolean")
    got = retrieve.result_rows(row.withColumn("extra", F.lit(1)))
    assert got.columns[:3] == ["qid", "article_number", "score"] and set(got.columns[3:]) == set(retrieve.RESULT)
    assert (got.head()["book"], got.head()["is_repealed"], got.head()["source_page"]) == ("b", False, None)


def test_alerts_by_parts_equal_alerts_in_one(spark):
    import random

    rng = random.Random(3)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([0, 40, 200])
        rows.append((rng.choice(["a", None]), t, i, rng.choice([10.0, 60.0, 60.0, 60.0, None])))
    samples = spark.createDataFrame(rows, "series string, s long, i long, value double").withColumn("ts", F.timestamp_seconds("s")).withColumn("at", F.struct("s", "i"))
    whole = telemetry.alerts_for(samples, F.col("value") > 50, 300, ["series"], "at").collect()
    parts = telemetry.alerts_for(samples, F.col("value") > 50, 300, ["series"], "at", F.floor(F.col("s") / 3000)).collect()
    want = []
    for name in ("a", None):
        run = []
        for r in [*[r for r in rows if r[0] == name], (name, 0, 0, 0.0)]:
            if r[3] is not None and r[3] > 50:
                run.append(r[1])
            else:
                if run and run[-1] - run[0] >= 300:
                    want.append((name, run[0], run[0] + 300, run[-1], len(run)))
                run = []
    assert len(want) > 5
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, parts), key=repr) == sorted(want, key=repr)


def test_rates_summed_by_step_first(spark):
    deltas = spark.createDataFrame([("a", 0, 1.0), ("a", 14, 2.0), ("a", 15, 4.0), ("a", 310, 8.0)], "series string, s long, delta double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["s"]: r["value"] for r in telemetry.over_windows(deltas, ["series"], "5 minutes", "15 seconds", per_second=False).select(F.unix_timestamp("at").alias("s"), "value").collect()}
    want = {e: sum(d for s, d in ((0, 1), (14, 2), (15, 4), (310, 8)) if e - 300 <= s < e) for e in range(15, 615, 15)}
    assert got == {e: v for e, v in want.items() if v}


def test_request_timings_of_missing_stages(spark):
    marks = spark.createDataFrame([(1, 10.0, "ask"), (1, 10.5, "found"), (1, 12.0, "done"), (2, 3.0, "ask")], "q long, s double, kind string").withColumn("ts", F.col("s").cast("timestamp"))
    got = telemetry.request_timings(marks, ["q"], {"retrieval": F.col("kind") == "found"}).collect()
    assert sorted(map(tuple, got)) == [(1, 2.0, 0.5), (2, 0.0, None)]


def test_health_counts_again_after_its_time(spark):
    rows, cache, reads = spark.createDataFrame([(1,), (1,), (2,)], "article_number int"), {}, []

    def read():
        reads.append(1)
        return rows

    assert index.health(read, cache, 100.0)["articles"] == 2
    assert index.health(read, cache, 160.0)["chunks"] == 3 and len(reads) == 1
    assert index.health(read, cache, 161.0)["status"] == "healthy" and len(reads) == 2
    gone = index.health(lambda: spark.read.parquet("/nowhere"), cache, 300.0)
    assert (gone["status"], gone["chunks"], cache["at"]) == ("unhealthy", 0, 161.0)


def test_no_monitor_without_a_reference(spark, tmp_path):
    telemetry.save_reference(spark.createDataFrame([([3.0, 0.0],), ([0.0, 2.0],)], "embedding array<double>"), f"{tmp_path}/r")
    found = telemetry.monitor(spark, f"{tmp_path}/r", window=5)
    assert [round(x, 6) for x in found["reference"]] == [0.707107] * 2 and (found["window"], found["threshold"]) == (5, 0.15)
    assert telemetry.monitor(spark, f"{tmp_path}/none") is None


def test_hash_embedding_by_hand(spark):
    import hashlib

    texts = ["One two two", "", "x " * 300]
    got = {r["text"]: r["embedding"] for r in index.embed(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    for t in (texts[0], texts[2]):
        want = [0.0] * 64
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            want[h % 64] += 1 if h >= 2**63 else -1
        size = math.sqrt(sum(x * x for x in want))
        assert got[t] == pytest.approx([x / size for x in want], abs=1e-6)
    assert len(got) == 2


def test_lookups_join_no_more_of_an_article_than_they_take(spark, monkeypatch):
    """Ids repeat and are missing; what is ranked by query is bounded for each of them."""
    monkeypatch.setattr(retrieve, "LOOKED_UP", 3)
    held = [(c, 1 + c % 2, "en" if c % 3 else "ar", c) for c in range(40)] + [(2, 1, "ar", -1)] * 5 + [(None, 1, "ar", -2), (4, None, "en", 0)]
    chunks = spark.createDataFrame(held, "chunk_id int, article_number int, language string, chunk_index int")
    queries = spark.createDataFrame([(q, a) for q, a in ((2, 1), (4, 1), (6, 1), (3, 2), (99, 2), (7, 9))], "qid int, article_number int")
    for own in (True, False):
        got = retrieve.exact_lookup(queries, chunks, skip_own=own)
        want = []
        for q, a in ((2, 1), (4, 1), (6, 1), (3, 2), (99, 2)):
            rows = sorted((lang, at, -1 if c is None else c) for c, n, lang, at in held if n == a and not (own and c in (None, q)))
            want += [(q, i + 1, lang, at) for i, (lang, at, _) in enumerate(rows[:3])]
        assert sorted((r["qid"], r["rank"], r["language"], r["chunk_index"]) for r in got.collect()) == sorted(want)
    joined, plain = [], retrieve.ranked
    monkeypatch.setattr(retrieve, "ranked", lambda rows, *rest: joined.append(rows) or plain(rows, *rest))
    retrieve.exact_lookup(queries, chunks)
    assert joined[-1].count() == 5 * 3
