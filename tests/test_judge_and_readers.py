import pytest
from pyspark.sql import functions as F

from qanat.operators import chunk, evaluate, judge
from qanat.sources import readers


def test_config_precedence():
    presets = {n: {"base_url": n, "key_env": f"{n}_KEY", "model_env": f"{n}_MODEL", "model": "m"} for n in ("groq", "vllm")}
    env = {"JUDGE_BASE_URL": "own", "groq_KEY": "k"}
    assert judge.provider_config(presets, "groq", env) == {"base_url": "own", "api_key": "k", "model": "m"}
    assert judge.provider_config(presets, "groq", env, explicit=True)["base_url"] == "groq"
    assert judge.provider_config(presets, "vllm", env, explicit=True) == {"base_url": "own", "api_key": "EMPTY", "model": "m"}
    with pytest.raises(ValueError, match="groq, vllm"):
        judge.provider_config(presets, "x", env)
    with pytest.raises(ValueError, match="overlap"):
        judge.scorer("x")


def test_judge_leaves_out_what_it_cannot_have(spark):
    row = spark.createDataFrame([("a b", "b c", ["b"], "")], "user_input string, response string, contexts array<string>, reference string")
    got = judge.judged(row).head()
    assert (got["faithfulness"], got["answer_relevancy"], got["context_precision"], got["context_recall"]) == (0.5, 0.5, None, None)


def test_binary_layout_and_lock(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"\xff page")
    assert readers.layout_texts(spark, f"{tmp_path}/a.pdf", lambda b: b.decode("utf-8", "replace")).head()["text"] == "\ufffd page"
    (tmp_path / "lock").write_text("stages:\n  x:\n    outs:\n    - path: a.json\n      hash: md5\n      md5: 0a1\n      size: 3\n    - path: b.json\n      md5: 0b2\n")
    assert [readers.locked_digest(spark, f"{tmp_path}/lock", n).head()["md5"] for n in ("a.json", "b.json", "c.json")] == ["0a1", "0b2", None]


def test_layout_files_by_line(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\n \n  two\f\fthree é\n".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"")
    got = sorted((r["document"][-5], r["page"], r["line"], r["text"]) for r in readers.layout_lines(spark, f"{tmp_path}/*.txt").collect())
    assert got[:3] == [("a", 1, 1, "one"), ("a", 1, 3, "  two"), ("a", 3, 1, "three é")] and len(got) == 4
    assert got[3][:3] == ("b", 0, 0) and got[3][3].startswith("UnicodeDecodeError")
    own = readers.layout_lines(spark, f"{tmp_path}/*.txt", lambda content: [content.hex(), "x"])
    assert sorted((r["document"][-5], r["page"], r["text"]) for r in own.filter("page = 1").collect())[1] == ("b", 1, "fffe")


def test_layout_lines_make_articles(spark, tmp_path):
    from qanat.operators import extract

    book = "Article 1\nFirst rule.\n\fArticle 2\nSecond rule.\n"
    (tmp_path / "book.txt").write_text(book)
    texts = readers.line_texts(readers.layout_lines(spark, f"{tmp_path}/book.txt")).select(F.xxhash64("document").alias("doc_id"), "text")
    got = [(r["article_number"], r["text_en"], r["source_page"]) for r in extract.articles(texts).orderBy("article_number").collect()]
    assert got == [(1, "First rule.", 1), (2, "Second rule.", 2)]


def test_logs_of_many_files_are_read_in_their_order(spark, tmp_path):
    for name, lines in (("b.log", "x\ntook 2 GiB\n"), ("a.log", "x\n" * 50 + "took 1 GiB\ntook 3 GiB\n"), ("c.log", "took 4 GiB\n" * 500)):
        (tmp_path / name).write_text(lines)
    assert readers.first_number(spark.read.text(f"{tmp_path}/*.log"), r"took (\d+) GiB").head()["value"] == 1
    assert readers.first_number(spark.read.text(f"{tmp_path}/*.log"), r"gave (\d+) GiB").head()["value"] is None


def test_evidence_lists_what_is_missing(spark):
    from qanat.sources.sinks import Section, evidence

    rows = spark.createDataFrame([("b", 1), ("a", None)], "k string, n int")
    got = evidence(spark, "T", [Section("One", None, ("k",), "k", "do this"), Section("Two", rows, ("k", "n"), "k", "-", "note"), Section("Three", rows.limit(0), ("k",), "k", "do that")]).head()
    assert got["report"] == "# T\n\n## Two\n\n| k | n |\n|---|---|\n| a | - |\n| b | 1 |\n\nnote\n\n## Missing\n\n- One: do this\n- Three: do that" and got["missing"] == 2
    assert evidence(spark, "T", [Section("Two", rows, ("k",), "k", "-")]).head()["missing"] == 0


def test_question_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    one = [r["k"] for r in readers.question_pool(rows, 10, 7, "k").collect()]
    assert one == [r["k"] for r in readers.question_pool(rows.repartition(9), 10, 7, "k").collect()] and len(set(one)) == 10
    assert one != [r["k"] for r in readers.question_pool(rows, 10, 8, "k").collect()]


def test_log_and_load_test(spark, tmp_path):
    lines = spark.createDataFrame([("x",), ("Model loading took 7.64 GiB",), ("Model loading took 8 GiB",)], "value string").coalesce(1)
    assert readers.first_number(lines, r"Model loading took ([\d.]+) GiB").head()["value"] == 7.64
    (tmp_path / "s.csv").write_text("Type,Name,Request Count,Failure Count,Requests/s,Average Response Time,50%,95%,99%\nPOST,/ask,7,0,0.06,14790,12000,26000,26000\n,Aggregated,7,0,0.06,1,1,1,1\n")
    assert [(r["name"], r["avg_s"], r["p95_s"]) for r in readers.load_test(spark, f"{tmp_path}/s.csv").collect()] == [("/ask", 14.79, 26.0)]


def test_gaps_and_spot_check(spark):
    rows = spark.createDataFrame([(n, "a", "b") for n in (1, 2, 5, 6, 9)], "article_number int, text_ar string, text_en string")
    assert sorted(r[0] for r in chunk.gaps(rows).collect()) == [2, 6]
    assert 9 in [r["article_number"] for r in evaluate.spot_check(rows, [9], 2).collect()]


def kept(**how):
    waits = []
    return judge.Retry(sleep=waits.append, **how), waits


def test_a_scorer_that_fails_gives_null():
    calls = []

    def flaky(a, b, tokens):
        calls.append(a)
        if calls.count(a) == 1 or a == "bad":
            raise ValueError(a)
        return 0.5

    retry, waits = kept()
    assert judge.attempted(flaky, [("good", "x"), ("bad", "x")], retry) == [(0.5, 2, 4096, 2.0, None), (None, 4, 4096, 6.0, "other")]
    assert waits == [2, 2, 2]


@pytest.mark.parametrize(
    ("need", "allowed", "want"),
    [
        (4096, 1 << 20, (1.0, 1, 4096)),
        (5000, 1 << 20, (1.0, 2, 8192)),
        (16384, 1 << 20, (1.0, 3, 16384)),
        (16385, 1 << 20, (None, 4, 16384)),  # no more can be asked for
        (100, 2048, (1.0, 2, 2048)),
        (100, 600, (1.0, 4, 512)),
        (100, 100, (None, 4, 512)),
        (3000, 2500, (None, 4, 2048)),  # too large, cut off, too large, cut off
    ],
)
def test_the_budget_grows_and_shrinks_within_limits(need, allowed, want):
    def score(a, b, tokens):
        if tokens > allowed:
            raise RuntimeError("413 Request too large for model")
        if tokens < need:
            raise RuntimeError("stopped, finish_reason=length")
        return 1.0

    retry, waits = kept()
    ((value, attempts, tokens, waited, _),) = judge.attempted(score, [("a", "b")], retry)
    assert (value, attempts, tokens) == want
    assert bool(waits) == (need > 16384) == (waited > 0)


def test_a_batch_backs_off_once_for_all_its_rows():
    rounds = []

    def score(a, b, tokens):
        rounds.append(a)
        if rounds.count(a) < int(a):
            raise RuntimeError("HTTP 429 slow down" if int(a) > 1 else "?")
        return 1.0

    retry, waits = kept(attempts=6, longest=15)
    got = judge.attempted(score, [(str(n), "x") for n in (1, 2, 3, 5, 9)], retry)
    assert waits == [5, 10, 15, 15, 15] and [g[1] for g in got] == [1, 2, 3, 5, 6]
    assert [g[3] for g in got] == [0, 5, 15, 45, 60] and got[-1][4] == "rate_limit"


def test_outcomes_stand_beside_the_metrics(spark):
    row = spark.createDataFrame([("a b c", "b c", ["b"], "x" * 200), ("", "b", ["b"], None)], "user_input string, response string, contexts array<string>, reference string")
    got = judge.judged(row, "strained", judge.QUICK, detail=True).collect()
    took = [tuple(got[0][f"{m}_took"])[:2] for m in judge.METRICS]
    assert took == [(1, 4096), (1, 4096), (2, 8192), (2, 2048)]
    assert [got[0][m] for m in judge.METRICS] == [0.5, 2 / 3, 0.0, 0.0] and [got[1][m] for m in judge.METRICS] == [1.0, None, None, None]
    assert got[1]["context_recall_took"]["attempts"] == 0


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark):
    from qanat.operators import chunk
    from qanat.session import BATCH, BATCH_BYTES

    text = "word " * 200_000
    own = spark.createDataFrame([(i, text, "") for i in range(12)], "article_number int, text_en string, text_ar string").coalesce(1)
    asked = own.selectExpr("text_en AS user_input", "text_en AS response", "array(text_en) AS contexts", "text_en AS reference")
    for use in (lambda: chunk.chunk_articles(own), lambda: judge.judged(asked)):
        spark.conf.unset(BATCH), spark.conf.unset(BATCH_BYTES)
        use()
        assert int(spark.conf.get(BATCH)) <= 1000 and int(spark.conf.get(BATCH_BYTES)) <= 4 << 20
    sizes = own.select("text_en").mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 12
