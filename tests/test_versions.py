import os

import pytest
from pyspark.sql import functions as F

from qanat.operators import cache, index
from qanat.sources import files, sinks, versions

ROWS = "id long, name string, score double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def failing(df):
    return df.withColumn("score", F.raise_error(F.lit("disk lost")).cast("double"))


ODD = [(1, 'a "quoted", name', 0.1), (2, "two\nlines", None), (3, None, 1e300), (4, " spaced ", -0.0), (5, "", 2.0), (6, "naïve، ١", 3.0)]


def test_both_files_or_none(spark, tmp_path):
    path = f"{tmp_path}/results"
    sinks.write_results(rows(spark, *ODD), path, ["id", "name", "absent"])
    assert sorted(tuple(r) for r in versions.read(spark, path, "json").collect()) == sorted(ODD)
    found = {r["id"]: r["name"] for r in versions.read(spark, path, "csv").collect()}
    assert found[1] == ODD[0][1] and found[2] == "two\nlines" and found[4] == " spaced " and versions.read(spark, path, "csv").columns == ["id", "name"]


def test_a_run_killed_between_the_two_writes_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/results"
    versions.commit(spark, path, {"json": (rows(spark, (1, "old", 1.0)), "json"), "csv": (rows(spark, (1, "old", 1.0)), "csv")})
    new = rows(spark, (2, "new", 2.0), (3, "new", 2.0))
    with pytest.raises(Exception, match="disk lost"):
        versions.commit(spark, path, {"json": (new, "json"), "csv": (failing(new), "csv")})
    assert versions.current(spark, path)["version"] == 1
    assert ids(versions.read(spark, path, "json")) == ids(versions.read(spark, path, "csv")) == [1]
    assert len(versions.vacuum(spark, path)) == 1 and ids(versions.read(spark, path, "json")) == [1]
    assert versions.commit(spark, path, {"json": (new, "json"), "csv": (new, "csv")}) == 2
    assert ids(versions.read(spark, path, "csv")) == [2, 3] and ids(versions.read(spark, path, "csv", 1)) == [1]


def test_a_commit_whose_writer_died_is_passed_over(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.commit(spark, path, {"a": (rows(spark, (1, "x", 1.0)), "parquet")})
    assert files.claim(spark, f"{path}/commits/{2:012d}.json", '{"version": 2, "par')
    assert versions.current(spark, path)["version"] == 1 and ids(versions.read(spark, path, "a")) == [1]
    assert versions.commit(spark, path, {"b": (rows(spark, (2, "y", 1.0)), "parquet")}) == 3
    assert ids(versions.read(spark, path, "a")) == [1] and [c["version"] for c in versions.history(spark, path)] == [1, 3]
    assert not files.claim(spark, f"{path}/commits/{3:012d}.json", "{}")


def test_of_two_commits_over_one_version_the_later_fails(spark, tmp_path, monkeypatch):
    path, first = f"{tmp_path}/t", rows(spark, (1, "x", 1.0))
    plain, slow = versions._write, []

    def interrupted(df, folder, form):
        if not slow:
            slow.append(1)
            versions.commit(spark, path, {"a": (rows(spark, (9, "other", 1.0)), "parquet")})
        return plain(df, folder, form)

    monkeypatch.setattr(versions, "_write", interrupted)
    with pytest.raises(versions.ConflictError):
        versions.commit(spark, path, {"a": (first, "parquet")})
    assert ids(versions.read(spark, path, "a")) == [9]
    slow.clear()
    assert versions.commit(spark, path, {"b": (first, "parquet")}, append=True) == 3


def damage(path):
    """Cuts one data file of the current version short."""
    for folder, _, names in os.walk(f"{path}/data"):
        for n in names:
            if n.startswith("part-"):
                os.remove(f"{folder}/{n}")
                return


@pytest.mark.parametrize("form", ["parquet", "json", "csv"])
def test_restore_copy_and_fallback(spark, tmp_path, form):
    path, spare, empty = (f"{tmp_path}/{x}" for x in ("live", "spare", "empty"))
    one, two = rows(spark, (1, "x", 1.0)), rows(spark, (2, "y", 2.0))
    versions.commit(spark, path, {"a": (one, form)})
    versions.copy(spark, path, spare)
    versions.commit(spark, path, {"a": (two, form), "b": (two, form)})
    assert versions.restore(spark, path, 1) == 3 and ids(versions.read(spark, path, "a")) == [1]
    assert versions.restore(spark, path, 2) == 4 and ids(versions.read(spark, path, "a")) == [2]
    assert versions.ensure(spark, path, ["a"], [spare]) == "there"
    damage(spare)
    with pytest.raises(versions.DamagedError):
        versions.restore(spark, spare, 1)
    with pytest.raises(FileNotFoundError):
        versions.ensure(spark, empty, ["a"], [spare, f"{tmp_path}/absent"])
    assert versions.ensure(spark, empty, ["a"], [spare, f"{tmp_path}/absent", path]) == path and ids(versions.read(spark, empty, "a")) == [2]

    def pull(target):
        versions.commit(spark, target, {"a": (one, form)})

    assert versions.ensure(spark, f"{tmp_path}/pulled", ["a"], [spare, pull]) == "pull"


def test_a_damaged_version_falls_back_to_the_one_before(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.commit(spark, path, {"a": (rows(spark, (1, "x", 1.0)), "parquet")})
    kept = versions.current(spark, path)["parts"]["a"]["folder"]
    versions.commit(spark, path, {"a": (rows(spark, (2, "y", 1.0)), "parquet")})
    now = versions.current(spark, path)["parts"]["a"]["folder"]
    assert kept != now
    files.remove(spark, f"{path}/{now}")
    assert versions.ensure(spark, path, ["a"], []) == "version 1" and ids(versions.read(spark, path, "a")) == [1]


def test_rows_of_other_content_do_not_verify(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.commit(spark, path, {"a": (rows(spark, *ODD), "parquet")})
    part = versions.current(spark, path)["parts"]["a"]
    assert versions.verified(spark, path, part)
    rows(spark, *[(i, n, 7.0) for i, n, _ in ODD]).write.mode("overwrite").parquet(f"{path}/{part['folder']}")
    assert not versions.verified(spark, path, part)


ARTICLES = "article_number int, text string"


def test_the_table_survives_a_failed_upsert(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.upsert(spark, path, spark.createDataFrame([(i, "old") for i in range(20)], ARTICLES), buckets=4)
    new = spark.createDataFrame([(i, "new") for i in range(10)], ARTICLES)
    with pytest.raises(Exception, match="disk lost"):
        index.upsert(spark, path, new.withColumn("text", F.when(F.col("article_number") == 7, F.raise_error(F.lit("disk lost"))).otherwise(F.col("text"))), buckets=4)
    assert {r["text"] for r in index.read(spark, path).collect()} == {"old"}
    index.upsert(spark, path, new, buckets=4)
    assert sorted((r["article_number"], r["text"]) for r in index.read(spark, path).collect()) == [(i, "new" if i < 10 else "old") for i in range(20)]
    assert {r["text"] for r in index.read(spark, path, 1).collect()} == {"old"}
    assert versions.restore(spark, path, 1) == 3 and {r["text"] for r in index.read(spark, path).collect()} == {"old"}
    with pytest.raises(ValueError, match="8 buckets"):
        index.upsert(spark, path, new, buckets=8)


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.upsert(spark, path, spark.createDataFrame([(i, "old") for i in range(40)], ARTICLES), buckets=8)
    before = versions.current(spark, path)["parts"]
    index.upsert(spark, path, spark.createDataFrame([(3, "new")], ARTICLES), buckets=8)
    after = versions.current(spark, path)["parts"]
    assert sum(before[b]["folder"] != after[b]["folder"] for b in before) == 1


def test_deleted_articles_are_gone_and_an_emptied_table_is_empty(spark, tmp_path):
    path = f"{tmp_path}/index"
    index.upsert(spark, path, spark.createDataFrame([(i, "old") for i in range(5)], ARTICLES), buckets=2)
    numbers = spark.range(5).select(F.col("id").cast("int").alias("article_number"))
    index.delete(spark, path, numbers.filter("article_number < 2"), buckets=2)
    assert sorted(r[0] for r in index.read(spark, path).collect()) == [2, 3, 4]
    index.delete(spark, path, numbers, buckets=2)
    assert index.read(spark, path).collect() == []
    assert index.ensure(spark, path, lambda: spark.createDataFrame([(9, "x")], ARTICLES), buckets=2)
    assert [r[0] for r in index.read(spark, path).collect()] == [9]


def requests(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "q string")


def test_a_second_run_computes_nothing(spark, tmp_path):
    path, asked = f"{tmp_path}/cache", []

    def compute(todo):
        asked.append(sorted((r["q"] or "-") for r in todo.collect()))
        return todo.filter("q is null or q <> 'none'").select("q", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), F.length("q").alias("score"))

    run = lambda *qs, **how: sorted(tuple(r) for r in cache.cached(requests(spark, *qs), ["q"], compute, path, **how).fillna("-").collect())
    one = run("a", "bb", "none", "a")
    assert one == [("a", 1, 1), ("a", 2, 1), ("bb", 1, 2), ("bb", 2, 2)] and run("a", "bb", "none") == one
    assert asked == [["a", "bb", "none"]]
    assert run("bb", "ccc") == [("bb", 1, 2), ("bb", 2, 2), ("ccc", 1, 3), ("ccc", 2, 3)] and asked[1:] == [["ccc"]]
    assert run("a", fingerprint="other model") == one[:2] and asked[2:] == [["a"]]
    assert len(run(None)) == 2 and len(run(None)) == 2 and asked[3:] == [["-"]]
    assert run("none") == [] and run() == [] and asked[4:] == []


def test_incomplete_results_are_computed_again(spark, tmp_path):
    path, score = f"{tmp_path}/cache", [None]
    run = lambda: cache.cached(requests(spark, "a"), ["q"], lambda t: t.withColumn("score", F.lit(score[0]).cast("double")), path, complete="score is not null").collect()
    assert run()[0]["score"] is None
    score[0] = 0.5
    assert [r["score"] for r in run()] == [0.5]
    score[0] = 0.9
    assert [r["score"] for r in run()] == [0.5]


def test_a_failed_computation_leaves_the_store(spark, tmp_path):
    path = f"{tmp_path}/cache"
    good = lambda t: t.withColumn("x", F.lit(1))
    cache.cached(requests(spark, "a"), ["q"], good, path)
    with pytest.raises(Exception, match="model lost"):
        cache.cached(requests(spark, "a", "b"), ["q"], lambda t: t.withColumn("x", F.raise_error(F.lit("model lost")).cast("int")), path)
    assert len(cache.cached(requests(spark, "a", "b"), ["q"], good, path).collect()) == 2


def test_reused_answers_are_complete_and_free(spark):
    dataset = spark.createDataFrame([("a", "A", 5.0), ("b", "B", 6.0), ("c", "C", 7.0), ("a", "Z", 1.0)], "id string, answer string, cost_usd double")
    results = spark.createDataFrame([("a", 0.5, 0.6), ("b", None, 0.6), ("d", 0.1, 0.1)], "id string, faithfulness double, relevancy double")
    got = [r.asDict() for r in cache.reused(dataset, results, ["faithfulness", "relevancy"]).collect()]
    assert got == [{"id": "a", "answer": "Z", "faithfulness": 0.5, "relevancy": 0.6, "cost_usd": 0.0, "tokens": 0, "latency_s": 0.0}]
