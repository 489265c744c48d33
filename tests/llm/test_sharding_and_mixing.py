import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from qanat.llm import mixing, sharding


def placed(df):
    return df.select("_doc.doc_id", "_doc.text", "size", "shard", "slot").collect()


def check(rows, shards, slack):
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    mean = sum(r["size"] for r in rows) / shards
    assert all(abs(sum(r["size"] for r in own) - mean) <= slack * mean for own in by.values())


def test_shards_are_near_equal(documents):
    rows = placed(sharding.shard(documents, 6))
    assert len(rows) == documents.count()
    largest = max(r["size"] for r in rows) / (sum(r["size"] for r in rows) / 6)
    check(rows, 6, 0.03 + largest)


def shards_of_texts(rows):
    found = defaultdict(set)
    for r in rows:
        found[r["text"]].add(r["shard"])
    return found


def test_one_text_fills_several_shards(docs_of):
    rows = placed(sharding.shard(docs_of([(i, "same text") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(30)]), 5))
    check(rows, 5, 0.05)
    assert all(len(s) == 1 for t, s in shards_of_texts(rows).items() if t != "same text")


def test_only_a_group_that_fits_no_shard_is_cut(docs_of):
    groups = [("a", 100), ("b", 70), ("c", 70), ("d", 70), ("e", 30), ("f", 3)]  # as bytes of 16 a row
    rows = [t * 8 for t, n in groups for _ in range(n)] + [f"text{i:04}" for i in range(457)]
    found = placed(sharding.shard(docs_of(list(enumerate(rows))), 8))
    check(found, 8, 0.05)
    assert {t[0]: len(s) for t, s in shards_of_texts(found).items() if len(set(t)) == 1 and len(t) == 8} == dict.fromkeys("abcdef", 1)


def test_ranges_within_shards(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE", 300)
    rows = [(i % 200, "same text" if i % 3 else f"t{i}") for i in range(900)] + [(None, None)] * 40
    for offsets in (400_000, 1):  # broadcast, and joined
        monkeypatch.setattr(sharding, "OFFSETS", offsets)
        check(placed(sharding.shard(docs_of(rows), 5)), 5, 0.06)


def test_groups_that_end_at_a_boundary(docs_of):
    rows = placed(sharding.shard(docs_of([(i, f"text {i % 4}") for i in range(400)] + [(1000 + i, "x" * 100_000) for i in range(4)]), 4))
    check(rows, 4, 0.06)
    assert all(len(s) == 1 for t, s in shards_of_texts(rows).items() if t.startswith("text"))


def test_sharding_cases(docs_of):
    docs = docs_of([(1, None), (None, "x"), (2, ""), (3, "é"), (3, "é")]).withColumnRenamed("lang", "u").withColumnRenamed("source", "shard")
    rows = placed(sharding.shard(docs, 3))
    assert sorted(r["size"] for r in rows) == [8, 8, 9, 10, 10]
    assert placed(sharding.shard(docs.limit(0), 3)) == []


def test_sharding_runs_no_python(documents):
    plan = sharding.shard(documents, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crc(documents, spark, sf):
    from qanat.llm.queries import QUERIES

    got = {r["doc_id"]: r["text_crc32"] for r in QUERIES["op2_sharding"](spark, sf).collect()}
    assert got == {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in documents.collect()}


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    total = 1.5 * 2015
    assert got["a"] == 20 and abs(sum(got.values()) - total) < 1e-6 and all(got[s] <= 2 * n for s, n in (("b", 1000), ("c", 1000), (None, 5)))
    assert got[None] == 10 and abs(got["b"] - (total - 30) * 2 / 3) < 1e-6 and abs(got["c"] - (total - 30) / 3) < 1e-6


def test_mix_meets_targets(documents):
    rows = mixing.mix(documents).select("_doc.source", "_doc.text", "size", "source_size", "target", "times", "taken").collect()
    for r in rows:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 2
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_mixing_cases(docs_of):
    docs = docs_of([(1, None), (2, " "), (None, "a b c"), (3, "d e"), (3, "d e")]).withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise("s")).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "h")
    rows = mixing.mix(docs).select("_doc.doc_id", "size", "taken").collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 2, 3]
    again = mixing.mix(docs).select("_doc.doc_id", "size", "taken").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_documents_without_words_are_taken_twice_at_most(docs_of):
    """A source at its cap is taken twice whole, its empty documents as often as the others."""
    rows = [(i, "" if i % 2 else "two words") for i in range(40)]
    small, large = docs_of(rows, source="a"), docs_of([(100 + i, "many words of a large source " * 20) for i in range(40)], source="b")
    got = mixing.mix(small.unionByName(large)).select("_doc.doc_id", "_doc.source", "times", "source_size", "target").collect()
    assert {r["times"] for r in got if r["source"] == "a"} == {2} and all(r["target"] == 2 * r["source_size"] for r in got if r["source"] == "a")
    assert max(r["times"] for r in got) <= 2
