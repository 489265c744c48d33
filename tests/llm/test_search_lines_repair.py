import random

import pytest
from pyspark.sql import functions as F

from qanat.llm import lexical, line_dedup, queries, repair
from tests.llm import brute

LINE = "a line that many of the documents hold, over and over, {}"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def deduped(docs, **how):
    left = line_dedup.applied(docs, line_dedup.line_dedup(docs, **how))
    return plain(left.select("_doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)))


@pytest.fixture(scope="module")
def lined(docs_of):
    rng = random.Random(3)
    pool = [LINE.format(c) for c in "abcdefgh"] + ["  " + LINE.format("A").upper() + "\t", "short", "", "x" * 39, "É" * 40, "é" * 40]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)))) for i in range(40)]
    rows += [(40, None), (41, ""), (None, "\n".join(pool)), (None, LINE.format("a")), (7, LINE.format("b")), rows[3], rows[3], (39, LINE.format("c"))]
    rows.append((42, "\n".join([LINE.format(rng.randrange(3000)) for _ in range(2000)])))
    rows += [(100 + i, "\n".join([LINE.format("everywhere")] * (1 + i % 3))) for i in range(70)]
    return rows, docs_of(rows)


@pytest.mark.parametrize("heavy", [None, 1, 3, 10**6])
def test_lines_equal_brute_force(lined, heavy):
    rows, docs = lined
    assert deduped(docs, heavy=heavy) == sorted(brute.line_dedup(rows), key=repr)


def test_bitmaps_name_only_words_that_lose_lines(docs_of):
    rows = [(i, "\n".join([f"own {i}"] * 200 + [LINE.format("x")])) for i in range(5)]
    found = {r["doc"]: r for r in line_dedup.line_dedup(docs_of(rows)).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    assert [tuple(e) for e in found[0]["keep"]] == [(3, ~(1 << 8))] and found[0]["n_dropped"] == 1


def test_lines_without_python(spark, sf):
    plan = queries.op12_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_of_clashing_columns_and_empty_tables(spark, docs_of):
    rows = [(i, LINE.format("x")) for i in range(6)]
    docs = docs_of(rows).select("doc_id", "text", *[F.lit(1).alias(c) for c in ("doc", "mark", "pos", "u", "v", "keep", "kept", "n_dropped", "_doc")])
    assert deduped(docs) == sorted(brute.line_dedup(rows), key=repr)
    assert deduped(docs.limit(0)) == []


def searched(docs, items, **how):
    return {tuple(r) for r in lexical.ranked(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()}


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Über", "über", "ÜBER", "naïve", "日本", "a" * 70, "A" * 70, "x1"]
    text = lambda n: rng.choice(" .,-\n").join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(150)] + [(200, None), (201, ""), (202, " .;\x00\x7f")]
    docs += [docs[0], docs[0], (None, text(20)), (None, text(3)), (203, docs[5][1]), (204, docs[5][1]), (205, text(400_000))]
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(3, "w1 w1 w1"), (20, None), (21, "?"), (22, "unknown"), (None, "w2 x1")]
    return docs, items


@pytest.mark.parametrize(("pairs", "chunk"), [(10**6, 1 << 21), (20, 50)])
def test_search_equals_brute_force(spark, docs_of, vocabulary, monkeypatch, pairs, chunk):
    docs, items = vocabulary
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 10):
        assert searched(docs_of(docs), asked, k=k, pairs=pairs) == brute.search(docs, items, k)


def test_long_texts_are_cut_at_separators(monkeypatch):
    import pyarrow as pa

    text = "abc defg  " * 50 + "x" * 200 + " end"
    monkeypatch.setattr(lexical, "STEP", 16)
    parts = list(lexical.term_slices(pa.array(["one two", None, text, "", "three"])))
    words = {}
    for row, texts in parts:
        for i in range(len(texts.first) - 1):
            words.setdefault(row + i, []).extend(bytes(texts.bytes[a:b]).decode() for a, b in zip(texts.starts[texts.first[i] : texts.first[i + 1]], texts.ends[texts.first[i] : texts.first[i + 1]], strict=True))
    assert {k: v for k, v in words.items() if v} == {0: ["one", "two"], 2: text.split(), 4: ["three"]}
    assert all(len(t.bytes) <= 220 for _, t in parts)


def test_radix_order_is_stable():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) // 7 * 7
    keys[::3] = keys[0]
    assert (lexical.radix_order(keys, 1 << 40) == np.argsort(keys, kind="stable")).all()


def test_search_of_empty_tables_and_clashing_columns(spark, docs_of, vocabulary):
    docs, items = vocabulary
    asked = spark.createDataFrame(items, "item_id long, text string")
    more = [F.lit(1).alias(c) for c in ("id", "n", "terms", "number", "item", "term", "score", "rank")]
    assert searched(docs_of(docs).select("*", *more), asked.select("*", *more[:2], F.lit(2).alias("doc_id"))) == brute.search(docs, items)
    assert searched(docs_of(docs).limit(0), asked) == set()
    assert searched(docs_of(docs), asked.limit(0)) == set()


CONV = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, **how):
    found = repair.summary(repair.repair(spark.createDataFrame(rows, CONV).repartition(3), **how)).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "student"])
            rows.append((conv, rng.choice([turn, turn + 1, None] if rng.random() < 0.2 else [turn]), role, rng.choice(["Yes.", "no", "why?", "One.", "two", " \t", None, "", "três!", "ok. "])))
    return [*rows, *rows[:9]]


@pytest.mark.parametrize("most", [10**6, 5, 1])
def test_repair_equals_brute_force(spark, talks, most):
    assert repaired(spark, talks, most_rows=most) == brute.repair(talks)


def test_one_long_conversation(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{t}.", f"{t}"])) for t in range(600)]
    rows += [(1, 5, "user", "the same turn again.")] * 200 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    whole = repaired(spark, rows)
    assert repaired(spark, rows, most_rows=40) == whole and repaired(spark, rows, most_bytes=500) == whole


def test_edits_give_legal_conversations(spark, talks):
    found = repair.repair(spark.createDataFrame(talks, CONV))
    for conv in {r["conv_id"] for r in found.select("conv_id").collect()}:
        own = found.filter(F.col("conv_id").eqNullSafe(F.lit(conv))).collect()
        left = "".join(r["new_role"][0] for r in own if r["edit"] not in (None, "D"))
        assert not left or left.removeprefix("s") == "ua" * (len(left.removeprefix("s")) // 2) != ""
        assert all(r["edit"] == "D" for r in own if r["fault"] in ("blank", "duplicate"))


def test_repair_of_given_conversations(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, sf).collect()} == brute.repair(rows)


def test_repair_of_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.summary(repair.repair(empty)).collect() == []
    more = empty.unionAll(spark.createDataFrame([(1, 0, "user", "a.")], CONV)).select("*", *[F.lit(1).alias(c) for c in ("kind", "copy", "edit", "part", "seq", "long", "fault")])
    assert repair.summary(repair.repair(more)).count() == 1
