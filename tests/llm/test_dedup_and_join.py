import random

import numpy as np
import pytest

from qanat.llm import exact_dedup, jaccard_join
from qanat.llm.components import components
from tests.llm import brute


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_exact_dedup_on_table(documents):
    want = brute.dedup(rows_of(documents))
    for k in (1, 256):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(documents, k).collect()}
        assert got == want


def test_exact_dedup_cases(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a  b"), (9, "x"), (9, "x"), (None, "y"), (8, "y")])
    got = exact_dedup.exact_dedup(docs).collect()
    keep = {r["doc_id"]: r["keep_id"] for r in got}
    assert (keep[1], keep[4], keep[5], keep[7], keep[8]) == (3, 6, 6, 6, 8)
    assert sum(r["kept"] for r in got) == 4 and len(got) == 11
    stay = exact_dedup.kept_rows(docs)
    assert sorted(r["doc_id"] for r in stay.collect()) == [3, 6, 8, 9] and stay.columns == docs.columns


@pytest.mark.parametrize("gone", [1_000_000, 0])
def test_rows_that_go_are_named_or_joined(docs_of, monkeypatch, gone):
    monkeypatch.setattr(exact_dedup, "GONE", gone)
    rows = [(1, "a b"), (1, "ab"), (1, "a b"), (2, "a b"), (2, "other"), (3, None), (3, None), (None, "a b"), (None, "x"), (None, "x"), (5, "é" * 100_000), (5, "é " * 100_000)]
    stay = exact_dedup.kept_rows(docs_of(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in stay), key=str) == sorted([(1, "a b"), (2, "other"), (3, None), (None, "x"), (5, "é " * 100_000)], key=str)


def test_exact_dedup_empty_and_more_columns(docs_of, spark):
    docs = docs_of([(1, "a"), (2, "a")]).withColumnRenamed("lang", "digest").withColumnRenamed("source", "key")
    assert [r["doc_id"] for r in exact_dedup.kept_rows(docs).collect()] == [1]
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 and exact_dedup.kept_rows(docs.limit(0)).count() == 0


def test_misra_gries_finds_all_frequent(spark):
    values = [bytes([i % 7]) for i in range(700)] + [bytes([100 + i % 100]) for i in range(200)]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(3)
    found = {bytes(r["digest"]) for r in exact_dedup.misra_gries(rows, 20).collect()}
    assert {bytes([i]) for i in range(7)} <= found


def near_copies(n, seed):
    """Groups of texts that differ in a few words, and texts that share a long passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    out = []
    for g in range(n):
        base = [word() for _ in range(rnd.choice((3, 5, 12, 60, 150)))]
        if g % 3 == 0:
            base += passage
        for _ in range(rnd.choice((1, 2, 9))):
            own = list(base)
            for _ in range(rnd.choice((0, 1, 2))):
                own[rnd.randrange(len(own))] = word()
            out.append(" ".join(own))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("large", [2000, 3])
def test_jaccard_join_against_brute_force(docs_of, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "SIDE", 2000 if large == 2000 else 4)
    rows = near_copies(40, large)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute.components(rows)


def test_jaccard_join_with_few_known_counts(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "KNOWN", 8)
    rows = near_copies(25, 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute.components(rows)


def test_jaccard_join_over_many_buckets(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SPREAD", 40)
    monkeypatch.setattr(jaccard_join, "GATHER", 100)
    rows = near_copies(25, 6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute.components(rows)


@pytest.mark.parametrize(("own", "shared"), [(30, 30), (6, 40)])
def test_one_passage_in_many_unlike_documents(docs_of, own, shared):
    passage = " ".join(f"p{i}" for i in range(shared))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{j}" for j in range(own))) for i in range(10_000)]
    rows += [(20_000 + i, rows[i][1].replace(f"w{i}x{own - 1}", "y")) for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == {**{i: i for i in range(10_000)}, **{20_000 + i: i for i in range(50)}}  # the near copy's last word is in one shingle


def test_copies_over_many_tasks_keep_their_links(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SPREAD", 300)
    monkeypatch.setattr(jaccard_join, "GATHER", 200)
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:-1], f"x{k}"]) for k in range(6)]
    rows = [(i, near[i % 6]) for i in range(120)] + near_copies(10, 9)[:30] + [(1000 + i, f"{near[0]} " + " ".join(f"z{i}y{j}" for j in range(60))) for i in range(40)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(rows).repartition(7)).collect()}
    assert got == brute.components(rows)


@pytest.mark.parametrize("size", [60, 400])
def test_blocks_of_many_ngrams_are_cut(docs_of, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "BIN", size)
    rows = near_copies(12, size)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute.components(rows)


def test_jaccard_join_cases(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "x")
    docs = docs_of([(5, text), (3, near), (4, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  b"), (None, text), (5, text), (10, "solo words here")]).withColumnRenamed("lang", "id").withColumnRenamed("source", "digest")
    got = {}
    for r in jaccard_join.jaccard_components(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[5] == [(56, 3)] * 2 and got[3] == [(56, 3)] and got[None] == [(56, None)]
    assert got[4] == [(0, 4)] and got[6] == [(0, 6)] and got[7] == [(0, 7)]
    assert got[8] == [(1, 8)] and got[9] == [(1, 8)] and got[10] == [(1, 10)]
    assert sorted((r["doc_id"] for r in jaccard_join.kept_rows(docs).collect()), key=str) == [10, 3, 4, 6, 7, 8, None]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_very_long_words_are_told_apart(docs_of):
    word = "a"
    for _ in range(12):  # Thue and Morse: a word and its complement have one hash under any polynomial over 64 bits
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(k, word[: 1 << n].translate(t)) for k, (n, t) in enumerate((n, t) for n in (3, 6, 7, 10, 12) for t in ({}, str.maketrans("ab", "ba")))]
    rows += [(100, "x y z"), (101, "x y z " + word), (102, "X y Z")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of(rows)).collect()}
    assert got == brute.components(rows)


def test_rows_that_share_an_id(docs_of):
    a, b = (" ".join(f"{c}{i}" for i in range(9)) for c in "ab")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs_of([(4, a), (4, b), (2, b), (9, a)])).collect()}
    assert got == {(4, 2), (2, 2), (9, 2)}


@pytest.mark.parametrize("large", [2000, 2])
def test_texts_that_share_their_smallest_id(docs_of, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    words = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    a, b, c = (" ".join(w) for w in words)
    near = lambda w, x: " ".join([*w[:-1], x])
    rows = [(4, a), (4, b), (4, c), (9, near(words[1], "x")), (3, near(words[2], "y")), (8, near(words[0], "z")), (12, "a text of its own, apart from all")]
    for order in (rows, rows[::-1]):
        docs = docs_of(order)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
        assert got == {(4, 3), (9, 3), (3, 3), (8, 3), (12, 12)}
    assert sorted(r["doc_id"] for r in jaccard_join.kept_rows(docs).collect()) == [3, 12]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**dict.fromkeys(range(61), 0), 90: 90, 95: 90, 100: 90}


def test_sets_are_exchanged_once(spark, monkeypatch):
    """Sets of small blocks learn their block by a broadcast and are exchanged by bin only, not once more to meet their block."""
    plans = []
    joined = jaccard_join.joined
    monkeypatch.setattr(jaccard_join, "joined", lambda rows, by, percent: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or joined(rows, by, percent))
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base[:55], f"x{i}", *base[56:]])) for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 1, 80).collect()}
    assert got == {i: 0 for i in range(5)} and len(plans) == 1
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0] and "Exchange hashpartitioning" not in plans[0]


def test_counts_by_upper_halves_keep_the_order_whole():
    """N-grams that share an upper half are counted together; each of them finds that count."""
    x = np.array([(7 << 32) + 1, (7 << 32) + 2, (9 << 32) + 1], np.uint64)
    assert jaccard_join.upper(x).tolist() == [7, 7, 9] and jaccard_join.upper(x).dtype == np.uint32
