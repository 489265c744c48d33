import random

import pytest
from pyspark.sql import functions as F

from qanat.operators import chunk, evaluate, extract

LAYOUT = """Chapter I
1. Scope
Article 1    مادة ١
The first rule.     القاعدة الأولى
2. A numbered line inside the body that goes on and ends with a stop.
As Article 40 says, this stays here.
Articles 3-5 have been repealed.
\fPage 2 of 2
Article 2    مادة ٢
It follows.
Article 6    مادة ٦
Last text.
"""


def test_articles_from_layout_text(spark):
    rows = {r["article_number"]: r for r in extract.articles(spark.createDataFrame([(1, LAYOUT)], "doc_id long, text string")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert rows[1]["chapter"] == "Chapter I" and rows[1]["topic"] == "Scope" and rows[1]["text_ar"] == "القاعدة الاولى"
    assert rows[1]["text_en"] == "The first rule. 2. A numbered line inside the body that goes on and ends with a stop. As Article 40 says, this stays here."
    assert rows[2]["text_en"] == "It follows." and rows[2]["source_page"] == 2 and rows[2]["source_status"] == "missing_arabic_text_in_source_pdf"
    for n in (3, 4, 5):
        assert rows[n]["is_repealed"] and rows[n]["source_status"] == "repealed_no_individual_body_in_source" and rows[n]["repeal_note_en"] == "Articles 3-5 have been repealed."
    assert rows[6]["text_en"] == "Last text." and not rows[6]["is_repealed"] and rows[6]["citation"] == "Civil Code, Article 6"


def test_running_headers(spark):
    text = "\f".join(f"Law Book\nline {i} of text\nmore text {i}\neven more {i}\nlast {i}" for i in range(12))
    lines = extract.physical_lines(extract.pages(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [(r["key"], r["pages"]) for r in extract.running_headers(lines).collect()] == [("Law Book |", 12)]
    assert extract.content_lines(lines).filter("en = 'Law Book'").count() == 0 and extract.content_lines(lines).count() == 48


def test_blank_pages_count(spark):
    pages = extract.pages(spark.createDataFrame([(1, "a\f \fb")], "doc_id long, text string"))
    assert [(r["page"], r["text"]) for r in pages.collect()] == [(1, "a"), (3, "b")]


@pytest.mark.parametrize("bad", [{"strategy": "x"}, {"context_header": "x"}, {"max_tokens": 40}, {"overlap_tokens": 300}])
def test_config(bad):
    with pytest.raises(ValueError):
        chunk.ChunkConfig(**bad)


def articles(spark):
    long = " ".join(f"Sentence number {i} holds a few words, as it should; no more." for i in range(60))
    rows = [(1, "مادة", long, False, None), (2, "", "Short text.", False, None), (3, "", "", True, "Gone in 1950."), (4, "", "", False, None)]
    return spark.createDataFrame(rows, "article_number int, text_ar string, text_en string, is_repealed boolean, repeal_note_en string")


@pytest.mark.parametrize("cfg", [chunk.ChunkConfig(max_tokens=128), chunk.ChunkConfig(max_tokens=128, balanced=False), chunk.ChunkConfig(strategy="window", max_tokens=96), chunk.ChunkConfig(max_tokens=96, overlap_tokens=30)])
def test_chunks_rebuild_their_text(spark, cfg):
    rows = articles(spark)
    got = chunk.chunk_articles(rows, cfg)
    assert chunk.chunk_problems(got, rows, cfg).collect() == []
    by = {r["chunk_id"]: r for r in got.collect()}
    assert by["art0002-en-00"]["chunk_type"] == "article" and by["art0002-en-00"]["embed_text"] == "Civil Code, Article 2\nShort text."
    assert by["art0003-en-00"]["text"].endswith("no longer in force. Source note: Gone in 1950.") and by["art0003-ar-00"]["chunk_type"] == "repealed_notice"
    assert not any(i.startswith("art0004") for i in by) and max(r["token_count"] for r in by.values()) <= cfg.max_tokens
    assert by["art0001-ar-00"]["metadata"]["source_page"] == -1 and by["art0001-en-00"]["n_chunks"] > 1
    stats = chunk.chunk_stats(got).head()
    assert stats["total_chunks"] == len(by) and stats["chunk_type_repealed_notice"] == 2 and stats["articles_split"] == 1


FAULTY = """Preface words
Article 1   مادة ٢
Body.
3. A numbered line
goes on here and on.
Article 9
more.
Article 2   مادة ٢
x."""


def test_what_a_faulty_book_leaves_in_doubt(spark):
    texts = spark.createDataFrame([(1, FAULTY), (2, LAYOUT)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in extract.diagnostics(texts).filter("doc_id = 1").orderBy("seq").collect()]
    assert got == [
        ("uncertain_line", 1, 1, None, None, "Preface words"), ("number_mismatch", 1, 2, 1, 2, "Article 1"),
        ("rejected_heading", 1, 4, None, None, "3. A numbered line"), ("rejected_anchor", 1, 6, 9, 2, "Article 9"),
    ]
    assert [r["text_en"] for r in extract.articles(texts).filter("doc_id = 1").orderBy("article_number").collect()] == ["Body. 3. A numbered line goes on here and on. Article 9 more.", "x."]
    assert extract.diagnostics(texts.limit(0)).collect() == []


def test_corpus_checks_and_verdict(spark):
    fine = "نص."
    rows = [(1, "A.", fine, "normal", False), (2, "", "", evaluate.NO_BODY, True), (3, None, fine, None, False), (5, "B. 7. Heading", "نص. ٣- عنوان", "normal", False), (5, "C.”", fine, "normal", False), (9, "x" * 20, fine, "normal", True)]
    corpus = spark.createDataFrame(rows, "article_number int, text_en string, text_ar string, source_status string, is_repealed boolean").withColumns({"text_ar_raw": F.col("text_ar"), **{c: F.lit(None).cast("string") for c in ("book", "chapter", "section", "topic")}})
    declared = spark.createDataFrame([(2, 3), (9, 9)], "low int, high int")
    found = evaluate.corpus_validation(corpus, most=19, expected=6, repealed=declared)
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        ("duplicate", 5), ("gap_after", 3), ("gap_after", 5), ("empty_en", 3), ("huge", 9), ("unterminated", 5), ("unterminated", 9), ("trailing_heading", 5), ("trailing_heading_ar", 5),
        ("missing", 4), ("missing", 6), ("outside", 9), ("missing_repealed", 3),
    ])
    assert tuple(evaluate.corpus_verdict(found).head()) == (8, 5, False) and evaluate.corpus_verdict(found.filter("`check` = 'empty_en'")).head()["ok"]
    profile = {(r["kind"], r["name"]): r["n"] for r in evaluate.corpus_profile(corpus).collect()}
    assert profile[("total", "records")] == 6 and profile[("total", "numbers")] == 5 and profile[("without", "topic")] == 6 and profile[("status", "unknown")] == 1


def plain_chunks(pieces, limit, overlap, count, tail):
    """Pieces one after the other, each counted anew."""
    out, own = [], []
    for p in pieces:
        if own and count(" ".join([*own, p])) > limit:
            out.append(own)
            held = []
            while overlap and len(held) < len(own) and count(" ".join(own[len(own) - len(held) - 1 :])) <= overlap:
                held = own[len(own) - len(held) - 1 :]
            while held and count(" ".join([*held, p])) > limit:
                held = held[1:]
            own = held
        own = [*own, p]
    out.append(own)
    if len(out) > 1 and not overlap and count(" ".join(out[-1])) < tail and count(" ".join(out[-2] + out[-1])) <= limit:
        out[-2:] = [out[-2] + out[-1]]
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("count", [chunk.estimate, lambda t: len(t.split())])
def test_runs_of_pieces_against_plain_filling(count):
    rnd = random.Random(1)
    for _ in range(300):
        pieces = [" ".join(rnd.choice(("a", "bb", "مادة" if rnd.random() < 0.1 else "c")) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 40))]
        limit, overlap = rnd.randint(20, 60), rnd.choice((0, 0, 5, 9))
        own = chunk.Pieces(pieces, count)
        assert [own.text(*r) for r in own.runs(limit, overlap, 12)] == plain_chunks(pieces, limit, overlap, count, 12)


def test_small_tail_is_merged():
    own = lambda pieces, limit: [chunk.Pieces(pieces, chunk.estimate).text(*r) for r in chunk.Pieces(pieces, chunk.estimate).runs(limit, 0, 24)]
    assert own([f"w{i}" for i in range(60)], 70) == [" ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(50, 60))]
    assert own(["a " * 30, "b"], 60) == ["a " * 30 + " b"]


def test_lines_are_cut_once(spark):
    """What reads content lines finds them written, and does not cut the texts again."""
    texts = spark.createDataFrame([(1, "Book I. Of all\nArticle 1\nA rule.\n\fArticle 2\nMore.")], "doc_id long, text string")
    found = extract.content_lines(extract.physical_lines(extract.pages(texts)))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5


def test_a_book_of_one_document_is_as_its_sql_says(spark, tmp_path):
    """The last of 21 documents is a book of its own; its only article is repealed like the first of every book."""
    import duckdb

    from qanat.plans import registry

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"Text {i} of a document.\nIt ends.") for i in range(21)], "doc_id long, text string").write.parquet(path)
    got = registry.QUERIES["extract_articles"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL['extract_articles']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name", ["extract_articles", "extraction_diagnostics"])
def test_extraction_exchanges_texts_once(spark, sf, name):
    """Books are exchanged as they are put together; no step after that exchanges or writes their lines."""
    from qanat.plans import registry

    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan and "SortMergeJoin" not in plan
    assert [f for f in plan.split() if f.startswith("file:") and not f.startswith(f"file:{sf}")] == []


def test_gathered_articles_of_decomposed_and_marked_text(spark):
    """Bidi marks, composed letters, wide blanks and tabs, at once and by text that is unmarked before."""
    from qanat.functions.text import unmarked

    text = "Article 1  مادة ١\ncafé ‎one\ttwo   نص\nArticle 2\na b   c"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for texts, done in ((rows, False), (rows.withColumn("text", unmarked(F.col("text"))), True)):
        got = {r["article_number"]: (r["text_en"], r["text_ar"]) for r in extract.articles(texts, unmarked=done).collect()}
        assert got == {1: ("café one two", "نص"), 2: ("a b c", "")}
