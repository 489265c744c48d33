import pytest

import corpus_pipeline
from tests.llm import brute


def test_stages_compose(spark, sf, documents, tmp_path):
    docs = documents
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == documents.columns
        after = [r["doc_id"] for r in docs.collect()]
        if name == "exact_dedup":
            assert sorted(after) == sorted(i for i, (keep, _) in brute.dedup(before).items() if keep == i)
        if name == "ngram_jaccard_join":
            assert sorted(after) == sorted(i for i, (_, c) in brute.components(before).items() if c == i)
        if name == "mixing":
            assert set(after) <= {i for i, _ in before} and max(after.count(i) for i in set(after)) <= 2
        if name == "packing":
            assert set(after) == {i for i, _ in before}
        seen.append(name)
    assert seen == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


ODD = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "a text without an id, of some words", "en", None), (None, None, None, None), (3, "x" * 200_000, "en", "b"), (3, "another text under the same id, of some words", "en", "b"), (4, "\u0000 \n\t", "en", "a")]


@pytest.mark.parametrize("n", [0, 1, len(ODD)])
def test_stages_take_odd_rows(spark, sf, documents, n):
    """Nulls, empty and very long texts, repeated rows and ids, and tables without rows."""
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD[:n]], documents.schema)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf)
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after.collect())
        ids = {(r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()}
        assert set(got) <= ids
        if name in ("toxicity", "packing"):
            assert set(got) == ids
        if name == "exact_dedup":
            assert len(got) == (5 if n == len(ODD) else n)  # the five empty texts are one
        if name == "ngram_jaccard_join":
            assert got == sorted([*[g for g in got if g[0]], *{g for g in got if not g[0]}])  # one row an id
        if name != "packing":
            assert after.columns == documents.columns


def test_of_rows_that_share_an_id_the_longest_stays(spark, docs_of):
    from qanat.llm import jaccard_join

    near = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "one two three four five six"), (7, "one two three four five six seven"), (7, "short"), (8, near), (9, near + " more"), (None, near), (None, None), (10, "")]
    got = sorted((r["doc_id"] or 0, r["text"] or "-") for r in jaccard_join.kept_rows(docs_of(rows)).collect())
    assert got == sorted([(7, "one two three four five six seven"), (8, near), (0, near), (0, "-"), (10, "-")])


def test_only_what_the_last_stage_reads_is_left(spark, sf, tmp_path, monkeypatch):
    """A stage's rows are removed once the next stage is written, so no more than two copies of the texts lie there."""
    monkeypatch.setattr(corpus_pipeline, "ensure_checkpoint_dir", lambda s: s.sparkContext.setCheckpointDir(str(tmp_path)))
    keep = lambda spark, docs, sf: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), keep) for k in range(5)])
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [p.name for p in tmp_path.glob("*/pipeline-*/*")] == ["3"]
