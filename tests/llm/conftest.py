import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, in two partitions."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(2)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
