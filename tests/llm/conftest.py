import pytest


@pytest.fixture(scope="session")
def frame(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs."""

    def build(pairs, lang="en", source="s"):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return build
