import pytest

DOCS = "doc_id long, text string, lang string, key string, n long, component string, row string"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from `(doc_id, text)`, with columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "k", 7, "c", "r") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def given(spark):
    """A given table of the smallest data."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


LONG = "lorem ipsum dolor sit amet, " * 20_000
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "Same words in both rows here today"),
         (6, "Same words in both rows here today"), (7, LONG)]


@pytest.fixture(scope="session")
def edges(docs):
    """NULL, empty, blank, short, repeated and very long texts."""
    return docs(EDGES)
