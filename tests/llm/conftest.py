import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def data():
    return DATA


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def run(rows):
        return spark.createDataFrame(
            [(i, t, 7, "x", 1, None) for i, t in rows], "doc_id long, text string, row_id int, body string, doc int, digest string")

    return run


#: Nulls, empty and blank texts, ties, repeated rows and a long text.
EDGE = [
    (None, None), (None, "a b c d"), (1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "One two three four five six"),
    (7, "One two three four five six"), (8, "über straße ﬁ \U0001f600   x"), (9, "word " * 30_000), (10, "word " * 30_000), (11, "a\x00b"),
]


@pytest.fixture
def edge():
    return EDGE
