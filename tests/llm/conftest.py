import pytest

from ..conftest import data, duck, spark  # noqa: F401

LONG = " ".join(f"word{i % 977} x{i}" for i in range(30_000))

#: (doc_id, text): null, empty, blank, short, very long, repeated rows, ties, a null id, characters outside the common ones.
MESSY = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "Two words"), (5, LONG), (6, "one two three four five six seven"), (7, "one two three four five six seven"),
    (7, "one two three four five six seven"), (8, "ONE two\nthree four five six seven"), (None, "one two three four five six seven"), (9, "日本語 テスト 🎉 <|endoftext|> İx ǅ ﬁ"), (10, "a" * 5000),
    (11, "mail me: a.b@c.de, +1 (555) 123-4567 or 4111 1111 1111 1111 at 10.0.0.1"), (12, "\x00 nul \x1c and\xa0nbsp"),
]


@pytest.fixture(scope="session")
def messy(spark):  # noqa: F811
    """The messy rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2.0, True, "y") for i, t in MESSY]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n_words long, score double, kept boolean, _words string").repartition(3)


@pytest.fixture(scope="session")
def none(messy):
    return messy.where("doc_id < 0")


@pytest.fixture(scope="session")
def docs(spark, data):  # noqa: F811
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return {r.doc_id: r.text for r in docs.collect()}
