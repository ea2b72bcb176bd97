import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, slot long, id long, key string, b string, a long"


def rows(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", len(t or ""), "x", 7, 8, "k", "b", 9) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def table(spark):
    """Documents of texts, with columns whose names clash with those the operators use."""
    return lambda texts, start=0: spark.createDataFrame(rows(texts, start), SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, a null id, a null source."""
    long = "the quick brown fox " * 12000
    base = rows(["", None, " \n", "Word", "word", long, "a b c d e f g h", "a b c d e f g h", "naïve ÜBER straße 中文 \U0001f600"])
    extra = [base[6], base[3], (None, "lost row without an id", None, None, None, None, None, None, None, None, None), (None, "Word", "en", None, 4, "x", 7, 8, "k", "b", 9)]
    return spark.createDataFrame(base + extra, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
