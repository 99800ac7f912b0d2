import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents with the awkward rows that every operator must take."""

    def docs(rows):
        full = [(*r, *(None, None, None))[:5] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
    rows = [(1, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (2, None, None, None), (None, "x y z", "de", "t"), (3, "", "fr", None), (4, "   \n\t", "es", "s"), (5, long, "en", "t"), (6, "a b c d e", "en", "u")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 7, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, n int, queue double")
