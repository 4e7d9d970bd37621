import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """documents from (doc_id, text, source) with columns besides whose names clash with the operators' own."""

    def build(rows):
        df = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS)
        return df.withColumns({c: F.lit(c) for c in ("size", "n", "_row", "score", "ids", "label", "taken", "base", "line", "pos", "h1", "node", "kept")})

    return build


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two", None), (4, "one two", None), (None, "x y z x y z", "b"), (5, "é漢字 \x1c ok\n" * 3, "b"), (6, "word " * 30000, "c"), (7, "a" * 50000, "c")]


@pytest.fixture
def odd(make):
    """Nulls, empty and long texts, repeated rows, a null id, ties."""
    return make(ODD)


@pytest.fixture
def empty(make, odd):
    return odd.where("false")
