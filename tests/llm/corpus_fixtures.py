"""Odd tables that the tests of the corpus operators share."""

import pytest

#: Extra columns whose names clash with what the operators use inside.
EXTRA = "size long, h long, row long, _row string, _key string, _h string, node long, score double, vec string, bucket long, hits string"
DOC = f"doc_id long, text string, lang string, source string, {EXTRA}"


def doc(i, text, source="a"):
    return (i, text, "en", source, 1, 2, 3, "x", "y", "z", 4, 0.5, "v", 5, "w")


def words(n, seed=0):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 5003}" for k in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    long = words(60_000, 3)
    rows = [
        doc(1, words(80, 1)), doc(2, words(80, 1)), doc(3, words(80, 1) + " more"), doc(4, None), doc(5, ""), doc(6, " \t\n\x0b\x0c\r "),
        doc(7, "one two"), doc(8, "one two"), doc(9, "ONE two   three İ K end"), doc(10, long, "b"), doc(11, words(30, 5) + " " + long[5000:90_000], None),
        doc(12, words(25, 9) + "\n" + words(25, 9), "b"), doc(13, "a a a a a a a a", "c"), doc(14, words(300, 2), None), doc(14, words(300, 2), None),
        doc(15, words(300, 2), "d"), (None, words(80, 1), None, None, None, None, None, None, None, None, None, None, None, None, None), (None,) * 15,
    ]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
