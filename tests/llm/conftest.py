"""Small tables with the awkward cases every text operator must stand: nulls, empties, long texts, ties, repeats, odd columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words long, size int, bands string, text_key string, `a b` int"
LONG = "word " * 60_000
COPY = "the quick brown fox jumps over the lazy dog near the old river bank while seven small boats drift slowly past the mill " * 4


def rows():
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", "b"), (5, COPY, "en", "b"), (6, COPY.upper(), "en", "b"),
        (7, COPY.replace("mill", "barn", 1), "en", None), (8, LONG, "en", "c"), (9, COPY, "en", "b"), (10, "mail me at a.b@c.org or +49 30 1234567", "de", "c"),
        (None, "no id but words enough to be a text of its own kind", "en", "a"), (11, "é" * 500, "fr", "ü"), (12, "x", "en", "a"), (12, "x", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 7, 1, "b", "k", 0) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
