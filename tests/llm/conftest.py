"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, copies long, row long"


def words(n: int, seed: int = 0) -> str:
    """n different made-up words."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 1000003:x}q" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Columns ``size``, ``copies`` and ``row`` clash with names that operators use."""
    rows = [
        (1, words(120, 1), "en", "a", 1, 1, 1, 1),
        (2, words(120, 1), "en", "a", 1, 1, 1, 1),
        (2, words(120, 1), "en", "a", 1, 1, 1, 1),
        (3, None, "en", "b", None, None, None, None),
        (4, "", None, "b", 0, None, None, None),
        (None, words(80, 2), "de", None, 1, 1, 1, 1),
        (5, " \t\n\x0b\x0c\r", "de", None, 1, 1, 1, 1),
        (6, words(30000, 3), None, "c", 1, 1, 1, 1),
        (7, "x" * 50000, "en", "c", 1, 1, 1, 1),
        (8, "café \U0001f600 naïve 中文 " * 40, "fr", "c", 1, 1, 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
