import pytest

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta.", "a", 1), (1, "Alpha beta gamma delta epsilon zeta.", "a", 1),
    (2, None, "b", None), (None, "no id here", None, 3), (3, "", "", 0), (4, " \t\n ", "x", 4),
    (5, "word " * 3000, "x", 5), (6, "x" * 20000, "x", 6), (7, "Ünïcode – naïve 日本語　テスト 😀\r\nline", "y", 7),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string, n_words string, kept bigint")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
