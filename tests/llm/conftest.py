import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names the operators use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, "en", "b", None),
        (3, "", None, None, 0),
        (4, "   \t\n ", "fr", "b", 6),
        (5, "le renard brun saute " * 20000, "fr", "a", None),
        (6, "123 456 !!", "en", None, 10),
        (7, "x", None, "c", 1),
        (None, "no id here at all", "en", "a", None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("score", "fp", "size", "sid", "bin", "start", "component_id", "predicted", "n_words", "host", "__text", "path", "key"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
