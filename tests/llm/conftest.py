import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp long, position string, text_crc32 string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null in every column, empty and long texts, repeated rows, ties, and extra columns with names the operators use."""
    long_text = " ".join(f"word{i % 97}" for i in range(40_000))
    rows = [
        (1, "alpha beta gamma delta", "en", "a"), (1, "alpha beta gamma delta", "en", "a"), (2, "alpha beta gamma delta", "en", "b"),
        (3, None, "en", "a"), (4, "", "de", None), (None, "alpha beta gamma delta", None, "a"), (None, None, None, None), (5, long_text, "fr", "b"),
        (6, long_text + " x", "fr", "b"), (7, "   \t\n ", "en", ""), (8, "y" * 30_000, "en", "c"), (9, "one", "en", "c"), (10, 'token = "abcdefghijkl" \U0001f600 é', "en", "c"),
    ]
    full = [(i, t, g, s, None if t is None else len(t), "x", 7, "p", "q") for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
