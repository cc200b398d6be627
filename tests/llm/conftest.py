import pytest

TEXT = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, TEXT * 4, "en", "a"), (2, TEXT * 4, "en", "b"), (2, TEXT * 4, "en", "b"), (3, None, None, None), (4, "", "en", "c"), (5, "   \n\t", "en", "c"), (6, long_text, "en", "d"), (7, "word", "en", "e"), (8, "Word", "en", "e"),
        (None, "a text whose id is null and which has more than ten words in all of it", "en", "f"), (9, "日本語 " * 80, "ja", "g"), (10, "x" * 200_000, "en", "h"), (11, "x" * 199, "en", "h"), (12, "\x00\x01 " * 90 + "▁ \U0001f600", "en", "i"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, body string").selectExpr("doc_id", "text", "lang", "body", "1 AS id", "'k' AS key", "2 AS node", "3L AS text_hash", "'l' AS ledger", "'s' AS spans", "4 AS n", "'x' AS words", "'u' AS url_filter", "9 AS label")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
