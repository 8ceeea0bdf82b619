import pytest

TEXT = "The quick brown fox jumps over the lazy dog and runs away from it"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, copies, a repeated row, and columns with awkward names."""
    rows = [
        (1, TEXT, "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s1"), (None, "lost words without an id here", "en", None), (4, TEXT, "en", "s2"), (4, TEXT, "en", "s2"),
        (5, "word " * 40_000 + "x" * 3_000, "de", "s2"), (6, "12345 !!! ▁€", None, None), (7, None, None, None), (8, "one", "en", "s3"), (9, "  \n\n ", "en", "s3"),
        (10, TEXT.replace("lazy", "sleepy"), "en", "s3"), (11, "Der schnelle braune Fuchs springt\nÜber den faulen Hund \U0001f600", "de", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: "'x'" for c in ("id", "size", "hash", "bucket", "budget", "threshold", "full", "target", "words", "lines", "k1", "a", "b", "label", "part", "host", "chunk")}
    return df.selectExpr("*", *[f"{v} AS `{c}`" for c, v in extra.items()], "length(text) AS n_chars").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
