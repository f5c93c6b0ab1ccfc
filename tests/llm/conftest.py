import pytest

#: A long text of its own words, whose lines and windows repeat in part.
LONG = "\n".join(" ".join(f"w{(i * 7 + j * j) % 1900}" for j in range(60)) for i in range(300))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    base = "The quick brown fox jumps over the lazy dog near the river bank every day. " * 6
    rows = [
        (1, base, "en", "s1", 1), (2, base, "en", "s1", 1), (2, base, "en", "s1", 1), (3, base + "Now.", "en", "s2", 1),
        (4, None, "en", "s1", None), (5, "", "de", "s1", 0), (6, "  \n\t ", "de", None, 4), (None, "ohne Namen und Zahl", "de", "s1", 3),
        (7, LONG, None, "s9", 9), (8, "Größe – naïve ☃ 𝄞 ok\n\nzwei", "de", "s2", 5), (9, "a b", "fr", "s2", 3), (10, "12345 67 !!", "fr", "s2", 3),
        (11, "ÉTÉ " * 80, "fr", "s2", 3), (12, base.replace("fox", "cat"), "en", "s3", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' as id", "'y' as words", "'z' as fp", "1 as score", "'h' as host", "'k' as text_key", "2 as n_tokens", "'t' as t")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)
