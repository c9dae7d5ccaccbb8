import pytest

LOREM = (
    "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of amber and jade near the old stone bridge "
    "and nobody in the village ever asked why the lanterns burned so late on winter evenings or who paid for the oil"
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, LOREM, "en", "a", 7), (2, LOREM, "en", "a", 7), (2, LOREM, "en", "a", 7), (3, LOREM.replace("fox", "cat"), "en", None, None), (4, "", "en", "a", 0), (5, None, None, None, None), (None, LOREM + " end", "en", "a", 1),
        (6, "  \n\t ", None, "a", 4), (7, "word " * 30_000, "en", "b", 1), (8, "ÄÖÜ straßé 你好 👍🏽", "de", "b", 1), (9, "%%% 123 !!!", "fr", "b", 1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS h", "2 AS fp", "'x' AS id", "3 AS pos", "4 AS word", "5 AS t", "6 AS score", "7 AS n_lines")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id > 1000000")
