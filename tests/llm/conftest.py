import pytest

LONG = " ".join(f"wort{i % 977}x{i % 13}" for i in range(30_000))
CLASHING = ("digest", "doc", "key_id", "copies", "name", "n", "cls", "token", "lang_pred", "score", "found", "w", "anchor", "row", "gone_id", "base")
ROWS = [
    (1, "the cat sat on the mat and then it slept there all day long", "en", "a"),
    (2, "the cat sat on the mat and then it slept there all day long", "en", None),
    (3, None, None, "a"),
    (4, "", "en", "b"),
    (5, " \t\n ", None, "b"),
    (6, LONG, "de", "a"),
    (None, "a row without an id but with some words in it", "en", "c"),
    (None, None, None, None),
    (7, "repeated row text here", "en", "b"),
    (7, "repeated row text here", "en", "b"),
    (8, "... !!! 123", None, "c"),
    (9, "Größe und Maß \U0001F600 zählen", "de", "c"),
]


def frame(spark, rows, clash=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if not clash:
        return docs
    return docs.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(CLASHING)])


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    return frame(spark, ROWS)


@pytest.fixture
def empty(spark):
    return frame(spark, [])
