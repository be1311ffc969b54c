import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and extra columns whose names clash."""
    long = " ".join(f"w{i % 977} the" for i in range(6000))
    rows = [
        (1, "The cat sat on the mat. The dog ran.", "en", "a", 36),
        (2, "The cat sat on the mat. The dog ran.", "en", "a", 36),
        (2, "The cat sat on the mat. The dog ran.", "en", "a", 36),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "de", "b", 6),
        (6, long, "en", "c", len(long)),
        (7, "Zażółć gęślą jaźń 漢字 😀 x\x00y", "pl", "c", 20),
        (None, "a row without an id", "en", None, 19),
        (None, None, None, None, None),
        (8, "x" * 5000, None, "d", 5000),
        (9, "12345 !!!", "fr", "d", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "score", "key", "fp", "root", "held", "n", "ids", "a", "kind", "block", "w", "row"):
        df = df.withColumn(name, df.n_chars)
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
