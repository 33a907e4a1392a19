import pytest

LONG = "word " * 20_000 + "x" * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows, and columns of clashing names."""
    rows = [
        (1, None, "en", "s", None, "a", 1.0),
        (2, "", "en", None, 0, "b", 1.0),
        (3, " \n\t ", None, "s", 4, None, 2.0),
        (None, "text without an id, but words enough to be read.", "de", "s", 1, "c", None),
        (5, LONG, "en", "s", 1, "d", 3.0),
        (6, "same text here\nand a second line.", "fr", "t", 1, "e", 3.0),
        (6, "same text here\nand a second line.", "fr", "t", 1, "e", 3.0),
        (7, "Same TEXT here\nand a second line.", "fr", "t", 1, "f", 3.0),
        (8, "one", "xx", "t", 3, "g", 3.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double").withColumnsRenamed({})


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 0, None), (None, 1, 1), (5, None, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
