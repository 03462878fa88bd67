import pytest

LONG = "word " * 30_000 + "end"
CLASH = "sig string, n long, block long, epoch int, keep_id long, _row string, tokens long, component string, quality string, _id string, host string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def row(doc, text, source="s"):
    return (doc, text, "en", source, len(text or ""), "x", 1, 2, 3, 4, "r", 5, "c", "q", "i", "h")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [row(1, "a b c d e f g"), row(2, "a b c d e f g"), row(2, "a b c d e f g"), row(3, None), row(4, ""), row(5, " \n\t"), row(6, LONG, "t"), row(7, LONG, None), row(8, "x"), row(9, "x y", "u")]
    rows += [(None,) * 16, (10, None, None, None, None, *(None,) * 11), row(None, "a b c d e f g"), row(11, "Ünïcödé 中文 😀 text\x00\x1c here", "u")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
