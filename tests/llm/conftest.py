import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, raw string, kept boolean"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash with ours."""
    long = "word " * 30_000 + "x" * 40_000 + " +1 (974) 555-3436 a@b.example.com "
    same = "one two three four five six seven eight nine ten " * 6
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, long, "en", "s", len(long)), (5, same, "en", "s", 1), (6, same, "de", "s", 1), (6, same, "de", "s", 1),
        (None, same, "en", "s", 1), (None, None, None, None, None), (7, "two words", "fr", "s", 9), (8, "Two  WORDS", "fr", "s", 9), (9, "no break é😀 'll 're", "xx", None, 5), (10, "<|endoftext|> a  b\n\n c", "en", "s", 3),
    ]
    return spark.createDataFrame([(*r, 99, "k", "r", False) for r in rows], DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
