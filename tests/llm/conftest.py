import pytest

#: Nulls, empty texts, ties, repeated rows, a long text, columns with clashing names.
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "s", 1, "c", 0),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", None, None, None, None, None),
    (3, None, "en", "s", 1, "c", 0),
    (4, "", "de", "s", 0, "c", 0),
    (5, " \n\t ", "de", "s", 0, "c", 0),
    (6, "12345 !!! ???", "de", "s", 0, "c", 0),
    (7, LONG, "fr", "s", 0, "c", 0),
    (8, "word", "fr", "s", 0, "c", 0),
    (8, "word", "fr", "s", 0, "c", 0),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "s", 0, "c", 0),
    (9, "ä ñ é 漢字 \U0001f600 <|endoftext|>  two  spaces\r\nand\x1clines ", "es", "s", 0, "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, score int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every awkward kind, with columns that operators use as names of their own."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).cache()
