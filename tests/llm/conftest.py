import pytest
from pyspark.sql import Row

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with awkward names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, says the old man by the river.", "en", "x", 1),
        (1, "The quick brown fox jumps over the lazy dog, says the old man by the river.", "en", "x", 1),
        (2, None, None, None, None),
        (3, "", "de", "y", 0),
        (4, " \t\n\x0b\x0c\r ", "de", "y", 7),
        (5, LONG, "en", None, 150_000),
        (None, "a row without an id, but with words enough to be read as any other text is", "en", "z", 3),
        (7, "été 中文 \U0001f600 \x00\x1c end", None, "z", 4),
        (8, "x" * 40_000, "fr", "z", 5),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([Row(**dict(zip(names, r, strict=True))) for r in rows], kind)
    extra = {c: frame["source"] for c in ("id", "key", "n", "kept", "size", "row", "label", "at", "value", "spans", "__text")}
    return frame.withColumns(extra).withColumnRenamed("label", "a.b")
