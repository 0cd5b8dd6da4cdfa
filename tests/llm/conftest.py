from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and wordless texts, ties and repeated rows, one long text.
ODD = [
    (0, "The quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog " * 12, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (5, "word", "fr", None, 4),
    (6, "Größe ünïcode 中文 \x1c text here <|endoftext|> ###", "de", "b", 9),
    (7, " ".join(f"w{i % 977}" for i in range(20_000)), "en", "c", 5),
    (None, "no id here at all", "en", "c", 5),
    (8, "one two three one two three\nsame line\nsame line\n\n", "en", "c", 5),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("score", "ids", "fp", "kept", "_text", "size", "key", "n", "copies", "h")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
