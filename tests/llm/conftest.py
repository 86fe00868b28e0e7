import pytest

LONG = "Der lange Text wiederholt sich nicht ganz. " * 3000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, None), (3, ""), (4, "   \n\n  x "),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today."), (6, LONG), (None, "no id here, but a text"),
    (7, "a<|endoftext|>b \0 é\u0301 ΟΔΟΣ 日本語 <|startoftext|> 'll 123"), (8, "one"), (9, "one"), (9, "one"), (10, LONG + "end"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names operators use themselves."""
    rows = [(i, t, "x", 1, 2.0, "k", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int, score double, kept string, bucket int").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
