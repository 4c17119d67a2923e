import random

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def documents(spark):
    """Documents from (doc_id, text[, lang]) rows."""

    def make(rows) -> DataFrame:
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture()
def odd(spark, documents):
    """Nulls, empty and blank texts, repeated rows, equal ids, and columns whose names clash."""
    from pyspark.sql import functions as F

    rows = [(1, "alpha beta gamma"), (2, None), (3, ""), (4, " \n\t "), (None, "alpha beta"), (None, None), (5, "x " * 30), (5, "x " * 30), (6, "one"), (6, "two")]
    clash = ["row", "key", "d", "r", "node", "size", "n_tokens", "ids", "h", "pos", "group", "spans", "rank", "score", "class_id", "letters", "__key", "start", "band", "first", "cuts", "kept"]
    return documents(rows).withColumns({c: F.lit("clash") for c in clash}), rows


@pytest.fixture()
def prose():
    """Random text of a few syllables per word."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        syllables = ["the", "an", "ing", "er", "on", "re", "wh", "tion", "é", "ou", "s"]
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make
