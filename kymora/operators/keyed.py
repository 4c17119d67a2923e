"""Models per key as tables: joins in which a null is a key like any other, and keys without a model keep their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "_key"


def key_column(keys: Sequence[str]) -> Column:
    """All keys as one text, never null; without keys every row has the same."""
    return F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")


def with_model(rows: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their key's model, nulls where there is none.

    Models are small beside the rows, so the planner broadcasts them where their files
    allow it; else adaptive execution splits a key that holds many rows.
    """
    own = model.withColumn(KEY, key_column(keys)).drop(*keys)
    return rows.withColumn(KEY, key_column(keys)).join(own, KEY, "left").drop(KEY)
