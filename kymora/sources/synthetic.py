"""Posteriors with a stated accuracy and confidence, made from a burst table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.functions import hashing as H
from kymora.functions import vectors as V
from kymora.operators import series


def shuffled_index(df: DataFrame, keys: list[str], seed: int, tag: str, ident: str, name: str) -> DataFrame:
    """Position in a hashed order per key; buckets are hash prefixes, so they are even by construction."""
    digest = df.withColumn("_h", F.md5(H.key_text(seed, tag, F.col(ident))))
    return series.dense_index(digest, keys, ["_h"], F.substring("_h", 1, 4), name).drop("_h")


def synthetic_posteriors(
    bursts: DataFrame, seed: int, *, n_windows: int = 7, n_classes: int = 4, accuracy: float = 0.75, confidence: float = 0.7,
    window_s: float = 2.0, stride_s: float = 0.25, key: str = "subject",
) -> DataFrame:
    """``n_windows`` posteriors per burst; classes are dealt evenly over a shuffled order."""
    if not 0.0 <= accuracy <= 1.0:
        raise ValueError("accuracy must be in [0, 1]")
    dealt = shuffled_index(bursts.select(key, "burst_id"), [key], seed, "label", "burst_id", "_i")
    rows = dealt.select(
        key, "burst_id", (F.col("_i") % n_classes).cast("int").alias("label"),
        F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("w"),
    )
    right = H.u01(seed, "correct", F.col("burst_id"), F.col("w")) < accuracy
    other = F.floor(H.u01(seed, "other", F.col("burst_id"), F.col("w")) * (n_classes - 1)).cast("int")
    other = F.when(other >= F.col("label"), other + 1).otherwise(other)
    rest = (1.0 - confidence) / (n_classes - 1)
    rows = rows.withColumn("peak", F.when(right, F.col("label")).otherwise(other))
    p = F.array(*[F.when(F.col("peak") == k, confidence).otherwise(rest) for k in range(n_classes)])
    return rows.select(
        key, "burst_id", "label", "w", (F.lit(window_s) + F.col("w") * stride_s).alias("t_rel"), V.as_float(p).alias("posterior")
    )
