"""Train/test splits, folds, holdouts and scaling fitted on train rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.functions import naming as N
from kymora.operators.keyed import with_model
from kymora.sources.synthetic import shuffled_index


def split_problems(trials: DataFrame, subject: str = "subject") -> DataFrame:
    """Subjects that lack a session or carry an unknown one."""
    s = F.col("session")
    per = trials.groupBy(subject).agg(
        F.count(F.when(s == N.TRAIN_SESSION, 1)).alias("n_train"),
        F.count(F.when(s == N.TEST_SESSION, 1)).alias("n_test"),
        F.count(F.when(~s.isin(N.TRAIN_SESSION, N.TEST_SESSION) | s.isNull(), 1)).alias("n_unknown"),
    )
    return per.where((F.col("n_train") == 0) | (F.col("n_test") == 0) | (F.col("n_unknown") > 0))


def train_test(trials: DataFrame, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of the train session and of the test session.

    With ``check`` a table with rows of any other session is refused.
    """
    if check:
        other = trials.where(F.col("session").isNull() | ~F.col("session").isin(N.TRAIN_SESSION, N.TEST_SESSION))
        bad = other.select("session").distinct().limit(5).collect()
        if bad:
            raise ValueError(f"unknown sessions {sorted(str(r[0]) for r in bad)}")
    return trials.where(F.col("session") == N.TRAIN_SESSION), trials.where(F.col("session") == N.TEST_SESSION)


def smallest_class(rows: DataFrame, keys: Sequence[str], label: str = "class") -> DataFrame:
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min("_n").alias("smallest_class"))


def inner_folds(trials: DataFrame, n_folds: int, seed: int, subject: str = "subject", label: str = "class") -> DataFrame:
    """Stratified folds over the train session only.

    Rows of a (subject, class) are dealt in a hashed order; the folds of a
    subject whose smallest class is below ``n_folds`` are null.
    """
    if n_folds < 2:
        raise ValueError("n_folds must be at least 2")
    train, _ = train_test(trials)
    dealt = shuffled_index(train, [subject, label], seed, "fold", "trial_id", "_i")
    enough = smallest_class(train, [subject], label)
    return dealt.join(enough, subject).withColumn(
        "fold", F.when(F.col("smallest_class") >= n_folds, F.col("_i") % n_folds).cast("int")
    ).drop("_i", "smallest_class")


def holdout(rows: DataFrame, fraction: float, seed: int, keys: Sequence[str], label: str = "class", ident: str = "trial_id") -> DataFrame:
    """Mark a stratified share of every class for validation."""
    dealt = shuffled_index(rows, [*keys, label], seed, "holdout", ident, "_i")
    sizes = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return dealt.join(sizes, [*keys, label]).withColumn("validation", F.col("_i") < F.bround(F.col("_n") * fraction)).drop("_i", "_n")


def fit_scaling(train: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, m_<feature>, s_<feature>): mean and spread of each feature per key."""
    stats = []
    for f in features:
        stats += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    return train.groupBy(*keys).agg(*stats)


def apply_scaling(rows: DataFrame, fitted: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Features scaled by their key's fit, and ``scaling_status``: ``ok``, or ``no train rows`` with null features."""
    model = fitted.select(*keys, F.struct(*[c for c in fitted.columns if c not in keys]).alias("_fit"))
    out = with_model(rows, model, keys)
    scaled = {}
    for f in features:
        sd = F.when(F.col(f"_fit.s_{f}") > 0, F.col(f"_fit.s_{f}")).otherwise(1.0)
        scaled[f] = (F.col(f) - F.col(f"_fit.m_{f}")) / sd
    return out.withColumns(scaled).withColumn("scaling_status", F.when(F.col("_fit").isNull(), "no train rows").otherwise("ok")).drop("_fit")


def standardise_on_train(rows: DataFrame, features: Sequence[str], is_train: Column, keys: Sequence[str]) -> DataFrame:
    """Scale features with the mean and spread of the train rows only; every row stays, a null key is a key."""
    return apply_scaling(rows, fit_scaling(rows.where(is_train), features, keys), features, keys)
