"""Checks and translations on recordings as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.functions import naming as N


def verify(trials: DataFrame, expected: DataFrame, runs: int, count: int) -> DataFrame:
    """Runs and trials per (subject, session) against what was expected, with the problems found.

    ``expected`` lists the (subject, session) pairs that must exist.
    """
    seen = trials.groupBy("subject", "session").agg(
        F.countDistinct("run").alias("n_runs"), F.count(F.lit(1)).alias("n_trials")
    )
    both = expected.join(seen, ["subject", "session"], "full_outer").fillna(0, ["n_runs", "n_trials"])
    problem = lambda n, want, what: F.when(
        F.col(n) != want,
        F.concat(F.lit("session "), F.col("session"), F.lit(": "), F.col(n).cast("string"), F.lit(f" {what}, expected {want}")),
    )
    found = F.array_compact(F.array(problem("n_runs", runs, "runs"), problem("n_trials", count, "trials")))
    return both.select("subject", "session", "n_runs", "n_trials", F.array_join(found, "; ").alias("problems"))


def report(checked: DataFrame) -> DataFrame:
    """One line per subject: runs and trials as train/test, and its status."""
    train, test = (F.col("session") == s for s in (N.TRAIN_SESSION, N.TEST_SESSION))
    pick = lambda c, cond: F.coalesce(F.max(F.when(cond, F.col(c))), F.lit(0)).cast("string")
    status = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("problems") != "", F.struct((~train).alias("o"), F.col("problems").alias("p"))))), lambda x: x["p"]), "; ")
    return checked.groupBy("subject").agg(
        F.concat_ws("/", pick("n_runs", train), pick("n_runs", test)).alias("runs"),
        F.concat_ws("/", pick("n_trials", train), pick("n_trials", test)).alias("trials"),
        F.when(status == "", "ok").otherwise(status).alias("status"),
    )


def normalise_sessions(raw: DataFrame, key: str, mapping: dict[str, str], unknown: str = "refuse") -> DataFrame:
    """Translate session keys.

    Rows with an unknown key are refused, with the keys named; with
    ``unknown="keep"`` they stay, with a null session (see ``session_key_problems``).
    """
    if unknown not in ("refuse", "keep"):
        raise ValueError("unknown must be 'refuse' or 'keep'")
    out = raw.withColumn("session", N.lookup(F.col(key), mapping))
    if unknown == "refuse":
        bad = out.where(F.col("session").isNull()).select(key).distinct().limit(5).collect()
        if bad:
            raise ValueError(f"unknown session keys {sorted(str(r[0]) for r in bad)}, expected {sorted(mapping)}")
    return out


def session_key_problems(raw: DataFrame, key: str, mapping: dict[str, str], subject: str = "subject") -> DataFrame:
    """Per subject, the keys that are missing or unknown.  Empty means the key set is exact."""
    wanted = sorted(mapping)
    seen = raw.groupBy(subject, F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    flags = seen.groupBy(subject).agg(
        *[F.max((F.col("_k") == k).cast("int")).alias(f"_has{i}") for i, k in enumerate(wanted)],
        F.count(F.when(~F.col("_k").isin(wanted), 1)).alias("n_unknown"),
    )
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_has{i}") == 0, F.lit(k)) for i, k in enumerate(wanted)])), ",")
    return flags.select(subject, missing.alias("missing"), "n_unknown").where((F.col("missing") != "") | (F.col("n_unknown") > 0))


def labelled(trials: DataFrame, code: str) -> DataFrame:
    """Only annotations that name a class."""
    return trials.withColumn("class_from_code", N.class_of_code(F.col(code))).where(F.col("class_from_code").isNotNull())


def pick_channels(samples: DataFrame, drop: Sequence[str], expected: int) -> tuple[DataFrame, DataFrame]:
    """Samples without the dropped channels, and a per-subject check of the channel count."""
    kept = samples.where(~F.col("channel").isin(list(drop)))
    count = kept.groupBy("subject").agg(F.countDistinct("channel").alias("n_channels"))
    return kept, count.withColumn("ok", F.col("n_channels") == expected)


def scale_check(samples: DataFrame, scale: float, low: float, high: float) -> DataFrame:
    """Overall spread per subject after unit scaling, flagged when outside the range."""
    sd = F.stddev_pop(F.col("value") * scale)
    return samples.groupBy("subject").agg(sd.alias("sd")).withColumn("in_range", F.col("sd").between(low, high))


def montage_agrees(samples: DataFrame, part: str) -> DataFrame:
    """Whether every part of a subject's recording carries the same channels."""
    names = samples.groupBy("subject", part).agg(F.array_sort(F.collect_set("channel")).alias("_m"))
    return names.groupBy("subject").agg((F.countDistinct(F.array_join("_m", ",")) == 1).alias("montage_agrees"))
