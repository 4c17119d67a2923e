"""Tables behind the report figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.functions import naming as N
from kymora.operators import models as M
from kymora.operators import scores as SC

# Ablation experiments and the axis each one varies.
ABLATIONS = (
    ("ablation_window", "window_s"), ("ablation_latency", "latency_ms"), ("ablation_protocol", "protocol"), ("ablation_errstruct", "error_struct"),
)
CHANCE = 0.25


def cell_scores(episodes: DataFrame, axes: Sequence[str], metrics: Sequence[str], **settings) -> DataFrame:
    """Axis columns plus mean and interval columns per metric."""
    sums = SC.subject_sums(episodes, axes, metrics)
    rows = SC.estimates(SC.subject_means(sums, axes, metrics), axes, **settings)
    return SC.cell_table(rows, axes, metrics)


def quality_sweep(episodes: DataFrame, **settings) -> DataFrame:
    """Success against achieved accuracy per mapping; ``is_sweep`` is false with one accuracy level."""
    out = cell_scores(episodes, ["mapping", "quality_level"], ["effective_acc", "success_rate"], **settings)
    spread = out.agg(F.min("effective_acc_mean") < F.max("effective_acc_mean"))
    return out.withColumn("is_sweep", spread.scalar()).withColumn("label", N.mapping_label(F.col("mapping"))).orderBy(
        "mapping", "effective_acc_mean"
    )


def kappa_points(episodes: DataFrame) -> DataFrame:
    """One point per mapping, subject and decoder."""
    return episodes.groupBy("mapping", "subject", "decoder").agg(
        F.avg("kappa_offline").alias("kappa_offline"), F.avg("success_rate").alias("success_rate")
    )


def kappa_lines(episodes: DataFrame) -> DataFrame:
    """Least-squares line per mapping, cut to where success stays in [0, 1]; ``note`` when there is no kappa."""
    fitted = M.lines(kappa_points(episodes), ["mapping"], "kappa_offline", "success_rate", (0.0, 1.0))
    have = episodes.groupBy("mapping").agg(F.count("kappa_offline").alias("_k"))
    note = F.when(F.col("_k") == 0, "no offline kappa in this run")
    return have.join(fitted, "mapping", "left").withColumn("note", note).drop("_k")


def autonomy_sweep(episodes: DataFrame, levels: DataFrame, **settings) -> DataFrame:
    """Success and contribution by decoder and autonomy level, with the crossing marked."""
    out = cell_scores(
        episodes.where(F.col("alpha").isNotNull()), ["decoder", "alpha"], ["success_rate", "user_contribution_index"], **settings
    )
    star = M.crossing(levels).select("alpha_star").scalar()
    return out.withColumn("alpha_star", star).withColumn("label", N.decoder_label(F.col("decoder"))).orderBy("decoder", "alpha")


def command_accuracy(episodes: DataFrame, **settings) -> DataFrame:
    """Command accuracy by mapping and latency, chance level and bursts left uncommanded."""
    out = cell_scores(episodes, ["mapping", "latency_ms"], ["command_accuracy", "bursts_without_command"], **settings)
    return out.withColumn("chance", F.lit(CHANCE)).orderBy("mapping", "latency_ms")


def ablation_grid(spark: SparkSession, runs: Mapping[str, DataFrame | None], metric: str = "success_rate") -> DataFrame:
    """One metric across four experiments; a missing run is a row with the reason."""
    parts = None
    for experiment, axis in ABLATIONS:
        run = runs.get(experiment)
        if run is None or axis not in run.columns:
            reason = "not supplied" if run is None else f"has no {axis} axis"
            part = spark.range(1).select(
                F.lit(experiment).alias("experiment"), F.lit(axis).alias("axis"), F.lit(None).cast("string").alias("mapping"),
                F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("mean"), F.lit(reason).alias("reason"),
            )
        else:
            means = SC.subject_means(SC.subject_sums(run, ["mapping", axis], [metric]), ["mapping", axis], [metric])
            part = means.groupBy("mapping", axis).agg(F.avg("mean").alias("mean")).select(
                F.lit(experiment).alias("experiment"), F.lit(axis).alias("axis"), "mapping", F.col(axis).cast("string").alias("value"),
                "mean", F.lit(None).cast("string").alias("reason"),
            )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def intent_ablation(episodes: DataFrame, **settings) -> DataFrame:
    """Aware against blind by autonomy level."""
    return cell_scores(episodes.where(F.col("alpha").isNotNull()), ["intent_mode", "alpha"], ["success_rate"], **settings).orderBy(
        "intent_mode", "alpha"
    )


def labels(names: Column) -> Column:
    return N.metric_label(names)
