"""Transforms and accuracy measures on classifier posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.functions import hashing as H
from kymora.functions import vectors as V
from kymora.operators import series

GRID = 1024  # ten halvings of [0, 1] end on a multiple of 1/1024
QUALITY_MODES = ("gap_fraction", "absolute")
ERROR_KINDS = ("none", "smoothing", "jitter", "burst")


def correct(p: str = "posterior", label: str = "label") -> Column:
    return V.argmax_class(F.col(p)) == F.col(label)


def accuracy(df: DataFrame, cell: Sequence[str], p: str = "posterior", label: str = "label") -> DataFrame:
    """Share of windows whose most probable class is the true one."""
    return df.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct(p, label).cast("int")).alias("accuracy")
    )


def agreement(df: DataFrame, cell: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Accuracy and chance-corrected agreement (kappa) per cell from the confusion matrix."""
    cell = list(cell)
    if not cell:
        return agreement(df.withColumn("_all", F.lit(1)), ["_all"], truth, pred).drop("_all")
    matrix = df.groupBy(*cell, F.col(truth).alias("_y"), F.col(pred).alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per cell with its confusion matrix, at most K * K entries.
    whole = matrix.groupBy(*cell).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("_y") == F.col("_z"), F.col("_n")).otherwise(0)).alias("_hit"),
        F.collect_list(F.struct("_y", "_z", "_n")).alias("_m"),
    )
    column = lambda k: F.aggregate("_m", F.lit(0).cast("bigint"), lambda s, b: s + F.when(b["_z"] == k, b["_n"]).otherwise(0))
    chance = F.aggregate("_m", F.lit(0).cast("bigint"), lambda s, a: s + a["_n"] * column(a["_y"]))
    po = F.col("_hit") / F.col("n")
    pe = chance / (F.col("n").cast("double") * F.col("n"))
    return whole.withColumn("_pe", pe).select(
        *cell, "n", po.alias("accuracy"), F.when(F.col("_pe") != 1.0, (po - F.col("_pe")) / (1.0 - F.col("_pe"))).alias("kappa")
    )


# --- transforms ---


def mixed(p: Column, label: Column, lam: Column | float) -> Column:
    """Blend toward the truth: ``lam * onehot + (1 - lam) * p`` rounded to float32."""
    lam = F.lit(lam) if not isinstance(lam, Column) else lam
    return V.as_float(
        F.transform(p, lambda v, k: F.when(k == label, lam).otherwise(0.0) + (1.0 - lam) * v.cast("double"))
    )


def smoothed(p: Column, eps: float) -> Column:
    if not 0.0 <= eps <= 1.0:
        raise ValueError("eps must be in [0, 1]")
    return V.as_float(F.transform(p, lambda v: (1.0 - eps) * v.cast("double") + F.lit(eps) / F.size(p)))


def critical_weight(p: Column, label: Column) -> Column:
    """Smallest ``k`` with the truth on top after mixing at ``k / 1024``.

    The closed form lands within one step of the answer; the three candidates
    are tested on the float32 values that are handed out.
    """
    py = F.element_at(p, (label + 1).cast("int")).cast("double")
    rival = F.array_max(F.transform(p, lambda v, k: F.when(k == label, F.lit(-1.0)).otherwise(v.cast("double"))))
    near = F.ceil(F.lit(float(GRID)) * (rival - py) / (1.0 + rival - py)).cast("int")
    wins = lambda k: V.argmax_class(mixed(p, label, k / float(GRID))) == label
    lo, mid, hi = (F.least(F.greatest(near + d, F.lit(0)), F.lit(GRID)) for d in (-1, 0, 1))
    return (
        F.when(V.argmax_class(p) == label, 0)
        .when(wins(lo), lo)
        .when(wins(mid), mid)
        .when(wins(hi), hi)
        .otherwise(F.lit(GRID))
        .cast("int")
    )


def quality_levels(
    df: DataFrame,
    cell: Sequence[str],
    levels: Sequence[float],
    mode: str = "gap_fraction",
    p: str = "posterior",
    label: str = "label",
) -> DataFrame:
    """Mixing weight that reaches each quality level, per cell.

    One pass: every row states the weight at which it turns correct, rows are
    counted per (cell, weight) with map-side combine, and a running share over
    at most 1025 counts answers every level.
    """
    if mode not in QUALITY_MODES:
        raise ValueError(f"unknown quality mode {mode!r}, expected one of {QUALITY_MODES}")
    if any(not 0.0 <= x <= 1.0 for x in levels):
        raise ValueError("levels must lie in [0, 1]")
    cell = list(cell)
    counts = (
        df.withColumn("_k", critical_weight(F.col(p), F.col(label)))
        .groupBy(*cell, "_k")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = Window.partitionBy(*cell).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*cell)
    shares = counts.select(
        *cell,
        "_k",
        (F.sum("_n").over(upto) / F.sum("_n").over(whole)).alias("_share"),
        (F.sum(F.when(F.col("_k") == 0, F.col("_n")).otherwise(0)).over(whole) / F.sum("_n").over(whole)).alias("_base"),
    )
    each = shares.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    target = F.col("_base") + F.col("level") * (1.0 - F.col("_base")) if mode == "gap_fraction" else F.col("level")
    reached = each.withColumn("_target", target).groupBy(*cell, "level").agg(
        F.first("_base").alias("baseline"),
        F.first("_target").alias("target_accuracy"),
        F.min(F.when(F.col("_share") >= F.col("_target"), F.col("_k"))).alias("_hit"),
        F.max("_share").alias("_top"),
        F.min(F.when(F.col("_share") >= F.col("_target"), F.col("_share"))).alias("_at"),
    )
    easy = F.col("target_accuracy") <= F.col("baseline")
    return reached.select(
        *cell,
        "level",
        "baseline",
        "target_accuracy",
        F.when(easy, 0.0).otherwise(F.coalesce(F.col("_hit"), F.lit(GRID)) / float(GRID)).alias("lam"),
        F.when(easy, F.col("baseline")).otherwise(F.coalesce("_at", "_top")).alias("achieved_accuracy"),
    )


def mix_to_levels(df: DataFrame, cell: Sequence[str], levels: DataFrame) -> DataFrame:
    """Rows mixed at the weight their cell needs for each level it asks for."""
    chosen = df.join(levels.select(*cell, "level", "lam"), list(cell))
    return chosen.withColumn("posterior", mixed(F.col("posterior"), F.col("label"), F.col("lam"))).drop("lam")


def _burst_position(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.dense_index(df, keys, ["t_rel", "window_id"], series.time_bucket("t_rel"), "_pos")


def jittered(df: DataFrame, shift: int, keys: Sequence[str] = ("subject", "burst_id")) -> DataFrame:
    """Move the posterior sequence inside each burst by ``shift`` windows.

    Positive is late; the ends repeat the first or last posterior.  Written as
    an equi-join on position, so it does not need a burst in one task.
    """
    keys = list(keys)
    placed = _burst_position(df, keys)
    last = placed.groupBy(*keys).agg(F.max("_pos").alias("_last"))
    source = placed.select(*keys, F.col("_pos").alias("_src"), F.col("posterior").alias("_moved"))
    wanted = F.least(F.greatest(F.col("_pos") - shift, F.lit(0)), F.col("_last"))
    return (
        placed.join(last, keys)
        .withColumn("_src", wanted)
        .join(source, [*keys, "_src"])
        .withColumn("posterior", F.col("_moved"))
        .drop("_pos", "_last", "_src", "_moved")
    )


def burst_errors(
    df: DataFrame, seed: int, p_flip: float, mean_len: float, keys: Sequence[str] = ("subject", "burst_id"),
    n_classes: int = 4, chunk_rows: int = series.CHUNK_ROWS,
) -> DataFrame:
    """Hold one wrong class over stretches of windows, keeping the confidence.

    A stretch starts with probability ``p_flip``, lasts a geometric number of
    windows with mean ``mean_len`` and ends with its burst.  Every draw is a
    hash of the seed and the window.
    """
    if not 0.0 <= p_flip <= 1.0 or mean_len <= 0.0:
        raise ValueError("p_flip must be in [0, 1] and mean_len positive")
    rate = 1.0 / max(mean_len, 1.0)
    length = (
        F.lit(1.0)
        if rate >= 1.0
        else F.greatest(F.lit(1.0), F.ceil(F.log(1.0 - F.col("_u1")) / F.log(F.lit(1.0 - rate))))
    )
    placed = _burst_position(df, keys)
    for i, tag in enumerate(("start", "length", "class")):
        placed = placed.withColumn(f"_u{i}", H.u01(seed, tag, F.col("window_id")))
    wrong = F.floor(F.col("_u2") * (n_classes - 1))
    wrong = F.when(wrong >= F.col("label"), wrong + 1).otherwise(wrong)
    ready = placed.select(
        *df.columns, "_pos", (F.col("_u0") < p_flip).alias("_starts"), length.cast("double").alias("_len"),
        wrong.cast("double").alias("_wrong"),
    )

    def step(state, row):
        left, held = state
        starts, span, wrong_class = row
        if left <= 0 and starts:
            left, held = float(span), float(wrong_class)
        if left > 0:
            return [left - 1.0, held], (int(held),)
        return [0.0, held], (-1,)

    done = series.ordered_fold(
        ready, keys, "_pos", ["_starts", "_len", "_wrong"], 2, [("held_class", T.IntegerType())], step, chunk_rows
    )
    top = F.array_max("posterior").cast("double")
    replaced = F.transform(
        F.col("posterior"),
        lambda v, k: F.when(k == F.col("held_class"), top).otherwise((1.0 - top) / (n_classes - 1)),
    )
    return done.withColumn(
        "posterior", F.when(F.col("held_class") >= 0, V.as_float(replaced)).otherwise(F.col("posterior"))
    ).select(*df.columns, "held_class")


def with_error_structure(
    df: DataFrame, kind: str, seed: int = 1337, smoothing_eps: float = 0.3, jitter_windows: int = 2,
    p_flip: float = 0.2, mean_len: float = 3.0,
) -> DataFrame:
    """Apply one named error structure; the name is kept in ``error_struct``."""
    if kind not in ERROR_KINDS:
        raise ValueError(f"unknown error structure {kind!r}, expected one of {ERROR_KINDS}")
    if kind == "none":
        out = df
    elif kind == "smoothing":
        out = df.withColumn("posterior", smoothed(F.col("posterior"), smoothing_eps))
    elif kind == "jitter":
        out = jittered(df, jitter_windows)
    else:
        out = burst_errors(df, seed, p_flip, mean_len).drop("held_class")
    return out.select(*df.columns).withColumn("error_struct", F.lit(kind))
