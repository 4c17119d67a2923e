"""Metrics and ordered measures on recorded movement traces."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.functions import responses as X
from kymora.functions import vectors as V
from kymora.operators import series

# Class directions in class order.
DIRECTIONS = ((-1.0, 0.0), (1.0, 0.0), (0.0, -1.0), (0.0, 1.0))


# A turn of exactly the threshold is not above it; this keeps rounding from deciding.
TURN_TOL = 1e-12


def with_position(trace: DataFrame, dt: float, key: str = "episode_id", step: str = "step") -> DataFrame:
    """Position as the running sum of velocity, with the position one step earlier."""
    moves = {"x": ("sum", F.col("vx") * dt), "y": ("sum", F.col("vy") * dt)}
    out = series.scan(trace, [key], [step], series.row_bucket(step), moves, include_current=True)
    return out.withColumn("x_before", F.col("x") - F.col("vx") * dt).withColumn("y_before", F.col("y") - F.col("vy") * dt)


def reversals(trace: DataFrame, threshold_deg: float = 90.0, key: str = "episode_id", step: str = "step") -> DataFrame:
    """Sharp turns per (episode, target): heading against the last moving heading.

    Still rows are left out first, so "previous row" means "last moving row".
    Targets without a turn keep a zero.
    """
    if not 0.0 < threshold_deg < 180.0:
        raise ValueError("threshold must be in (0, 180)")
    limit = math.cos(math.radians(threshold_deg)) - TURN_TOL
    ux, uy = V.unit(F.col("vx"), F.col("vy"))
    moving = trace.where(V.has_direction(F.col("vx"), F.col("vy"))).select(
        key, "target_idx", step, ux.alias("_ux"), uy.alias("_uy")
    )
    head = F.struct("_ux", "_uy")
    run = series.scan(moving, [key, "target_idx"], [step], series.row_bucket(step), {"_last": ("last", head)})
    turn = F.col("_last")["_ux"] * F.col("_ux") + F.col("_last")["_uy"] * F.col("_uy") < limit
    turns = run.where(turn).groupBy(key, "target_idx").agg(F.count(F.lit(1)).alias("n"))
    seen = trace.groupBy(key, "target_idx").agg(F.count(F.lit(1)).alias("n_steps"))
    return seen.join(turns, [key, "target_idx"], "left").select(
        key, "target_idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_reversals")
    )


def mean_reversals(trace: DataFrame, threshold_deg: float = 90.0, key: str = "episode_id") -> DataFrame:
    return reversals(trace, threshold_deg, key).groupBy(key).agg(F.avg("n_reversals").alias("direction_reversals"))


def first_dwell(
    steps: DataFrame, inside: Column, dt: float, dwell_s: float, key: str = "episode_id", step: str = "step"
) -> DataFrame:
    """First step per (episode, target) at which a target was held for ``dwell_s`` without a break.

    Leaving the target or getting a new one starts the count again.
    """
    need = math.ceil(dwell_s / dt - 1e-9)
    flagged = steps.withColumn("_in", inside)
    known = series.lagged(flagged, [key], step, {"_t0": F.col("target_idx")})
    changed = F.coalesce(F.col("_t0") != F.col("target_idx"), F.lit(False))
    cut = F.when(~F.col("_in"), F.col(step)).when(changed, F.col(step) - 1)
    run = series.scan(known, [key], [step], series.row_bucket(step), {"_cut": ("last", cut)}, include_current=True)
    held = F.when(F.col("_in"), F.col(step) - F.coalesce(F.col("_cut"), F.lit(0))).otherwise(0)
    done = run.withColumn("_held", held).groupBy(key, "target_idx").agg(
        F.max("_held").alias("longest_hold"), F.min(F.when(F.col("_held") >= need, F.col(step))).alias("acquired_step")
    )
    return done.withColumn("acquired", F.col("acquired_step").isNotNull())


def entries(steps: DataFrame, inside: Column, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Outside-to-inside edges per dense series; a series that begins inside counts one."""
    flagged = steps.withColumn("_in", inside.cast("int"))
    run = series.lagged(flagged, keys, step, {"_was": F.col("_in")})
    edge = (F.col("_in") == 1) & (F.coalesce(F.col("_was"), F.lit(0)) == 0)
    return run.groupBy(*keys).agg(F.count(F.when(edge, 1)).alias("n_entries"))


def attempt_paths(steps: DataFrame, target_radius: float, n_targets: int, radius: float, key: str = "episode_id") -> DataFrame:
    """Distance travelled per attempt, and the straight line to the target's edge."""
    tx, ty = V.ring_position(F.col("target_idx"), n_targets, radius)
    moved = V.hypot(F.col("x") - F.col("x_before"), F.col("y") - F.col("y_before"))
    per = steps.withColumn("_moved", moved).groupBy(key, "target_idx").agg(
        F.sum("_moved").alias("path_length"),
        F.min_by("x_before", "step").alias("_x0"),
        F.min_by("y_before", "step").alias("_y0"),
    )
    line = V.hypot(tx - F.col("_x0"), ty - F.col("_y0")) - target_radius
    return per.select(key, "target_idx", "path_length", F.greatest(line, F.lit(0.0)).alias("straight_line"))


def bursts_without_command(steps: DataFrame, burst: Column, key: str = "episode_id") -> DataFrame:
    """Bursts in which no non-zero command was issued, per episode."""
    issued = F.col("has_command") & V.has_direction(F.col("vx"), F.col("vy"), 0.0)
    per = steps.groupBy(key, burst.alias("_burst")).agg(F.bool_or(issued).alias("_any"))
    return per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_bursts"), F.count(F.when(~F.col("_any"), 1)).alias("bursts_without_command")
    )


def contribution(mask: Column) -> tuple[Column, Column]:
    """Mean cosine between decoded intent and realised motion, and the share of masked samples left out."""
    iux, iuy = V.unit(F.col("ix"), F.col("iy"))
    vux, vuy = V.unit(F.col("vx"), F.col("vy"))
    ok = mask & V.has_direction(F.col("ix"), F.col("iy")) & V.has_direction(F.col("vx"), F.col("vy"))
    n_ok, n = F.count(F.when(ok, 1)), F.count(F.when(mask, 1))
    return F.avg(F.when(ok, iux * vux + iuy * vuy)), F.when(n > 0, 1.0 - n_ok / n).otherwise(1.0)


def command_accuracy(label: Column, vx: str = "vx", vy: str = "vy") -> tuple[Column, Column]:
    """Share of issued commands that point at the intended class, and how many were issued.

    Counted once per decoder update that produced a non-zero command.
    """
    issued = F.col("decoder_update") & F.col("has_command") & V.has_direction(F.col(vx), F.col(vy), 0.0)
    hit = V.best_aligned(F.col(vx), F.col(vy), DIRECTIONS) == label
    return F.avg(F.when(issued, hit.cast("int"))), F.count(F.when(issued, 1))


# --- metrics over target outcomes ---

OUTCOME_METRICS = {
    "n_success": lambda n_targets: F.count(F.when(F.col("acquired"), 1)),
    "n_timeouts": lambda n_targets: F.count(F.when(~F.col("acquired"), 1)),
    "collisions": lambda n_targets: F.sum("collisions"),
    "success_rate": lambda n_targets: F.count(F.when(F.col("acquired"), 1)) / F.lit(float(n_targets)),
    "time_to_target_excluded": lambda n_targets: F.count(F.when(~F.col("acquired"), 1)),
    "path_efficiency": lambda n_targets: F.avg(
        F.when(
            F.col("acquired") & (F.col("path_length") > 0),
            F.when(F.col("straight_line") == 0, 1.0).otherwise(F.col("straight_line") / F.col("path_length")),
        )
    ),
}


def outcome_metrics(outcomes: DataFrame, n_targets: int, key: str = "episode_id", names: Sequence[str] | None = None) -> DataFrame:
    """Named outcome metrics per episode, all from one aggregate with map-side combine."""
    if n_targets < 1:
        raise ValueError("n_targets must be positive")
    return outcomes.groupBy(key).agg(*[OUTCOME_METRICS[n](n_targets).alias(n) for n in names or OUTCOME_METRICS])


def median_time(outcomes: DataFrame, key: str = "episode_id") -> DataFrame:
    """Median seconds over acquired targets and the number of attempts left out.

    Durations are whole environment steps below the timeout, so counting per
    (episode, duration) first leaves few rows even in a very large episode.
    """
    per = outcomes.groupBy(key, "duration_s").agg(
        F.count(F.when(F.col("acquired"), 1)).alias("_ok"), F.count(F.when(~F.col("acquired"), 1)).alias("_out")
    )
    weight = F.greatest(F.col("_ok"), F.lit(1))
    return per.groupBy(key).agg(
        F.percentile(F.when(F.col("_ok") > 0, F.col("duration_s")), 0.5, weight).alias("time_to_target_median"),
        F.sum("_out").alias("time_to_target_excluded"),
    )


def summarise(outcomes: DataFrame, trace: DataFrame, n_targets: int, dt: float, key: str = "episode_id") -> DataFrame:
    """Every metric of an episode from its outcomes and its trace.

    An episode that has only one of the two keeps its row, with nulls for the rest;
    ``has_outcomes`` and ``has_trace`` tell which it has.
    """
    first = outcome_metrics(
        outcomes, n_targets, key, ["n_success", "n_timeouts", "collisions", "success_rate", "path_efficiency"]
    ).join(median_time(outcomes, key), key, "left").withColumn("has_outcomes", F.lit(True))
    uci, left_out = contribution(F.col("decoder_update") & F.col("has_command"))
    second = trace.groupBy(key).agg(
        (F.count(F.lit(1)) * F.lit(dt)).alias("episode_duration_s"),
        uci.alias("user_contribution_index"),
        left_out.alias("uci_excluded_frac"),
    ).join(mean_reversals(trace, key=key), key, "left").withColumn("has_trace", F.lit(True))
    both = first.join(second, key, "full").fillna(False, ["has_outcomes", "has_trace"])
    rate = F.least(F.col("success_rate"), F.lit(1.0))
    return both.withColumn("effective_itr", X.information_rate(rate, n_targets, F.col("episode_duration_s")))
