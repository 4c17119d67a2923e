"""Values that become available after a latency, and what was known at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.operators import series


def latest_available(
    values: DataFrame, probes: DataFrame, keys: Sequence[str], produced: str, now: str, latency_s: float,
    payload: Sequence[str], probe_columns: Sequence[str] = (), bucket_s: float = 60.0,
) -> DataFrame:
    """Newest value available at each probe time, null while nothing has arrived.

    A value is usable from ``produced + latency_s`` on, the boundary included.
    Both tables are put in one time order and the latest value is carried
    forward, so no pairs of rows are formed.
    """
    if latency_s < 0:
        raise ValueError("latency must not be negative")
    keys, payload, probe_columns = list(keys), list(payload), list(probe_columns)
    value = F.struct(*payload)
    a = values.select(*keys, (F.col(produced) + latency_s).alias("_t"), F.lit(0).alias("_kind"), value.alias("_value"))
    b = probes.select(*keys, F.col(now).alias("_t"), F.lit(1).alias("_kind"), *probe_columns)
    both = a.unionByName(b, allowMissingColumns=True)
    out = series.scan(
        both, keys, ["_t", "_kind"], F.floor(F.col("_t") / bucket_s), {"_latest": ("last", F.col("_value"))}, include_current=True
    )
    return out.where(F.col("_kind") == 1).select(
        *keys, F.col("_t").alias(now), *probe_columns, *[F.col("_latest")[c].alias(c) for c in payload]
    )


def available(t_rel: Column, latency_s: float, until: Column) -> Column:
    if latency_s < 0:
        raise ValueError("latency must not be negative")
    return t_rel.cast("double") + latency_s <= until


def burst_steps(bursts: DataFrame, keys: Sequence[str], dt: float, burst_s: float, gap_s: float) -> DataFrame:
    """Control steps of every burst and the gap after it: a fixed number per burst."""
    steps = round(burst_s / dt) + round(gap_s / dt)
    return bursts.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).withColumn(
        "now", F.col("step") * F.lit(dt)
    )


def replay(
    posteriors: DataFrame, keys: Sequence[str] = ("subject", "burst_id"), latency_s: float = 0.25, dt: float = 0.125,
    burst_s: float = 3.5, gap_s: float = 2.0,
) -> DataFrame:
    """What a controller sees at each step: the latest posterior, and whether it is new.

    Nothing is available during the gap.  A window counts as an update by its
    identity, so two equal posteriors in a row are two updates.
    """
    keys = list(keys)
    steps = burst_steps(posteriors.select(*keys).distinct(), keys, dt, burst_s, gap_s)
    seen = latest_available(
        posteriors, steps, keys, "t_rel", "now", latency_s, ["window_id", "label", "posterior"], ["step"]
    )
    live = F.col("now") < burst_s
    seen = seen.select(
        *keys, "step", "now", *[F.when(live, F.col(c)).alias(c) for c in ("window_id", "label", "posterior")]
    )
    return mark_updates(seen, keys, "step", "window_id")


def mark_updates(steps: DataFrame, keys: Sequence[str], order: str, value_id: str) -> DataFrame:
    """Flag steps where a new value arrived; a gap ends the current value."""
    seen = F.coalesce(F.col(value_id).cast("bigint"), F.lit(-1))
    out = series.lagged(steps, keys, order, {"_before": seen})
    here = F.col(value_id).isNotNull()
    return out.withColumn(
        "decoder_update", here & (F.coalesce(F.col("_before"), F.lit(-1)) != F.col(value_id))
    ).withColumn("has_command", here).drop("_before")


def order_violations(rows: DataFrame, keys: Sequence[str], arrival: str, time: str, strict: bool = False) -> DataFrame:
    """Rows whose time runs backwards in arrival order (``arrival`` is a dense row number)."""
    out = series.lagged(rows, keys, arrival, {"_before": F.col(time)})
    bad = F.col(time) <= F.col("_before") if strict else F.col(time) < F.col("_before")
    return out.where(bad).drop("_before")
