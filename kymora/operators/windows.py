"""Trials and sliding windows cut from long sample series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.functions import naming as N
from kymora.operators import series

PROTOCOLS = ("burst", "stitched")
SEGMENT = 1_000_000


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def half_up_number(x: float) -> int:
    return math.floor(x + 0.5)


def _starts_between(first: Column, stop: Column, stride: float) -> Column:
    """Window starts ``floor(i * stride + 0.5)`` inside ``[first, stop)`` as an array."""
    lo = F.greatest(F.floor((first - 0.5) / stride) - 1, F.lit(0)).cast("bigint")
    hi = F.greatest(F.ceil((stop + 0.5) / stride) + 1, lo).cast("bigint")
    starts = F.transform(F.sequence(lo, hi), lambda i: half_up(i.cast("double") * stride))
    return F.filter(starts, lambda s: (s >= first) & (s < stop))


def _check(window: int, stride: float) -> None:
    if window <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")


def window_starts(lengths: DataFrame, keys: Sequence[str], n: str, window: int, stride: float) -> DataFrame:
    """First sample of every window that fits in a series of ``n`` samples.

    A fractional stride does not drift.  Long series are split into segments
    first, so one series never unfolds inside a single task.
    """
    _check(window, stride)
    stop = F.col(n) - window + 1
    segments = lengths.where(stop > 0).select(
        *keys, n, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((stop - 1) / SEGMENT))).alias("_seg")
    )
    spread = segments.repartition(*[F.col(k) for k in keys], F.col("_seg"))
    first = F.col("_seg") * SEGMENT
    return spread.select(
        *keys, F.explode(_starts_between(first, F.least(first + SEGMENT, stop), stride)).alias("start_sample")
    )


def epoch_length(tmin: Column | float, tmax: Column | float, sfreq: float, include_end: bool = False) -> Column:
    """Samples in one trial; halves round to even."""
    tmin, tmax = (c if isinstance(c, Column) else F.lit(float(c)) for c in (tmin, tmax))
    n = F.bround((tmax - tmin) * sfreq).cast("bigint")
    return n + 1 if include_end else n


def build_windows(
    trials: DataFrame, protocol: str, *, session: Sequence[str] = ("subject", "session"), trial: str = "trial_id",
    onset: str = "onset_s", label: str = "class", sfreq: float = 250.0, window_s: float = 2.0, stride_s: float = 0.25,
    tmin: float = 0.5, tmax: float = 4.0, first_window: str = "delay",
) -> DataFrame:
    """Window index of every trial under the named protocol."""
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol!r}, expected one of {PROTOCOLS}")
    if first_window != "delay":
        raise ValueError("only the 'delay' policy exists: padding the start would invent signal")
    window, n = half_up_number(window_s * sfreq), round((tmax - tmin) * sfreq)
    stride = stride_s * sfreq
    _check(window, stride)
    if protocol == "burst":
        return _burst(trials, trial, onset, label, sfreq, window, stride, n, tmin, tmax)
    return _stitched(trials, list(session), trial, onset, label, sfreq, window, stride, n, tmin, tmax)


def _burst(trials, trial, onset, label, sfreq, window, stride, n, tmin, tmax):
    if window > n:
        raise ValueError(f"a window of {window} samples does not fit in a trial of {n}")
    starts = _starts_between(F.lit(0).cast("bigint"), F.lit(n - window + 1).cast("bigint"), stride)
    return trials.withColumn("start_sample", F.explode(starts)).select(
        *trials.columns,
        "start_sample",
        ((F.col("start_sample") + window) / F.lit(float(sfreq))).alias("t_rel"),
        F.col(trial).alias("burst_id"),
        F.col(label).alias("label"),
        F.lit(False).alias("boundary"),
        (F.col(onset) + tmin).alias("burst_onset"),
        (F.col(onset) + tmax).alias("burst_offset"),
    )


def _stitched(trials, session, trial, onset, label, sfreq, window, stride, n, tmin, tmax):
    # Each trial owns the windows that end in it, so a session never unfolds in one row.
    placed = series.dense_index(trials, session, [onset, trial], F.floor(F.col(onset) / 65536.0), "_pos")
    first = F.col("_pos") * n - window + 1
    out = placed.withColumn("start_sample", F.explode(_starts_between(first, first + n, stride)))
    last = F.col("start_sample") + window - 1
    return out.select(
        *trials.columns,
        "start_sample",
        ((last + 1 - F.col("_pos") * n) / F.lit(float(sfreq))).alias("t_rel"),
        F.col(trial).alias("burst_id"),
        F.col(label).alias("label"),
        (F.floor(F.col("start_sample") / n) != F.col("_pos")).alias("boundary"),
        (F.col(onset) + tmin).alias("burst_onset"),
        (F.col(onset) + tmax).alias("burst_offset"),
    )


# --- cutting signal ---


def blocks(samples: DataFrame, keys: Sequence[str], idx: str, value: str, rows: int = 1024, overlap: int = 0) -> DataFrame:
    """Samples packed into blocks of ``rows`` values, each followed by the first ``overlap`` of the next.

    A block is a bounded array, so a long series becomes many rows.
    """
    if not 0 <= overlap < rows:
        raise ValueError("the overlap must be shorter than a block")
    at, own = F.col(idx) % rows, F.floor(F.col(idx) / rows)
    shared = F.when((at < overlap) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    packed = samples.select(*keys, idx, value, F.explode(shared).alias("block")).groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("_s")
    )
    return packed.select(*keys, "block", F.transform("_s", lambda s: s["v"]).alias("signal"))


def block_rows(length: int) -> int:
    """Block size for cuts of ``length`` samples."""
    return max(64, 1 << (2 * length - 1).bit_length())


def cut(
    samples: DataFrame, ranges: DataFrame, on: Sequence[str], series_keys: Sequence[str], range_id: str, start: str, length: int,
    idx: str = "sample_idx", value: str = "value",
) -> DataFrame:
    """Signal of every range ``[start, start + length)``, one row per range and series, with its ``status``.

    ``on`` are the keys that ranges and samples share (a subset of
    ``series_keys``).  Blocks overlap by one range, so every range lies inside
    one block: the range join is an equi-join on keys and block number, and a
    long series is spread over its blocks.

    No range is lost: ``ok`` is a whole signal, ``short`` ends with its series, ``outside``
    (null signal) starts before or behind it, ``no recording`` (null signal and series)
    meets no series at all.
    """
    rows = block_rows(length)
    packed = blocks(samples, series_keys, idx, value, rows, length - 1)
    wanted = ranges.select(*on, range_id, F.col(start).alias("_start")).withColumn("block", F.floor(F.col("_start") / rows))
    every = wanted.join(samples.select(*series_keys).distinct().withColumn("_there", F.lit(True)), list(on), "left")
    inside = F.slice("signal", (F.col("_start") - F.col("block") * rows + 1).cast("int"), length)
    signal = F.when((F.col("_start") >= 0) & (F.size(inside) > 0), inside)
    status = F.when(F.col("_there").isNull(), "no recording").when(signal.isNull(), "outside").when(F.size(signal) < length, "short").otherwise("ok")
    found = every.join(packed, [*series_keys, "block"], "left")
    return found.select(*series_keys, range_id, F.col("_start").alias(start), signal.alias("signal"), status.alias("status"))


def slice_window(signal: Column, start: Column, window: int) -> Column:
    """Window inside a trial that is already one array."""
    return F.slice(signal, (start + 1).cast("int"), window)


def plan_epochs(
    trials: DataFrame, lengths: DataFrame, on: Sequence[str], *, onset: str, sfreq: float, tmin: float, n: int,
    max_short: int, event_offset_s: float = 0.0,
) -> DataFrame:
    """Sample range per trial and its status.

    ``error``: starts before the recording or misses more than ``max_short``
    samples; ``truncated``: misses a few; ``no recording``: there is no length
    for its keys; ``ok`` otherwise.  Every trial keeps its row.
    """
    cue = F.col(onset) + event_offset_s
    start = F.bround(cue * sfreq).cast("bigint") + F.bround(F.lit(tmin * sfreq)).cast("bigint")
    short = F.col("start_sample") + n - F.col("n_samples")
    return (
        trials.withColumn("start_sample", start)
        .join(lengths, list(on), "left")
        .withColumn("shortfall", F.when(F.col("n_samples").isNotNull(), F.greatest(short, F.lit(0))))
        .withColumn(
            "status",
            F.when(F.col("n_samples").isNull(), "no recording").when((F.col("start_sample") < 0) | (short > max_short), "error").when(short > 0, "truncated").otherwise("ok"),
        )
    )


def overlaps_any(
    probes: DataFrame, spans: DataFrame, keys: Sequence[str], probe_id: str, start: str, stop: str, flag: str
) -> DataFrame:
    """Whether a probe interval overlaps any span of its series.

    A span that begins before the probe ends overlaps it exactly when the
    largest end among such spans lies after the probe's start.  That is a
    running maximum over both tables in time order: no pairs are formed, and
    a span of any length costs one row.
    """
    keys = list(keys)
    a = probes.select(*keys, F.col(stop).alias("_at"), F.lit(0).alias("_kind"), F.col(probe_id), F.col(start).alias("_from"))
    b = spans.select(
        *keys, F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(probes.schema[probe_id].dataType).alias(probe_id),
        F.col(stop).alias("_from"),
    )
    both = a.unionByName(b)
    reach = F.when(F.col("_kind") == 1, F.col("_from"))
    run = series.scan(both, keys, ["_at", "_kind"], F.floor(F.col("_at") / 3600.0), {"_reach": ("max", reach)})
    hit = F.coalesce(F.col("_reach") > F.col("_from"), F.lit(False))
    return run.where(F.col("_kind") == 0).select(*keys, probe_id, hit.alias(flag))


def number_trials(trials: DataFrame, subject: str = "subject", onset: str = "onset_s", tie: str = "trial_id") -> DataFrame:
    """Zero-based trial number per subject in session, run and time order."""
    rank = F.when(F.col("session") == N.TRAIN_SESSION, 0).otherwise(1)
    bucket = F.struct(rank.alias("s"), F.col("run").alias("r"), F.floor(F.col(onset) / 65536.0).alias("t"))
    return series.dense_index(trials, [subject], [rank, "run", onset, tie], bucket, "trial_no")
