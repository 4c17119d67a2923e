"""Summaries with the subject as the unit of analysis."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.functions import hashing as H
from kymora.operators import series
from kymora.operators.keyed import key_column
from kymora.session import spread, stored

# Summarised metrics and candidate axes, in report order.
METRICS = (
    "effective_acc", "command_accuracy", "success_rate", "path_efficiency", "time_to_target_median", "direction_reversals",
    "effective_itr", "user_contribution_index",
)
CELL_AXES = (
    "mapping", "decoder", "quality_level", "alpha", "intent_mode", "protocol", "window_s", "latency_ms", "error_struct",
)
VALUES, ROW_DRAWS, CHUNK_DRAWS = 4096, 1 << 16, 1 << 20  # means in a block; draws in a row; draws that meet a block together


def _clean(df: DataFrame, name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def _axis_text(df: DataFrame, name: str) -> Column:
    return H.micro(F.col(name)) if df.schema[name].dataType.simpleString() in ("double", "float") else F.col(name)


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def axis_variation(df: DataFrame, axes: Sequence[str] = CELL_AXES) -> DataFrame:
    """Which axes take more than one value; a missing value counts as one.

    Smallest against largest value plus a count of nulls answers this in one
    aggregate, without counting distinct values.
    """
    axes = present(df, axes)
    flags = [
        (
            F.coalesce(F.min(a) != F.max(a), F.lit(False)) | ((F.count(a) > 0) & (F.count(a) < F.count(F.lit(1))))
        ).alias(a)
        for a in axes
    ]
    wide = df.agg(*flags)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("axis"), F.col(a).alias("varies")) for i, a in enumerate(axes)]))
    return wide.select(pairs.alias("x")).select("x.*")


def cell_axes(df: DataFrame, axes: Sequence[str] = CELL_AXES) -> list[str]:
    """Names of the varying axes (one row is read back); the mapping when none varies."""
    rows = axis_variation(df, axes).where("varies").orderBy("position").collect()  # at most nine rows
    return [r["axis"] for r in rows] or ["mapping"]


def subject_sums(df: DataFrame, cell: Sequence[str], metrics: Sequence[str], subject: str = "subject") -> DataFrame:
    """Sum and count of every metric per (cell, subject): the only pass over the episodes.

    The result, one row per cell and subject, is stored, because means,
    intervals and counts all read it.
    """
    metrics = present(df, metrics)
    aggs = []
    for m in metrics:
        aggs += [F.sum(_clean(df, m)).alias(f"s_{m}"), F.count(_clean(df, m)).alias(f"n_{m}")]
    return stored(df.groupBy(*dict.fromkeys([*cell, subject])).agg(F.count(F.lit(1)).alias("n_rows"), *aggs))


def subject_means(sums: DataFrame, cell: Sequence[str], metrics: Sequence[str], subject: str = "subject") -> DataFrame:
    """One mean per (cell, subject, metric), long, from sums of any finer cell."""
    metrics = [m for m in metrics if f"s_{m}" in sums.columns]
    keys = list(dict.fromkeys([*cell, subject]))
    merged = sums.groupBy(*keys).agg(
        *[F.sum(f"{p}_{m}").alias(f"{p}_{m}") for m in metrics for p in "sn"]
    )
    items = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"s_{m}").alias("s"), F.col(f"n_{m}").alias("n")) for m in metrics]
    )
    long = merged.select(*keys, F.explode(items).alias("x")).where(F.col("x.n") > 0)
    return long.select(*keys, F.col("x.metric").alias("metric"), (F.col("x.s") / F.col("x.n")).alias("mean"), F.col("x.n").alias("n"))


def _indexed(means: DataFrame, keys: Sequence[str], draw_key: Sequence, subject: str, block: int) -> DataFrame:
    """Subject means numbered from 0 in the order of the subjects, and the text that the draws of their group are keyed by."""
    rows = means.select(
        *keys, key_column(keys).alias("_g"), F.col(subject).alias("_subject"), F.col("mean").cast("double").alias("mean"),
        H.key_text(*draw_key).alias("_draw"),
    )
    if isinstance(means.schema[subject].dataType, T.NumericType):
        bucket = F.coalesce(F.floor(F.col("_subject") / block), F.lit(-(1 << 62)))  # no subject sorts first
    else:  # text has no steps of equal width: ranges of the sorted rows, kept in the table
        rows = stored(rows.repartitionByRange("_subject").withColumn("_range", F.spark_partition_id()))
        bucket = F.col("_range")
    return stored(series.dense_index(rows, ["_g"], ["_subject"], bucket, "_at").select(*keys, "_g", "_draw", "_at", "mean"))


def _chunk(n: int, block: int) -> int:
    """Replicates of a group of ``n`` subjects whose draws meet a block of values together."""
    return CHUNK_DRAWS // min(n, block)


def _draw(block: int, row_draws: int):
    """Arrow map: the draws of a run of slots in some replicates, put together by the block of values that they pick from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            n, slot = r["_n"], r["_slot"]
            width, replicates = min(n - slot, row_draws), range(r["_rep"], r["_to"] + 1)
            digests = range(slot // 4, (slot + width + 3) // 4)
            raw = b"".join(hashlib.md5(f"{r['_draw']}|{i}|{d}".encode()).digest() for i in replicates for d in digests)
            u = np.frombuffer(raw, ">u4").reshape(len(replicates), -1)[:, :width]
            pick = np.floor(u / H.SCALE * n).astype(np.int64).ravel()
            rep = np.repeat(np.arange(r["_rep"], r["_to"] + 1, dtype=np.int32), width)
            blocks = (n - 1) // block + 1
            code = (rep - 1) // _chunk(n, block) * blocks + pick // block
            order = np.argsort(code, kind="stable")
            found, start = np.unique(code[order], return_index=True)
            reps, offsets = np.split(rep[order], start[1:]), np.split((pick % block).astype(np.uint16)[order], start[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["_g"]] * len(found), pa.string()), pa.array(found % blocks, pa.int64()), pa.array(found // blocks, pa.int64()),
                    pa.array([x.tobytes() for x in reps], pa.binary()), pa.array([x.tobytes() for x in offsets], pa.binary()),
                ],
                ["_g", "_block", "_chunk", "_reps", "_offsets"],
            )

    return run


def _picked(block: int):
    """What one block of values adds to the means of the replicates of a chunk."""

    def run(key: tuple, values: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if values.empty or draws.empty:
            return pd.DataFrame({"_g": [], "_rep": [], "_part": []})
        n = int(values["_n"].iloc[0])
        first = key[2] * _chunk(n, block) + 1
        reps = np.frombuffer(b"".join(draws["_reps"]), np.int32) - first
        offsets = np.frombuffer(b"".join(draws["_offsets"]), np.uint16)
        sums = np.bincount(reps, weights=np.asarray(values["_v"].iloc[0], float)[offsets])
        at = np.flatnonzero(np.bincount(reps))
        return pd.DataFrame({"_g": key[0], "_rep": at + first, "_part": sums[at] / n})

    return run


def bootstrap(
    means: DataFrame, keys: Sequence[str], n_boot: int, ci: float, draw_key: Sequence, subject: str = "subject",
    block: int = VALUES, row_draws: int = ROW_DRAWS,
) -> DataFrame:
    """Percentile interval of the mean over resampled subjects, per group.

    Draws are hashed from the group, the replicate and the slot.  Subjects are numbered
    and lie in blocks of ``block`` means (65536 at most); slots and replicates are dealt to
    rows of ``row_draws`` draws (a multiple of 4).  Draws meet the block that they pick from, CHUNK_DRAWS or so at a time, and
    are summed there by replicate.  So no row and no task holds a group, whatever its
    size.  Groups of one subject have no interval.
    """
    keys = list(keys)
    at = _indexed(means, keys, draw_key, subject, block)
    named = [F.first("_draw").alias("_draw"), *[F.first(k).alias(k) for k in keys]]
    groups = at.groupBy("_g").agg((F.max("_at") + 1).alias("_n"), *named).where("_n > 1")
    last = F.floor(F.lit(n_boot - 1) / F.floor(F.lit(CHUNK_DRAWS) / F.least("_n", F.lit(block))))
    blocks = at.groupBy("_g", F.floor(F.col("_at") / block).alias("_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "mean"))), lambda x: x["mean"]).alias("_v")  # ``block`` numbers at most
    )
    values = blocks.join(groups.select("_g", "_n"), "_g").withColumn("_chunk", F.explode(F.sequence(F.lit(0), last)))
    per_row = F.greatest(F.lit(1), F.floor(F.lit(row_draws) / F.col("_n"))).cast("int")
    dealt = groups.select("_g", "_draw", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(row_draws))).alias("_slot"))
    dealt = dealt.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot), per_row)))
    dealt = spread(dealt.withColumn("_to", F.least(F.col("_rep") + per_row - 1, F.lit(n_boot))), "_g", "_slot", "_rep")
    draws = dealt.mapInArrow(_draw(block, row_draws), "_g string, _block bigint, _chunk bigint, _reps binary, _offsets binary")
    met = ["_g", "_block", "_chunk"]
    parts = values.groupBy(*met).cogroup(draws.groupBy(*met)).applyInPandas(_picked(block), "_g string, _rep bigint, _part double")
    low = (1.0 - ci) / 2.0
    ends = parts.groupBy("_g", "_rep").agg(F.sum("_part").alias("_m")).groupBy("_g").agg(
        F.percentile("_m", F.array(F.lit(low), F.lit(1.0 - low))).alias("_q")
    )
    return groups.join(ends, "_g").select(*keys, F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))


def estimates(
    means: DataFrame, cell: Sequence[str], *, n_boot: int = 1000, ci: float = 0.95, min_subjects: int = 3, seed: int = 1337,
    subject: str = "subject",
) -> DataFrame:
    """Mean, spread and interval over subject means; a reason where there is no interval."""
    cell = list(cell)
    keys = [*cell, "metric"]
    need = max(min_subjects, 2)
    table = means.groupBy(*keys).agg(
        F.avg("mean").alias("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("sd"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_subjects"),
    )
    note = F.when(
        F.col("n_subjects") < need,
        F.concat(F.col("n_subjects").cast("string"), F.lit(f" subject(s); a between-subject interval needs at least {need}")),
    )
    table = table.withColumn("ci_note", note)
    if cell == [subject]:
        return table.withColumn("ci_lo", F.lit(None).cast("double")).withColumn("ci_hi", F.lit(None).cast("double"))
    draw = [seed, "bootstrap", *[_axis_text(means, c) for c in cell], F.col("metric")]
    enough = means.withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_s") >= need).drop("_s")
    ends = bootstrap(enough, keys, n_boot, ci, draw, subject)
    match = [F.col(f"t.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    return table.alias("t").join(ends.alias("e"), match, "left").select("t.*", "e.ci_lo", "e.ci_hi")


def scores(
    df: DataFrame, axes: Sequence[str] | None = None, metrics: Sequence[str] = METRICS, subject: str = "subject", **settings
) -> DataFrame:
    """Estimates by cell, by subject and overall, from one pass over the episodes."""
    axes = list(axes) if axes is not None else cell_axes(df)
    sums = subject_sums(df, axes, metrics, subject)
    columns = [*axes, subject, "n_episodes", "metric", "mean", "sd", "n", "n_subjects", "ci_lo", "ci_hi", "ci_note"]
    kinds = {a: df.schema[a].dataType for a in [*axes, subject]}
    blocks = None
    for block, cell in (("by_cell", axes), ("by_subject", [subject]), ("overall", [])):
        rows = sums.groupBy(*cell).agg(F.sum("n_rows").alias("n_episodes")) if cell else sums.agg(F.sum("n_rows").alias("n_episodes"))
        est = estimates(subject_means(sums, cell, metrics, subject), cell, subject=subject, **settings)
        if cell:
            match = [F.col(f"x.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cell]
            est = est.alias("x").join(rows.alias("r"), match).select("x.*", "r.n_episodes")
        else:
            est = est.withColumn("n_episodes", rows.scalar())
        missing = [c for c in columns if c not in est.columns]
        est = est.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in missing]).select(F.lit(block).alias("block"), *columns)
        blocks = est if blocks is None else blocks.unionByName(est)
    return blocks


def cell_table(estimate_rows: DataFrame, cell: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per cell with ``<metric>_mean``, ``_lo`` and ``_hi`` columns."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    out = []
    for m in metrics:
        out += [pick(m, "mean").alias(f"{m}_mean"), pick(m, "ci_lo").alias(f"{m}_lo"), pick(m, "ci_hi").alias(f"{m}_hi")]
    return estimate_rows.groupBy(*cell).agg(*out)


# --- what the data can support ---


def diagnostics(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Count, distinct values, mean, spread and range of each candidate response."""
    stats = []
    for c in candidates:
        v = _clean(df, c)
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"),
            )
        )
    wide = df.agg(F.array(*stats).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _clean(df, c).alias("v")) for c in candidates]))
    distinct = df.select(values.alias("x")).select("x.*").where(F.col("v").isNotNull()).distinct()
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return wide.join(counts, "column", "left").fillna(0, ["n_distinct"])


def fittable(
    df: DataFrame, *, response: str, predictor: str, group: str = "subject", min_spread: float = 1e-6, min_groups: int = 3,
    candidates: Sequence[str] = (),
) -> DataFrame:
    """One row: whether a model can be fitted, and the reason when it cannot."""
    sd = lambda c: F.coalesce(F.stddev_samp(_clean(df, c)), F.lit(0.0))
    levels = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("n_groups"))
    others = [c for c in candidates if c != response]
    row = df.agg(sd(response).alias("response_sd"), sd(predictor).alias("predictor_sd"), *[sd(c).alias(f"_sd_{c}") for c in others])
    row = row.withColumn("n_groups", levels.scalar())
    usable = F.array_compact(F.array(*[F.when(F.col(f"_sd_{c}") >= min_spread, F.lit(c)) for c in others])) if others else F.array().cast("array<string>")
    reason = (
        F.when(F.col("n_groups") < min_groups, F.concat(F.lit(f"needs at least {min_groups} levels of {group}, has "), F.col("n_groups").cast("string")))
        .when(
            F.col("response_sd") < min_spread,
            F.concat(F.lit(f"the response {response} is saturated; candidates: "), F.when(F.size(usable) == 0, "none").otherwise(F.array_join(usable, ", "))),
        )
        .when(F.col("predictor_sd") < min_spread, F.lit(f"the predictor {predictor} does not vary"))
    )
    return row.select("n_groups", "response_sd", "predictor_sd", reason.isNull().alias("fittable"), reason.alias("reason"))


# --- run checks on recorded episodes ---


def ceiling_check(df: DataFrame, threshold: float, condition: Column) -> DataFrame:
    """Worst mapping under a perfect decoder against a threshold."""
    per = df.where(condition).groupBy("mapping").agg(F.avg("success_rate").alias("v"))
    worst = F.min_by("mapping", F.struct("v", "mapping"))
    return per.agg(worst.alias("worst_mapping"), F.min("v").alias("value")).select(
        F.lit("ceiling").alias("check"), "worst_mapping", "value", F.lit(threshold).alias("threshold"), (F.col("value") >= threshold).alias("passed")
    )


def floor_check(df: DataFrame, threshold: float, condition: Column) -> DataFrame:
    """Success at chance level must stay below a threshold."""
    v = df.where(condition).agg(F.avg("success_rate").alias("value"))
    return v.select(
        F.lit("floor").alias("check"), F.lit(None).cast("string").alias("worst_mapping"), "value", F.lit(threshold).alias("threshold"),
        (F.col("value") <= threshold).alias("passed"),
    )


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.bool_and("passed").alias("all_passed"))


def conditions_equal(df: DataFrame, keys: Sequence[str], first: Column, second: Column, metrics: Sequence[str]) -> DataFrame:
    """Largest difference between two conditions over their shared keys; equal means exactly zero.

    Both conditions are averaged side by side in one aggregate, so no self-join is needed.
    """
    side = [F.avg(F.when(c, F.col(m))).alias(f"_{t}_{m}") for m in metrics for t, c in (("a", first), ("b", second))]
    per = df.where(first | second).groupBy(*keys).agg(*side, F.bool_or(first).alias("_ha"), F.bool_or(second).alias("_hb"))
    shared = per.where(F.col("_ha") & F.col("_hb"))
    diffs = [F.max(F.abs(F.col(f"_a_{m}") - F.col(f"_b_{m}"))).alias(m) for m in metrics]
    out = shared.agg(F.count(F.lit(1)).alias("n_keys"), *diffs)
    worst = F.greatest(*[F.col(m) for m in metrics]) if len(metrics) > 1 else F.col(metrics[0])
    return out.select("n_keys", worst.alias("max_abs_diff"), (worst == 0).alias("passed"))
