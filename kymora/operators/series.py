"""Ordered work on long series, without putting a whole series in one task.

A series is cut into buckets (by sample number or by time).  The sort runs per
(series, bucket); one small row per bucket carries what later buckets need to
know.  A series that holds a third of all rows therefore spreads over as many
tasks as it has buckets.  Series keys must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.session import stored

CHUNK_ROWS = 65536


def row_bucket(idx: str, rows: int = CHUNK_ROWS) -> Column:
    """Bucket of a dense row number: never more than ``rows`` rows each."""
    return F.floor(F.col(idx) / rows)


def time_bucket(seconds: str, width: float = 60.0) -> Column:
    """Bucket of a clock in seconds: bounded by sampling rate times width."""
    return F.floor(F.col(seconds) / width)


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, name: str) -> DataFrame:
    """Zero-based position of every row in its series.

    ``bucket`` must not decrease along ``order``.  Rows are numbered inside each
    bucket and shifted by the row count of the buckets before it.
    """
    keys = list(keys)
    cut = df.withColumn("_db", bucket)
    counts = cut.groupBy(*keys, "_db").agg(F.count(F.lit(1)).alias("_dn"))
    earlier = Window.partitionBy(*keys).orderBy("_db").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_db", F.coalesce(F.sum("_dn").over(earlier), F.lit(0)).alias("_doff"))
    inside = Window.partitionBy(*keys, "_db").orderBy(*order)
    return (
        cut.withColumn("_di", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_db"])
        .withColumn(name, (F.col("_di") + F.col("_doff")).cast("bigint"))
        .drop("_db", "_di", "_doff")
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    outputs: dict[str, tuple[str, Column]],
    include_current: bool = False,
) -> DataFrame:
    """Running values along a series.

    ``outputs`` maps a new column to ``(how, value)`` with ``how`` one of
    ``last`` (latest non-null value), ``max`` and ``sum``.  Each covers the rows
    before the current one, or up to it with ``include_current``.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn("_b", bucket)
    for name, (_, value) in outputs.items():
        cut = cut.withColumn(f"_v_{name}", value)
    position = F.struct(*order)
    totals, carried, local = [], [], {}
    upto = 0 if include_current else -1
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for name, (how, _) in outputs.items():
        v, s = F.col(f"_v_{name}"), F.col(f"_s_{name}")
        if how == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_s_{name}"))
            carried.append(F.last(s, ignorenulls=True).over(earlier).alias(f"_c_{name}"))
            local[name] = F.last(v, ignorenulls=True).over(inside)
        elif how == "max":
            totals.append(F.max(v).alias(f"_s_{name}"))
            carried.append(F.max(s).over(earlier).alias(f"_c_{name}"))
            local[name] = F.max(v).over(inside)
        elif how == "sum":
            totals.append(F.sum(v).alias(f"_s_{name}"))
            carried.append(F.sum(s).over(earlier).alias(f"_c_{name}"))
            local[name] = F.sum(v).over(inside)
        else:
            raise ValueError(f"unknown scan {how!r}")
    summary = cut.groupBy(*keys, "_b").agg(*totals).select(*keys, "_b", *carried)
    out = cut.select("*", *[c.alias(f"_l_{n}") for n, c in local.items()]).join(summary, [*keys, "_b"])
    for name, (how, _) in outputs.items():
        inner, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if how == "last":
            merged = F.coalesce(inner, before)
        elif how == "max":
            merged = F.greatest(inner, before)
        else:
            merged = F.coalesce(inner, F.lit(0)) + F.coalesce(before, F.lit(0))
        out = out.withColumn(name, merged)
    helpers = ["_b"] + [f"{p}{n}" for n in outputs for p in ("_v_", "_l_", "_c_")]
    return out.drop(*helpers)


def lagged(
    df: DataFrame, keys: Sequence[str], idx: str, outputs: dict[str, Column], first: int = 0, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Values of the row before, on a dense series.

    The last row of every bucket is also sent to the next one, so a bucket can
    answer for itself: one shuffle, no join and no second read.
    """
    at = F.col(idx) - first
    own = F.floor(at / rows)
    names = list(outputs)
    cut = df.select("*", *[c.alias(f"_v_{n}") for n, c in outputs.items()]).withColumn(
        "_b", F.explode(F.when((at + 1) % rows == 0, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    w = Window.partitionBy(*keys, "_b").orderBy(idx)
    out = cut.select("*", *[F.lag(f"_v_{n}").over(w).alias(n) for n in names]).where(F.col("_b") == own)
    return out.drop("_b", *[f"_v_{n}" for n in names])


def ewm_mean(df: DataFrame, keys: Sequence[str], idx: str, value: Column, alpha: float, name: str) -> DataFrame:
    """Bias-adjusted exponentially weighted mean over a dense series.

    Chunks are long enough that a value fades by 1e-4 across one, so six chunks
    of history reach below double precision; everything stays in windowed sums.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    keys = list(keys)
    if alpha == 1.0:
        return df.withColumn(name, value)
    d = 1.0 - alpha
    rows = max(4, math.ceil(math.log(1e4) / -math.log(d)))
    reach = max(1, math.ceil(46.0 / (rows * -math.log(d))))
    cut = df.withColumn("_b", F.floor(F.col(idx) / rows)).withColumn("_v", value)
    offset = F.col(idx) - F.col("_b") * rows
    powd = lambda e: F.pow(F.lit(d), e.cast("double"))
    ends = cut.groupBy(*keys, "_b").agg(F.sum(F.col("_v") * powd(F.lit(rows - 1) - offset)).alias("_e"))
    by_chunk = Window.partitionBy(*keys).orderBy("_b")
    history = F.lit(0.0)
    for k in range(1, reach + 1):
        gap = F.col("_b") - F.lag("_b", k).over(by_chunk)
        history = history + F.coalesce(F.lag("_e", k).over(by_chunk) * powd((gap - 1) * rows), F.lit(0.0))
    ends = ends.select(*keys, "_b", history.alias("_h"))
    inside = Window.partitionBy(*keys, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.col("_v") * powd(-offset)).over(inside) * powd(offset)
    weight = (1.0 - powd(F.col(idx) + 1)) / F.lit(alpha)
    return (
        cut.withColumn("_l", local)
        .join(ends, [*keys, "_b"])
        .withColumn(name, (F.col("_l") + F.col("_h") * powd(offset + 1)) / weight)
        .drop("_b", "_v", "_l", "_h")
    )


def moving_standardise(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, alpha: float, block: int, eps: float, name: str
) -> DataFrame:
    """Causal standardisation; the first ``block`` samples use their own mean and spread.

    The running mean is stored here, as the variance is built on top of it.
    """
    if block < 0 or eps <= 0:
        raise ValueError("block must not be negative and eps must be positive")
    keys = list(keys)
    mean = ewm_mean(df, keys, idx, F.col(value), alpha, "_m").withColumn("_dev", F.col(value) - F.col("_m"))
    # Read twice by the variance: stored once instead of being worked out twice.
    mean = stored(mean)
    both = ewm_mean(mean, keys, idx, F.col("_dev") * F.col("_dev"), alpha, "_var")
    score = F.col("_dev") / F.greatest(F.lit(eps), F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))))
    if block > 0:
        head = (
            df.where(F.col(idx) < block)
            .groupBy(*keys)
            .agg(F.avg(value).alias("_hm"), F.stddev_pop(value).alias("_hs"))
        )
        both = both.join(head, keys)
        first = (F.col(value) - F.col("_hm")) / F.greatest(F.lit(eps), F.col("_hs"))
        score = F.when(F.col(idx) < block, first).otherwise(score)
    return both.withColumn(name, score.cast("float")).drop("_m", "_dev", "_var", "_hm", "_hs")


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    inputs: Sequence[str],
    state_size: int,
    out_fields: Sequence[tuple[str, T.DataType]],
    step: Callable[[list[float], tuple], tuple[list[float], tuple]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Carry a small numeric state along every series, row by row, in order.

    Each (series, chunk) streams through one task as Arrow batches; only the
    state is held.  Chunks of one series first start from the zero state, and
    those whose predecessor ended elsewhere run again until no start changes,
    so the result is the sequential one while long series use many tasks.
    The chunk table is evaluated here (one small row per chunk).
    """
    keys, inputs = list(keys), list(inputs)
    ident = [*keys, "_c"]
    zero = [0.0] * state_size
    base = df.withColumn("_c", F.floor(F.col(idx) / chunk_rows).cast("bigint"))
    key_fields = [base.schema[k] for k in ident]
    state_type = T.ArrayType(T.DoubleType())

    def runner(columns: list[str], emit_rows: bool):
        n_in = len(inputs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, state = None, list(zero)
            for pdf in batches:
                ids = list(zip(*[pdf[c] for c in ident], strict=True))
                cols = list(zip(*[pdf[c] for c in inputs], strict=True))
                starts = pdf["_start"].tolist() if len(pdf) else []
                rows, ended = [], []
                for i, ident_i in enumerate(ids):
                    if ident_i != current:
                        if current is not None and not emit_rows:
                            ended.append((*current, list(state)))
                        current, state = ident_i, [float(x) for x in starts[i]]
                    state, out = step(state, cols[i][:n_in])
                    if emit_rows:
                        rows.append(out)
                if emit_rows:
                    if rows:
                        made = pd.DataFrame(rows, columns=[n for n, _ in out_fields])
                        kept = pdf[columns].reset_index(drop=True)
                        yield pd.concat([kept, made], axis=1)
                elif ended:
                    yield pd.DataFrame(ended, columns=[*ident, "_end"])
            if not emit_rows and current is not None:
                yield pd.DataFrame([(*current, list(state))], columns=[*ident, "_end"])

        return run

    def arranged(data: DataFrame) -> DataFrame:
        return data.repartition(*[F.col(k) for k in ident]).sortWithinPartitions(*ident, idx)

    plain = base.columns
    start_zero = F.array(*[F.lit(0.0)] * state_size)
    out_schema = T.StructType(
        [*[base.schema[c] for c in plain], *[T.StructField(name, kind) for name, kind in out_fields]]
    )

    end_schema = T.StructType([*key_fields, T.StructField("_end", state_type)])
    by_chunk = Window.partitionBy(*keys).orderBy("_c")

    def ends_of(data: DataFrame) -> DataFrame:
        return arranged(data).mapInPandas(runner(plain, False), end_schema)

    table = stored(ends_of(base.withColumn("_start", start_zero)).withColumn("_start", start_zero))
    while True:
        # A first chunk starts at zero; any other where its predecessor ended.
        due = F.coalesce(F.lag("_end").over(by_chunk), start_zero)
        wanted = table.withColumn("_due", due)
        changed = wanted.where(F.col("_due") != F.col("_start"))
        if changed.limit(1).count() == 0:
            break
        again = base.join(changed.select(*ident, F.col("_due").alias("_start")), ident)
        redone = ends_of(again).join(changed.select(*ident, F.col("_due").alias("_start")), ident)
        table = stored(
            table.join(changed.select(*ident), ident, "left_anti").unionByName(redone.select(table.columns))
        )
    data = base.join(table.select(*ident, "_start"), ident)
    return arranged(data).mapInPandas(runner(plain, True), out_schema).drop("_c")
