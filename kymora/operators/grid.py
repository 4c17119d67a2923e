"""Experiment grids: enumeration, replay variants, dataset addresses, keys."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kymora.functions import hashing as H
from kymora.functions import naming as N
from kymora.operators import series

# Grid axes in the order the product is taken, with the cell column each one fills.
AXES = (
    ("subjects", "subject", "int"), ("decoders", "decoder", "string"), ("mappings", "mapping", "string"),
    ("quality_levels", "quality_level", "double"), ("protocols", "protocol", "string"), ("windows_s", "window_s", "double"),
    ("error_structures", "error_struct", "string"), ("intent_modes", "intent_mode", "string"), ("alphas", "alpha", "double"),
    ("latencies_ms", "latency_ms", "int"),
)
CELL_FIELDS = (
    "experiment", "subject", "decoder", "mapping", "quality_level", "protocol", "window_s", "error_struct", "intent_mode",
    "alpha", "latency_ms", "seed",
)


def enumerate_cells(spark: SparkSession, experiment: str, axes: Mapping[str, Sequence], seeds: int) -> DataFrame:
    """Every combination of the axes and seeds, numbered in grid order.

    The cell number is read as a mixed-radix number whose digits index the
    axes, so the product is a generated range and not a join.
    """
    missing = [name for name, _, _ in AXES if name not in axes]
    if missing:
        raise KeyError(f"the grid has no {missing[0]!r} axis; every axis must be stated")
    radix = [len(axes[name]) for name, _, _ in AXES] + [seeds]
    cells = spark.range(math.prod(radix)).withColumnRenamed("id", "cell_idx")
    columns, stride = [], math.prod(radix)
    for (name, column, kind), n in zip(AXES, radix[:-1], strict=True):
        stride //= n
        digit = (F.floor(F.col("cell_idx") / stride) % n).cast("int")
        values = F.array(*[F.lit(v).cast(kind) for v in axes[name]])
        columns.append(F.get(values, digit).alias(column))
    return cells.select(
        "cell_idx", F.lit(experiment).alias("experiment"), *columns, (F.col("cell_idx") % seeds).cast("int").alias("seed")
    )


def in_grid_order(results: DataFrame) -> DataFrame:
    return results.orderBy("cell_idx")


def cell_key(columns: Mapping[str, Column] | None = None) -> Column:
    """Identity of a cell: all twelve fields, doubles as whole millionths, nulls spelled out."""
    col = lambda f: (columns or {}).get(f, F.col(f))
    parts = [H.micro(col(f)) if f in ("quality_level", "window_s", "alpha") else col(f) for f in CELL_FIELDS]
    return H.key_text(*parts)


MILLION = 1_000_000


def duplicate_keys(cells: DataFrame, key: Column) -> DataFrame:
    return cells.groupBy(key.alias("cell_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def variant_table(spark: SparkSession, variants: Mapping[str, Mapping]) -> DataFrame:
    """Replay variants as rows; an entry filed under a key that is not its own is refused."""
    rows = []
    for key, v in variants.items():
        own = f"{v['protocol']}_w{round(float(v['window_s']) * 1000)}"
        if key != own:
            raise ValueError(f"variant {key!r} describes {own!r}")
        rows.append((key, v["protocol"], float(v["window_s"]), float(v["stride_s"]), float(v["gap_s"]), dict(v["hashes"])))
    schema = "variant string, protocol string, window_s double, stride_s double, gap_s double, hashes map<string,string>"
    return spark.createDataFrame(rows, schema)


def with_variant(cells: DataFrame) -> DataFrame:
    return cells.withColumn("variant", N.variant_key(F.col("protocol"), F.col("window_s")))


def unreachable(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """Cells that name a replay condition the configuration does not describe."""
    return with_variant(cells).join(variants.select("variant"), "variant", "left_anti")


def dataset_address(cells: DataFrame, variants: DataFrame) -> DataFrame:
    """Dataset hash of each cell, with a status that tells an absent decoder from an empty hash."""
    hashes = variants.select("variant", "hashes")
    joined = with_variant(cells).join(hashes, "variant", "left")
    listed = F.map_contains_key("hashes", F.col("decoder"))
    status = (
        F.when(F.col("hashes").isNull(), "no variant")
        .when(~listed, "decoder not listed")
        .when(F.col("hashes")[F.col("decoder")].isNull(), "hash is empty")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).withColumn("posterior_hash", F.col("hashes")[F.col("decoder")]).drop("hashes")


def pick_runs(runs: DataFrame, preferred: DataFrame) -> DataFrame:
    """One run per figure: the first preferred experiment that exists, else the earliest run.

    ``runs`` has ``experiment, run_id, given`` (order of arrival); the first of
    two runs with one name wins.  ``preferred`` has ``figure, experiment, rank``.
    """
    first = runs.groupBy("experiment").agg(F.min_by("run_id", "given").alias("run_id"), F.min("given").alias("given"))
    earliest = runs.agg(F.min_by(F.struct("experiment", "run_id"), "given").alias("any_run"))
    best = preferred.join(first, "experiment", "left").groupBy("figure").agg(
        F.min_by(F.struct("experiment", "run_id"), F.when(F.col("run_id").isNotNull(), F.col("rank"))).alias("chosen")
    )
    fallback = earliest.select("any_run").scalar()
    picked = F.coalesce(F.col("chosen"), fallback)
    return best.select("figure", picked["experiment"].alias("experiment"), picked["run_id"].alias("run_id"))


def permuted_classes(n: int, *key) -> Column:
    """Permutation of ``0..n-1`` drawn from content, as an integer array."""
    pairs = F.array(*[F.struct(F.md5(H.key_text(*key, k)).alias("h"), F.lit(k).alias("k")) for k in range(n)])
    return F.transform(F.array_sort(pairs), lambda s: s["k"])


def is_permutation(values: Column, n: int) -> Column:
    return F.array_sort(values) == F.array(*[F.lit(i) for i in range(n)])


def whole_bands(low: float, high: float, width: float) -> tuple[int, int, int]:
    """First edge, last edge and width in whole millionths; refuses a range that does not split into whole bands."""
    first, last, step = (round(x * MILLION) for x in (low, high, width))
    if first <= 0 or step <= 0 or last <= first or (last - first) % step:
        raise ValueError(f"{low} to {high} is not a positive range of whole bands of {width}")
    return first, last, step


def band_table(spark: SparkSession, low: float, high: float, width: float) -> DataFrame:
    """(band, low, high): neighbouring bands from ``low`` to ``high``, numbered from 0."""
    first, last, step = whole_bands(low, high, width)
    edges = F.sequence(*[F.lit(x).cast("bigint") for x in (first, last - step, step)])
    rows = spark.range(1).select(F.posexplode(edges).alias("band", "_edge"))
    return rows.select("band", (F.col("_edge") / MILLION).alias("low"), ((F.col("_edge") + step) / MILLION).alias("high"))


def band_of(value: Column, low: float, high: float, width: float) -> Column:
    """Band number of a value, null outside the range."""
    whole_bands(low, high, width)
    return F.when((value >= low) & (value < high), F.floor((value - low) / width).cast("int"))


# --- draws without replacement ---

# Multipliers for the per-cycle reshuffle: primes above any pool size in use.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)


def draw_bursts(requests: DataFrame, pool: DataFrame, seed: int, episode: str = "episode_id", order: str = "step") -> DataFrame:
    """Bursts for the requested classes: each one once per cycle, reshuffled when used up.

    ``requests`` has ``episode, subject, class`` and a dense ``order``; ``pool``
    has ``subject, burst_id, label``.  The pool is put in a hashed order once.
    A cycle visits it through a keyed permutation (multiplier and offset drawn
    from the episode, class and cycle), so a request finds its burst with one
    equi-join and the pool is never unfolded per episode.  Requests for a class
    without bursts come back with a null ``burst_id``.
    """
    from kymora.sources.synthetic import shuffled_index

    shelves = shuffled_index(pool.withColumnRenamed("label", "class"), ["subject", "class"], seed, "pool", "burst_id", "_slot")
    sizes = shelves.groupBy("subject", "class").agg(F.count(F.lit(1)).alias("_n"))
    numbered = series.dense_index(requests, [episode, "class"], [order], series.row_bucket(order), "_k")
    sized = numbered.join(sizes, ["subject", "class"], "left").withColumn("cycle", F.floor(F.col("_k") / F.col("_n")))
    ident = (F.col(episode), F.col("class"), F.col("cycle"))
    prime = F.get(F.array(*[F.lit(p) for p in PRIMES]), H.draw_index(len(PRIMES), seed, "multiplier", *ident))
    shift = F.floor(H.u01(seed, "offset", *ident) * F.col("_n")).cast("bigint")
    slot = (F.col("_k") % F.col("_n") * (prime % F.col("_n")) + shift) % F.col("_n")
    return (
        sized.withColumn("_slot", slot)
        .join(shelves.select("subject", "class", "_slot", "burst_id"), ["subject", "class", "_slot"], "left")
        .drop("_slot", "_k", "_n")
    )


def unmatched_classes(requests: DataFrame, pool: DataFrame) -> DataFrame:
    """Requested (subject, class) pairs without any burst."""
    have = pool.select("subject", F.col("label").alias("class")).distinct()
    return requests.groupBy("subject", "class").agg(F.count(F.lit(1)).alias("n_requests")).join(have, ["subject", "class"], "left_anti")


# --- resampled subjects ---


def draw_subjects(rows: DataFrame, n_boot: int, seed: int, group: str = "subject") -> DataFrame:
    """Subjects drawn with replacement per replicate, one row per draw.

    A subject drawn twice gets two labels, so a model sees two groups.
    """
    levels = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    prefix = F.substring(F.md5(F.col(group).cast("string")), 1, 3)
    placed = series.dense_index(levels, [], [prefix, group], prefix, "copy").drop("_rows")
    n = levels.agg(F.count(F.lit(1))).scalar()
    slots = placed.select("copy", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("replicate")).withColumn(
        "_pick", F.floor(H.u01(seed, "resample", F.col("replicate"), F.col("copy")) * n)
    )
    source = placed.select(F.col("copy").alias("_pick"), group)
    return slots.join(source, "_pick").select(
        "replicate", "copy", group, F.concat(F.col(group).cast("string"), F.lit("_r"), F.col("copy").cast("string")).alias("resampled")
    )


def resample(rows: DataFrame, draws: DataFrame, group: str = "subject") -> DataFrame:
    return draws.join(rows, group)
