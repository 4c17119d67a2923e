"""Episode tables and experiment runs: fixed columns, publish, load, replace."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I8, I16, I32, F32 = T.StringType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.FloatType()

# Column names, order and types of an episode table.
EPISODE_COLUMNS = (
    ("experiment", S), ("run_id", S), ("subject", I8), ("decoder", S), ("mapping", S), ("quality_level", F32),
    ("lam", F32), ("alpha", F32), ("window_s", F32), ("stride_s", F32), ("latency_ms", I16), ("protocol", S),
    ("error_struct", S), ("intent_mode", S), ("seed", I32), ("direction_perm", S), ("kappa_offline", F32),
    ("effective_acc", F32), ("command_accuracy", F32), ("success_rate", F32), ("n_success", I8),
    ("time_to_target_median", F32), ("n_timeouts", I8), ("path_efficiency", F32), ("direction_reversals", F32),
    ("collisions", I16), ("effective_itr", F32), ("user_contribution_index", F32), ("uci_excluded_frac", F32),
    ("bursts_without_command", I16), ("episode_duration_s", F32), ("wall_time_s", F32),
)
EPISODES = T.StructType([T.StructField(n, t) for n, t in EPISODE_COLUMNS])


def schema_problems(columns: list[str]) -> dict[str, list[str]]:
    """Missing and extra columns, and whether the order differs; empty when exact."""
    want = EPISODES.names
    if columns == want:
        return {}
    return {
        "missing": sorted(set(want) - set(columns)),
        "extra": sorted(set(columns) - set(want)),
        "reordered": [] if set(want) != set(columns) else [c for c, w in zip(columns, want, strict=True) if c != w],
    }


def validate_schema(df: DataFrame) -> DataFrame:
    found = schema_problems(df.columns)
    if found:
        raise ValueError(f"episode columns differ from the contract: {found}")
    return df


def episode_frame(cells: DataFrame, variants: DataFrame, missing: str = "refuse") -> DataFrame:
    """Episode table in contract order; window and stride come from the cell's replay variant.

    Columns the input does not carry are null.  NaN becomes null.  Cells whose variant
    is not described are refused, with the variants named; with ``missing="keep"`` they
    stay, with a null window and stride.
    """
    if missing not in ("refuse", "keep"):
        raise ValueError("missing must be 'refuse' or 'keep'")
    if missing == "refuse":
        unknown = cells.join(variants.select("variant"), "variant", "left_anti").select("variant").distinct().limit(5).collect()
        if unknown:
            raise ValueError(f"no replay variant describes {sorted(str(r['variant']) for r in unknown)}")
    joined = cells.drop("window_s", "stride_s").join(variants.select("variant", "window_s", "stride_s"), "variant", "left")
    have = set(joined.columns)

    def typed(name, kind):
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name).cast(kind)
        return (F.when(F.isnan(c), None).otherwise(c) if kind == F32 else c).alias(name)

    return validate_schema(joined.select(*[typed(n, t) for n, t in EPISODE_COLUMNS]))


def meta_block(episodes: DataFrame, seed: int, synthetic: bool, n_boot: int = 1000, ci: float = 0.95, min_subjects: int = 3) -> DataFrame:
    """One row per run: number of episodes and the settings the intervals came from."""
    return episodes.groupBy("experiment", "run_id").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.sum("wall_time_s").alias("wall_time_s"),
    ).select(
        "*", F.lit(n_boot).alias("n_boot"), F.lit(ci).alias("ci"), F.lit(min_subjects).alias("min_subjects"),
        F.lit("subjects").alias("resampled"), F.lit(seed).alias("seed"), F.lit(synthetic).alias("synthetic"),
    )


PARTS = ("episodes", "summary", "config")


def _published(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def write_run(episodes: DataFrame, summary: DataFrame, config: DataFrame, path: str) -> None:
    """Publish runs: three tables by (experiment, run_id), then one manifest row per run.

    The manifest is written last and readers start from it, so a run is either
    wholly there or not at all.  A publish that broke off can be repeated: it
    replaces its own folders.  A run that is already published is refused.
    """
    validate_schema(episodes)
    keys = ["experiment", "run_id"]
    spark = episodes.sparkSession
    before = _published(spark, path)
    if before is not None and episodes.join(before, keys, "left_semi").limit(1).count():
        raise FileExistsError(f"{path} already holds one of these runs")
    for name, part in zip(PARTS, (episodes, summary, config), strict=True):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{name}")
    written = spark.read.schema(EPISODES).parquet(f"{path}/episodes")  # the manifest counts what is there
    if before is not None:
        written = written.join(before, keys, "left_anti")
    done = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_episodes"))
    done.write.mode("append").parquet(f"{path}/manifest")


def load_run(spark: SparkSession, path: str, experiment: str | None = None) -> dict[str, DataFrame]:
    """Published runs; a table that is missing is an error that names it."""
    out = {}
    for name in (*PARTS, "manifest"):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            raise FileNotFoundError(f"{path} has no {name}; is it a run folder?") from error
    manifest = out["manifest"] if experiment is None else out["manifest"].where(F.col("experiment") == experiment)
    keys = manifest.select("experiment", "run_id")
    for name in PARTS:
        out[name] = out[name].join(keys, ["experiment", "run_id"], "left_semi")
    out["episodes"] = validate_schema(out["episodes"].select(*[c for c in EPISODES.names if c in out["episodes"].columns]))
    out["manifest"] = manifest
    return out


def write_summary(spark: SparkSession, summary: DataFrame, path: str, force: bool = False) -> None:
    """Replace the summary of the runs in ``summary``; other runs stay as they are."""
    target = f"{path}/summary"
    try:
        existing = None if force else spark.read.parquet(target).select("experiment", "run_id")
    except AnalysisException:  # no summary yet
        existing = None
    if existing is not None:
        clash = summary.select("experiment", "run_id").join(existing, ["experiment", "run_id"], "left_semi")
        if clash.limit(1).count():
            raise FileExistsError("a summary exists for these runs; pass force=True to replace it")
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "run_id").parquet(target)
