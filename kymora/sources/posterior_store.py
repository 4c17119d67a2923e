"""Posterior datasets: contract, checks, write, read and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.functions import vectors as V
from kymora.operators import posterior as P
from kymora.operators import series

CONTRACT = T.StructType(
    [
        T.StructField("window_id", T.LongType()),
        T.StructField("posterior", T.ArrayType(T.FloatType())),
        T.StructField("label", T.ByteType()),
        T.StructField("burst_id", T.IntegerType()),
        T.StructField("t_rel", T.FloatType()),
        T.StructField("burst_onset", T.FloatType()),
        T.StructField("burst_offset", T.FloatType()),
        T.StructField("boundary", T.BooleanType()),
    ]
)
ADDRESS_TYPES = T.StructType().add("decoder", "string").add("protocol", "string").add("window_ms", "integer").add("stride_ms", "integer").add("cfg_hash", "string").add("session", "string").add("subject", "integer")
ADDRESS = tuple(ADDRESS_TYPES.names)
STORED = T.StructType([*CONTRACT.fields, *ADDRESS_TYPES.fields])
RULES = ("not a distribution", "label out of range", "unknown burst", "burst ends before it starts", "time not increasing")


def row_problems(rows: DataFrame, n_classes: int = 4, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Rows that break a rule, one per (row, rule).

    ``window_id`` is the row order.  The running time per burst is carried over
    row buckets, so an oversized burst does not end up in one task.
    """
    p = F.col("posterior")
    run = series.scan(
        rows, [*keys, "burst_id"], ["window_id"], series.row_bucket("window_id"), {"_before": ("last", F.col("t_rel"))}
    )
    broken = F.array_compact(
        F.array(
            F.when(~V.is_distribution(p) | (F.size(p) != n_classes), RULES[0]),
            F.when((F.col("label") < 0) | (F.col("label") >= n_classes), RULES[1]),
            F.when(F.col("t_rel") <= F.col("_before"), RULES[4]),
        )
    )
    return run.select(*keys, "burst_id", "window_id", F.explode(broken).alias("rule"))


def burst_problems(rows: DataFrame, bursts: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Windows of bursts that are not in the burst table, and bursts that end before they start."""
    ids = [*keys, "burst_id"]
    stray = rows.join(bursts.select(*ids), ids, "left_anti").select(*ids, "window_id", F.lit(RULES[2]).alias("rule"))
    backward = bursts.where(F.col("burst_offset") < F.col("burst_onset")).select(
        *ids, F.lit(None).cast("bigint").alias("window_id"), F.lit(RULES[3]).alias("rule")
    )
    return stray.unionByName(backward)


def problems(rows: DataFrame, bursts: DataFrame, n_classes: int = 4, keys: Sequence[str] = ("subject",)) -> DataFrame:
    return row_problems(rows, n_classes, keys).unionByName(burst_problems(rows, bursts, keys))


def write_posteriors(
    rows: DataFrame, bursts: DataFrame, path: str, force: bool = False, n_classes: int = 4, subject: str = "subject"
) -> None:
    """Validate and write one dataset per address.

    An address that exists is refused, or replaced with ``force``; other addresses of
    the store stay as they are.  Files appear through the output committer, so readers
    never see half a write.
    """
    found = problems(rows, bursts, n_classes, [subject]).groupBy("rule").count().collect()  # at most five rows
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['count']}" for r in sorted(found)))
    shaped = rows.join(bursts.select(subject, "burst_id", "burst_onset", "burst_offset"), [subject, "burst_id"])
    out = shaped.select(*[F.col(f.name).cast(f.dataType) for f in STORED.fields])
    if not force:
        there = addresses(rows.sparkSession, path)
        clash = None if there is None else out.select(*ADDRESS).distinct().join(there, list(ADDRESS), "left_semi").limit(1).collect()
        if clash:
            raise FileExistsError(f"{path} already holds {clash[0].asDict()}")
    # one folder per address: dynamic overwrite touches only the addresses at hand
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ADDRESS).parquet(path)


def addresses(spark: SparkSession, path: str) -> DataFrame | None:
    """The addresses of a store (from its folders); None where there is none."""
    try:
        return spark.read.schema(STORED).parquet(path).select(*ADDRESS).distinct()
    except AnalysisException:
        return None


def read_posteriors(spark: SparkSession, path: str, validate: bool = False, n_classes: int = 4, **address) -> DataFrame:
    """Rows of the datasets that match ``address``; other folders are never opened.

    The types of the address are stated, so a hash of digits stays text.  With
    ``validate`` the rows are checked again as they were when written.
    """
    unknown = set(address) - set(ADDRESS)
    if unknown:
        raise KeyError(f"unknown address fields {sorted(unknown)}, expected some of {ADDRESS}")
    data = spark.read.parquet(path)
    have = {f.name: f.dataType for f in data.schema.fields}
    for f in CONTRACT.fields:
        if f.name not in have:
            raise KeyError(f"the dataset has no column {f.name}")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"{f.name} is {have[f.name].simpleString()}, expected {f.dataType.simpleString()}")
    data = spark.read.schema(STORED).parquet(path)
    for name, value in address.items():
        data = data.where(F.col(name) == value)
    if validate:
        spans = data.groupBy(*ADDRESS, "burst_id").agg(F.min("burst_onset").alias("burst_onset"), F.max("burst_offset").alias("burst_offset"))
        found = problems(data, spans, n_classes, ADDRESS).groupBy("rule").count().collect()  # at most five rows
        if found:
            raise ValueError("; ".join(f"{r['rule']}: {r['count']}" for r in sorted(found)))
    return data


def provenance(rows: DataFrame, train_session: str = "T") -> DataFrame:
    """One row per dataset: counts, boundary windows, window-level kappa, and whether it was fitted on."""
    cell = list(ADDRESS)
    counts = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.countDistinct("burst_id").alias("n_bursts"),
        F.count(F.when(F.col("boundary"), 1)).alias("boundary_windows"),
    )
    kappa = P.agreement(rows.withColumn("_pred", V.argmax_class(F.col("posterior"))), cell, "label", "_pred")
    return counts.join(kappa.select(*cell, F.col("kappa").alias("kappa_window")), cell).withColumn(
        "in_sample", F.col("session") == train_session
    )


def provenance_json(meta: DataFrame) -> DataFrame:
    """The same rows as one JSON text per dataset, keys in alphabetical order."""
    return meta.select(*ADDRESS, F.to_json(F.struct(*sorted(meta.columns)), {"ignoreNullFields": "false"}).alias("meta"))
