"""Trial, posterior, outcome, trace, sample and episode tables read from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.functions import vectors as V
from kymora.operators import series


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: str):
    """Timestamp as seconds since the epoch, with the fraction kept."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """One row per window: a four-class posterior from the first four embedding entries."""
    e = read(spark, folder, "embeddings")
    burst = F.floor(F.col("vec_id") / 7)
    label = (burst % 4).cast("int")
    scores = F.array(
        *[
            F.exp(F.col("embedding")[i].cast("double") * 6 + F.when(F.col("label") == i, 0.6).otherwise(0.0))
            for i in range(4)
        ]
    )
    base = e.select(
        F.col("vec_id").alias("window_id"),
        (burst % 9 + 1).cast("int").alias("subject"),
        burst.cast("bigint").alias("burst_id"),
        (F.lit(2.0) + 0.25 * (F.col("vec_id") % 7)).cast("double").alias("t_rel"),
        label.alias("label"),
        "embedding",
    )
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return (
        base.withColumn("e", scores)
        .withColumn("posterior", V.as_float(F.transform("e", lambda v: v / total)))
        .select("window_id", "subject", "burst_id", "t_rel", "label", "posterior")
    )


def bursts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per burst with its onset and offset on the recording clock."""
    p = posteriors(spark, folder).select("burst_id", "subject", "label").distinct()
    onset = F.col("burst_id") * 8.0 + 3.0
    return p.withColumn("burst_onset", onset).withColumn("burst_offset", onset + 3.5)


def trials(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("trial_id"),
        (F.col("o_custkey") % 9 + 1).cast("int").alias("subject"),
        F.when(F.col("o_orderdate") < F.lit("1998-04-01").cast("timestamp_ntz"), "T").otherwise("E").alias("session"),
        (F.col("o_orderkey") % 6).cast("int").alias("run"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("class"),
        (F.col("o_orderkey") * 8.0).alias("onset_s"),
        (F.col("o_orderstatus") == "P").alias("artifact"),
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per target attempt (an order line)."""
    li = read(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("episode_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_partkey") % 8).cast("int").alias("target_idx"),
        (F.col("l_returnflag") != "R").alias("acquired"),
        F.col("l_quantity").alias("duration_s"),
        (F.col("l_extendedprice") / 10000.0).alias("path_length"),
        (F.col("l_extendedprice") / 10000.0 * (1 - F.col("l_discount"))).alias("straight_line"),
        F.round(F.col("l_tax") * 100).cast("int").alias("collisions"),
    )


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """One row per step of an episode (a user's events in time order)."""
    ev = read(spark, folder, "events").select(
        "user_id",
        "event_id",
        "ts",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    indexed = series.dense_index(ev, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "i")
    heading = F.radians(F.col("k") * 3.6)
    intent = F.radians(((F.col("event_id") * 37) % 360).cast("double"))
    target = (
        F.when(F.col("event_type") == "click", 0)
        .when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(4)
    )
    return indexed.select(
        F.col("user_id").alias("episode_id"),
        "event_id",
        (F.col("i") + 1).alias("step"),
        target.alias("target_idx"),
        (F.col("value") / 100.0 * F.cos(heading)).alias("vx"),
        (F.col("value") / 100.0 * F.sin(heading)).alias("vy"),
        F.cos(intent).alias("ix"),
        F.sin(intent).alias("iy"),
        (F.col("event_type") != "error").alias("has_command"),
        (F.col("event_id") % 4 == 0).alias("decoder_update"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample of a (subject, channel) series."""
    ev = read(spark, folder, "events").select(
        (F.col("user_id") % 9 + 1).cast("int").alias("subject"),
        F.col("event_type").alias("channel"),
        "event_id",
        "ts",
        "value",
    )
    return series.dense_index(
        ev, ["subject", "channel"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "sample_idx"
    ).select("subject", "channel", "sample_idx", "ts", "value")


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per episode (an order that has lines): condition axes and two outcome metrics.

    Lines are counted per (order, duration) before they meet the orders, so the
    median works on durations with their counts, not on raw rows.
    """
    o = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    per_duration = (
        read(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_quantity")
        .agg(F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("n_ok"))
    )
    per_order = per_duration.groupBy("l_orderkey").agg(
        F.sum("n_ok").alias("n_ok"),
        F.percentile(F.when(F.col("n_ok") > 0, F.col("l_quantity")), 0.5, F.greatest("n_ok", F.lit(1))).alias("med"),
    )
    q = (F.col("o_orderkey") % 6).cast("double") / 5
    subject = (F.col("o_custkey") % 9 + 1).cast("int")
    return o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("episode_id"),
        subject.alias("subject"),
        F.col("o_orderpriority").alias("mapping"),
        F.col("o_orderstatus").alias("decoder"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 5).cast("double") / 4).alias("alpha"),
        q.alias("quality_level"),
        (F.lit(0.4) + 0.5 * (F.col("o_orderkey") % 6) / 5.0).alias("effective_acc"),
        (F.lit(0.35) + 0.04 * subject).alias("kappa_offline"),
        (F.least(F.col("n_ok"), F.lit(8)) / 8.0).alias("success_rate"),
        F.col("med").alias("time_to_target_median"),
    )


def scored_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episodes with the further axes and metrics that the report tables read."""
    i = F.col("episode_id")
    return episodes(spark, folder).select(
        "*",
        (i % 4 * 125).cast("int").alias("latency_ms"),
        (F.lit(0.25) + 0.5 * F.col("success_rate")).alias("command_accuracy"),
        (i % 4).cast("int").alias("bursts_without_command"),
        F.when(i % 2 == 0, "aware").otherwise("blind").alias("intent_mode"),
        (F.lit(1.0) - F.coalesce("alpha", F.lit(0.0)) * 0.8 + 0.01 * (i % 7)).alias("user_contribution_index"),
        (i % 3 + 1).cast("double").alias("window_s"),
        F.when(i % 7 == 0, "stitched").otherwise("burst").alias("protocol"),
        F.when(i % 3 == 0, "smoothing").when(i % 3 == 1, "jitter").otherwise("burst").alias("error_struct"),
    )
