"""Names: classes, replay variants, runs, and display labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event codes and class names in class order.
EVENT_CODES = {769: 0, 770: 1, 771: 2, 772: 3}
CLASS_NAMES = ("left_hand", "right_hand", "feet", "tongue")
TRAIN_SESSION, TEST_SESSION = "T", "E"

# Display names.
MAPPING_LABELS = {
    "s1_argmax": "S1 argmax",
    "s2_weighted": "S2 weighted",
    "s2_weighted_entropy": "S2 weighted + entropy",
    "s3_evidence": "S3 evidence",
    "s4_shared": "S4 shared",
}
DECODER_LABELS = {"fbcsp": "FBCSP", "riemann": "Riemannian", "eegnet": "EEGNet", "synthetic": "synthetic"}
METRIC_LABELS = {
    "success_rate": "success rate",
    "effective_acc": "posterior accuracy",
    "kappa_offline": "offline $\\kappa$",
    "path_efficiency": "path efficiency",
    "time_to_target_median": "median time to target (s)",
    "direction_reversals": "direction reversals per target",
    "effective_itr": "effective ITR (bits/min)",
    "user_contribution_index": "user contribution index",
    "bursts_without_command": "bursts with no command",
    "command_accuracy": "command accuracy",
    "latency_ms": "feedback latency (ms)",
    "window_s": "decoding window (s)",
    "alpha": "autonomy level $\\alpha$",
    "quality_level": "quality level",
}


def lookup(key: Column, table: dict) -> Column:
    """Constant dictionary as a map literal: a small dimension needs no join."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def class_of_code(code: Column) -> Column:
    return lookup(code.cast("int"), EVENT_CODES)


def class_of_name(name: Column) -> Column:
    return lookup(name, {n: i for i, n in enumerate(CLASS_NAMES)})


def class_name(index: Column) -> Column:
    """Name of a class, null outside the table."""
    return lookup(index.cast("int"), dict(enumerate(CLASS_NAMES)))


def mapping_label(name: Column) -> Column:
    return F.coalesce(lookup(name, MAPPING_LABELS), F.lit("unknown"))


def decoder_label(name: Column) -> Column:
    return F.coalesce(lookup(name, DECODER_LABELS), name)


def metric_label(name: Column) -> Column:
    """Axis label, or the raw column name when there is none."""
    return F.coalesce(lookup(name, METRIC_LABELS), name)


def variant_key(protocol: Column, window_s: Column) -> Column:
    return F.concat(protocol, F.lit("_w"), F.bround(window_s * 1000.0).cast("bigint").cast("string"))


def run_id(at: Column, config_hash: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), config_hash)


def joined_text(values: Column) -> Column:
    """An integer array as comma-separated text."""
    return F.array_join(values.cast("array<string>"), ",")
