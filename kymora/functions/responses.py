"""Scalar transforms used before model fits and in metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("identity", "logit", "log")


def half_count_logit(value: Column, n_trials: int) -> Column:
    """Logit of a proportion out of ``n_trials``, moved off 0 and 1 by half a count."""
    if n_trials < 1:
        raise ValueError("n_trials must be at least 1")
    q = (value * float(n_trials) + 0.5) / float(n_trials + 1)
    return F.log(q / (1.0 - q))


def in_domain(value: Column, kind: str) -> Column:
    if kind == "logit":
        return (value >= 0) & (value <= 1)
    if kind == "log":
        return value > 0
    if kind == "identity":
        return F.lit(True)
    raise ValueError(f"unknown transform {kind!r}, expected one of {TRANSFORMS}")


def transformed(value: Column, kind: str, n_trials: int) -> Column:
    """Response on the fitting scale; null where it is outside the domain."""
    ok = in_domain(value, kind)
    body = {"logit": lambda: half_count_logit(value, n_trials), "log": lambda: F.log(value), "identity": lambda: value}
    return F.when(ok, body[kind]())


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def information_rate(rate: Column, n_targets: int, duration_s: Column) -> Column:
    """Bits per minute of ``n_targets`` selections made with success ``rate``.

    Zero at or below chance, ``log2 N`` per selection for a perfect rate, null
    for an episode without duration.
    """
    if n_targets < 2:
        raise ValueError("n_targets must be at least 2")
    n = float(n_targets)
    top = math.log2(n)
    partial = F.lit(top) + rate * F.log2(rate) + (1.0 - rate) * F.log2((1.0 - rate) / (n - 1.0))
    bits = F.when(rate <= 1.0 / n, 0.0).when(rate == 1.0, F.lit(top)).otherwise(partial)
    return F.when(duration_s > 0, F.greatest(bits, F.lit(0.0)) * (F.lit(n * 60.0) / duration_s))
