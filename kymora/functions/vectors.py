"""Column expressions on probability arrays and on 2-D vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOTION_EPS = 1e-9
ENTROPY_EPS = 1e-12
ROW_SUM_TOL = 1e-5


def argmax_class(p: Column) -> Column:
    """Index of the largest entry; the lowest index wins a tie."""
    return (F.array_position(p, F.array_max(p)) - F.lit(1)).cast("int")


def one_hot(label: Column, k: int) -> Column:
    return F.array(*[F.when(label == i, 1.0).otherwise(0.0) for i in range(k)])


def row_sum(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def as_float(p: Column) -> Column:
    return p.cast("array<float>")


def is_distribution(p: Column) -> Column:
    """Finite, non-negative and summing to one within tolerance."""
    bad = F.exists(
        p,
        lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")),
    )
    return F.coalesce(~bad & (F.abs(row_sum(p) - 1.0) <= ROW_SUM_TOL), F.lit(False))


def normalised_entropy(p: Column) -> Column:
    """Shannon entropy over ``ln K``: 0 for certain, 1 for uniform."""
    h = F.aggregate(
        p,
        F.lit(0.0),
        lambda acc, v: acc
        - F.when(v > ENTROPY_EPS, v.cast("double") * F.log(v.cast("double"))).otherwise(0.0),
    )
    return F.when(F.size(p) < 2, 0.0).otherwise(h / F.log(F.size(p).cast("double")))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def weighted_sum(p: Column, weights: Sequence[float] | Column) -> Column:
    """Dot product of an array column with constants or with another array."""
    w = weights if isinstance(weights, Column) else F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(
        F.zip_with(p, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v
    )


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def has_direction(x: Column, y: Column, eps: float = MOTION_EPS) -> Column:
    return hypot(x, y) > eps


def unit(x: Column, y: Column, eps: float = MOTION_EPS) -> tuple[Column, Column]:
    """Unit vector, zero where the norm does not exceed ``eps``."""
    n = hypot(x, y)
    return (
        F.when(n > eps, x / n).otherwise(0.0),
        F.when(n > eps, y / n).otherwise(0.0),
    )


def clip_to(x: Column, y: Column, limit: float) -> tuple[Column, Column]:
    """Shorten a vector to ``limit`` and keep its heading."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    n = hypot(x, y)
    s = F.when(n > limit, F.lit(limit) / n).otherwise(1.0)
    return x * s, y * s


def best_aligned(x: Column, y: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Row of a small fixed direction table with the largest dot product.

    The lowest row wins a tie.  The table is a handful of constants, so it is
    folded into the expression instead of being joined.
    """
    dots = F.array(*[x * F.lit(dx) + y * F.lit(dy) for dx, dy in table])
    return argmax_class(dots)


def ring(n: int, radius: float = 1.0) -> list[tuple[float, float]]:
    """``n`` points on a circle, the first at angle zero."""
    if n < 1 or radius <= 0:
        raise ValueError("a ring needs at least one point and a positive radius")
    return [(radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n)) for i in range(n)]


def ring_position(index: Column, n: int, radius: float = 1.0) -> tuple[Column, Column]:
    """Same ring as a column expression over a target index."""
    angle = index.cast("double") * F.lit(2.0 * math.pi / n)
    return F.lit(radius) * F.cos(angle), F.lit(radius) * F.sin(angle)


def pick_const(index: Column, values: Sequence[float]) -> Column:
    """Constant lookup by a zero-based index; null for a null index.

    The index is tested here: a lookup in an array of constants is taken to be
    never null, whatever its index is.
    """
    found = F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))
    return F.when(index.isNotNull(), found)


def rounded(c: Column, places: int = 6) -> Column:
    """Round for output; a negative zero becomes plain zero, NaN becomes null."""
    c = c.cast("double")
    return F.when(F.isnan(c), None).otherwise(F.round(c, places) + F.lit(0.0))
