"""Spatial filters: directions across channels in which one class varies most, or least, against the rest.

Class covariances are averages of window covariances, summed with map-side combine; one
small eigenproblem per (key, class) follows.  The variance of a filtered window is a
quadratic form of its covariance, so samples are not read again to apply the filters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.operators.features import _square, pairs
from kymora.operators.keyed import KEY, key_column, with_model

RANK = 1e-10  # directions with less than this share of the largest variance are left out


def _whole(c: str, p: int) -> Column:
    """A covariance with all its entries, none of them null or not finite."""
    bad = F.exists(F.col(c), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(c).isNotNull() & (F.size(c) == len(pairs(p))) & ~bad


def class_covariances(covs: DataFrame, keys: Sequence[str], label: str, p: int, cov: str = "cov") -> DataFrame:
    """(keys, label, n, cov): mean covariance of the windows of each class.

    Windows without a label, or whose covariance is null or has an entry that is null or
    not finite, do not count; a null key is a key.
    """
    means = F.array(*[F.avg(F.col(cov)[i]) for i in range(len(pairs(p)))])
    return covs.where(F.col(label).isNotNull() & _whole(cov, p)).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), means.alias("cov"))


def _directions(p: int, components: int):
    @F.pandas_udf("struct<ratios: array<double>, filters: array<array<double>>>")
    def run(own: pd.Series, rest: pd.Series) -> pd.DataFrame:
        ratios, filters = [], []
        for a, b in zip(own, rest, strict=True):
            if a is None or b is None:
                ratios.append(None)
                filters.append(None)
                continue
            one = _square(a, p)
            size, axes = np.linalg.eigh(one + _square(b, p))
            able = size > RANK * max(size[-1], 0.0)
            white = axes[:, able] / np.sqrt(size[able])
            share, turn = np.linalg.eigh(white.T @ one @ white)
            order = np.lexsort((-share, -np.round(np.abs(share - 0.5), 12)))[:components]
            chosen = (white @ turn[:, order]).T
            top = np.abs(chosen).argmax(1) if len(chosen) else np.zeros(0, int)
            chosen = chosen * np.sign(chosen[np.arange(len(chosen)), top])[:, None]
            ratios.append(share[order].tolist())
            filters.append(chosen.tolist())
        return pd.DataFrame({"ratios": ratios, "filters": filters})

    return run


def fit_spatial(covs: DataFrame, keys: Sequence[str], label: str, p: int, components: int = 4, cov: str = "cov") -> DataFrame:
    """(keys, label, n, ratios, filters, status): up to ``components`` filters of each class against the rest.

    The rest is the mean of the other classes' mean covariances.  A filter w solves
    A w = r (A + B) w for the class A and the rest B, with w'(A + B)w = 1: r is the share
    of the class in the filtered variance.  Filters stand by distance of r from one half,
    the larger r first among equals, with their largest entry positive.  Directions in
    which nothing varies have no filter.  Status is ``fitted``; ``one class`` where a key
    has no other class, ``no variance`` where no direction varies, both without filters.
    """
    keys, m = list(keys), len(pairs(p))
    means = class_covariances(covs, keys, label, p, cov).withColumn(KEY, key_column(keys))
    total = means.groupBy(KEY).agg(F.count(F.lit(1)).alias("_classes"), F.array(*[F.sum(F.col("cov")[i]) for i in range(m)]).alias("_total"))
    rest = F.when(F.col("_classes") > 1, F.zip_with("_total", "cov", lambda t, v: (t - v) / (F.col("_classes") - 1)))
    found = means.join(total, KEY).withColumn("_found", _directions(p, components)("cov", rest))
    status = F.when(F.col("_classes") == 1, "one class").when(F.size("_found.filters") == 0, "no variance").otherwise("fitted")
    return found.select(*keys, label, "n", "_found.ratios", "_found.filters", status.alias("status"))


def spatial_log_power(covs: DataFrame, filters: DataFrame, keys: Sequence[str], label: str, p: int, cov: str = "cov", out: str = "features") -> DataFrame:
    """Log variance of each window behind each filter of its key: classes in order of their label, filters in their order.

    Adds ``out`` and ``spatial_status``.  Rows stay whose key has no filters (``no model``)
    or whose covariance is not whole (``no covariance``), with null features; a variance
    that is not positive gives a null entry.
    """
    weights = lambda f: F.array(*[f[i] * f[j] * (1.0 if i == j else 2.0) for i, j in pairs(p)])
    one = F.struct(F.col(label).alias("label"), F.transform("filters", weights).alias("forms"))
    banks = filters.where(F.size("filters") > 0).groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(one)), lambda b: b["forms"])).alias("_forms"))
    met = with_model(covs, banks, keys).withColumn("_whole", _whole(cov, p))
    power = lambda form: F.aggregate(F.zip_with(form, F.col(cov), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    logs = F.transform("_forms", lambda form: F.when(power(form) > 0, F.log(power(form))))
    status = F.when(F.col("_forms").isNull(), "no model").when(~F.col("_whole"), "no covariance").otherwise("fitted")
    return met.withColumns({out: F.when(F.col("_whole"), logs), "spatial_status": status}).drop("_forms", "_whole")
