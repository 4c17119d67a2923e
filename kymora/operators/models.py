"""Random-intercept models fitted from sums that Spark makes.

For a fixed variance ratio the normal equations need only a few sums per
group, and groups of equal size can be added together.  So one aggregate runs
over the data, partitions fold their groups by size, and the one-dimensional
search that remains sees a handful of small matrices per model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.operators import grid
from kymora.session import spread, stored


@dataclass(frozen=True)
class Design:
    """Terms of ``y ~ x``, ``y ~ x + C(factor)`` or ``y ~ x * C(factor)``."""

    predictor: str
    factor: str | None = None
    levels: tuple[str, ...] = ()  # the first one is the reference
    interaction: bool = False

    @property
    def terms(self) -> list[str]:
        shift = [f"C({self.factor})[T.{v}]" for v in self.levels[1:]]
        slopes = [f"{self.predictor}:{s}" for s in shift] if self.interaction else []
        return ["Intercept", *shift, self.predictor, *slopes]


def levels_of(df: DataFrame, factor: str, reference: str | None = None) -> tuple[str, ...]:
    """Factor levels, the reference first (read back: one value per level)."""
    found = sorted(r[0] for r in df.select(factor).where(F.col(factor).isNotNull()).distinct().collect())
    if reference is not None:
        if reference not in found:
            raise ValueError(f"the reference {reference!r} is absent; present: {found}")
        found = [reference, *[v for v in found if v != reference]]
    return tuple(found)


def moments(df: DataFrame, design: Design, response: str, keys: Sequence[str] = (), group: str = "subject") -> DataFrame:
    """Sums per (model, group, factor level): the sufficient statistics."""
    x, y = F.col(design.predictor).cast("double"), F.col(response).cast("double")
    ok = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    level = F.col(design.factor).cast("string") if design.factor else F.lit("")
    return ok.groupBy(*keys, F.col(group).cast("string").alias("grp"), level.alias("level")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"),
        F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
    )


def per_group(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (model, group) holding its level sums: as many entries as the factor has levels."""
    return stats.groupBy(*keys, "grp").agg(
        F.collect_list(F.struct("level", "n", "sx", "sy", "sxx", "sxy", "syy")).alias("cells")
    )


def _group_sums(cells, design: Design):
    """X'X, X'y, y'y, column sums of X and sum of y for one group."""
    k = len(design.levels) if design.factor else 1
    p = len(design.terms)
    where = {v: i for i, v in enumerate(design.levels)} if design.factor else {"": 0}
    xx, xy = np.zeros((p, p)), np.zeros(p)
    ones, yy, sy_all, n_all = np.zeros(p), 0.0, 0.0, 0.0
    for c in cells:
        i = where[c["level"]]
        # Columns: intercept, one dummy per other level, predictor, one slope shift per other level.
        unit, slope = np.zeros(p), np.zeros(p)
        unit[0] = 1.0
        slope[k] = 1.0
        if i > 0:
            unit[i] = 1.0
            if design.interaction:
                slope[k + i] = 1.0
        n, sx, sy = c["n"], c["sx"], c["sy"]
        cross = np.outer(unit, slope)
        xx += n * np.outer(unit, unit) + sx * (cross + cross.T) + c["sxx"] * np.outer(slope, slope)
        xy += sy * unit + c["sxy"] * slope
        ones += n * unit + sx * slope
        yy += c["syy"]
        sy_all += sy
        n_all += n
    return n_all, xx, xy, yy, ones, sy_all


def group_sums(groups: DataFrame, design: Design, keys: Sequence[str] = ()) -> DataFrame:
    """Size and flattened sums of every group, worked out once per group."""
    columns = [*keys, "grp"]
    schema = T.StructType(
        [*[groups.schema[k] for k in columns], T.StructField("size", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, flats = [], []
            for cells in pdf["cells"]:
                n, xx, xy, yy, ones, sy = _group_sums(cells, design)
                sizes.append(n)
                flats.append(np.concatenate([xx.ravel(), xy, [yy], np.outer(ones, ones).ravel(), ones * sy, [sy * sy]]))
            yield pdf[columns].assign(size=sizes, sums=flats)

    return groups.mapInPandas(run, schema)


def fold_groups(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Groups of one size added together, partition by partition."""
    keys = list(keys)
    schema = T.StructType(
        [*[sums.schema[k] for k in keys], T.StructField("size", T.DoubleType()), T.StructField("n_groups", T.DoubleType()),
         T.StructField("sums", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            idents = list(zip(*[pdf[k] for k in keys], strict=True)) if keys else [()] * len(pdf)
            for ident, size, flat in zip(idents, pdf["size"], pdf["sums"], strict=True):
                count, acc = total.get((ident, size), (0.0, 0.0))
                total[(ident, size)] = (count + 1.0, acc + np.asarray(flat))
        rows = [(*ident, n, count, acc.tolist()) for (ident, n), (count, acc) in total.items()]
        yield pd.DataFrame(rows, columns=[*keys, "size", "n_groups", "sums"])

    return sums.mapInPandas(run, schema)


def profile(parts: Sequence[tuple[float, float, np.ndarray]], p: int) -> dict:
    """Restricted likelihood over the variance ratio; returns coefficients and their covariance."""
    sizes = np.array([s for s, _, _ in parts])
    counts = np.array([c for _, c, _ in parts])
    m = np.stack([np.asarray(f) for _, _, f in parts])
    q = p * p
    xx, xy, yy = m[:, :q].sum(0).reshape(p, p), m[:, q : q + p].sum(0), m[:, q + p].sum()
    oo, oy, ss = m[:, q + p + 1 : 2 * q + p + 1], m[:, 2 * q + p + 1 : 2 * q + 2 * p + 1], m[:, -1]
    n = float((sizes * counts).sum())
    free = n - p

    def at(thetas: np.ndarray):
        c = thetas[:, None] / (1.0 + sizes[None, :] * thetas[:, None])
        a = xx[None] - (c @ oo).reshape(-1, p, p)
        b = xy[None] - c @ oy
        beta = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        rss = yy - c @ ss - (b * beta).sum(1)
        s2 = np.maximum(rss, 0.0) / free
        sign, logdet = np.linalg.slogdet(a)
        if (sign <= 0).any() or (s2 <= 0).any():
            raise np.linalg.LinAlgError("singular design or no residual variance")
        value = free * np.log(s2) + (counts * np.log1p(sizes[None, :] * thetas[:, None])).sum(1) + logdet
        return value, beta, s2, a

    if free <= 0:
        raise np.linalg.LinAlgError("more terms than rows")
    logs = np.linspace(math.log(1e-8), math.log(1e6), 43)
    at_zero = at(np.zeros(1))[0][0]
    values = at(np.exp(logs))[0]
    best = int(np.argmin(values))
    converged = best < len(logs) - 1
    for _ in range(6):
        logs = np.linspace(logs[max(best - 1, 0)], logs[min(best + 1, len(logs) - 1)], 25)
        values = at(np.exp(logs))[0]
        best = int(np.argmin(values))
    theta = float(np.exp(logs[best])) if values[best] < at_zero else 0.0
    _, betas, s2s, as_ = at(np.array([theta]))
    beta, s2, a = betas[0], float(s2s[0]), as_[0]
    return {
        "beta": beta, "cov": s2 * np.linalg.inv(a), "s2": s2, "group_var": theta * s2, "n": n, "n_groups": float(counts.sum()),
        "converged": converged,
    }


FIT_FIELDS = (
    "term string, estimate double, se double, ci_lo double, ci_hi double, p double, n_obs bigint, n_groups bigint, "
    "group_var double, converged boolean, failed string"
)


def fit(folded: DataFrame, design: Design, keys: Sequence[str] = (), ci: float = 0.95) -> DataFrame:
    """One row per coefficient and model; a model that cannot be fitted gives one row with the reason."""
    keys = list(keys)
    p = len(design.terms)
    z = NormalDist().inv_cdf(0.5 + ci / 2.0)
    by = keys or ["_all"]
    data = folded if keys else folded.withColumn("_all", F.lit(1))
    key_ddl = "".join(f"{k} {data.schema[k].dataType.simpleString()}, " for k in by)
    fields = [*by, "term", "estimate", "se", "ci_lo", "ci_hi", "p", "n_obs", "n_groups", "group_var", "converged", "failed"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ident = [pdf[k].iloc[0] for k in by]
        merged: dict = {}
        for s, c, f in zip(pdf["size"], pdf["n_groups"], pdf["sums"], strict=True):
            count, acc = merged.get(s, (0.0, 0.0))
            merged[s] = (count + c, acc + np.asarray(f))
        try:
            r = profile([(s, c, f) for s, (c, f) in merged.items()], p)
        except np.linalg.LinAlgError as error:
            n = int(sum(s * c for s, (c, _) in merged.items()))
            g = int(sum(c for c, _ in merged.values()))
            return pd.DataFrame([[*ident, None, None, None, None, None, None, n, g, None, False, str(error)]], columns=fields)
        rows = []
        for i, term in enumerate(design.terms):
            b, se = float(r["beta"][i]), math.sqrt(max(float(r["cov"][i, i]), 0.0))
            pv = math.erfc(abs(b / se) / math.sqrt(2)) if se > 0 else None
            rows.append([*ident, term, b, se, b - z * se, b + z * se, pv, int(r["n"]), int(r["n_groups"]), r["group_var"], r["converged"], None])
        return pd.DataFrame(rows, columns=fields)

    out = spread(data, *[F.col(k) for k in by]).groupBy(*by).applyInPandas(one, key_ddl + FIT_FIELDS)
    return out if keys else out.drop("_all")


def fit_mixed(
    df: DataFrame, design: Design, response: str, keys: Sequence[str] = (), group: str = "subject", ci: float = 0.95
) -> DataFrame:
    sums = group_sums(per_group(moments(df, design, response, keys, group), keys), design, keys)
    return fit(fold_groups(sums, keys), design, keys, ci)


# --- the three questions ---


def interaction_fit(df: DataFrame, response: str, predictor: str = "kappa_offline", strategy: str = "mapping", group: str = "subject", ci: float = 0.95) -> DataFrame:
    """Does the predictor's effect depend on the strategy?  The interaction rows are the answer."""
    design = Design(predictor, strategy, levels_of(df, strategy), interaction=True)
    return fit_mixed(df, design, response, (), group, ci).withColumn("is_interaction", F.coalesce(F.col("term").contains(":"), F.lit(False)))


def trade_ratios(fitted: DataFrame, predictor: str, strategy: str, min_slope: float, keys: Sequence[str] = ()) -> DataFrame:
    """Strategy offset over predictor slope, per strategy other than the reference."""
    prefix = f"C({strategy})[T."
    items = fitted.where(F.col("failed").isNull()).groupBy(*keys).agg(
        F.max(F.when(F.col("term") == predictor, F.col("estimate"))).alias("slope"),
        F.collect_list(F.when(F.col("term").startswith(prefix) & ~F.col("term").contains(":"), F.struct("term", "estimate"))).alias("_o"),
    )
    name = F.regexp_replace(F.expr(f"substr(o.term, {len(prefix) + 1})"), r"\]$", "")
    flat = F.abs(F.col("slope")) < min_slope
    return items.select(*keys, "slope", F.explode("_o").alias("o")).select(
        *keys, name.alias(strategy), F.col("o.estimate").alias("offset"), "slope",
        F.when(~flat, F.col("o.estimate") / F.col("slope")).alias("estimate"), flat.alias("unstable"),
    )


def trade_off(
    df: DataFrame, response: str, reference: str, predictor: str = "effective_acc", strategy: str = "mapping", group: str = "subject",
    n_boot: int = 1000, ci: float = 0.95, min_slope: float = 1e-3, seed: int = 1337,
) -> DataFrame:
    """Trade ratios with an interval from resampled subjects.

    Replicates reuse the per-group sums: a replicate is a list of groups, and
    a group drawn twice enters as two groups.
    """
    design = Design(predictor, strategy, levels_of(df, strategy, reference))
    # One row per group from here on; stored, because the point fit and every replicate read it.
    groups = stored(group_sums(per_group(moments(df, design, response, (), group)), design))
    point = trade_ratios(fit(fold_groups(groups), design, (), ci), predictor, strategy, min_slope)
    draws = grid.draw_subjects(groups.select("grp"), n_boot, seed, "grp")
    copies = spread(draws.select("replicate", "grp").join(groups, "grp").select("replicate", "size", "sums"), F.col("replicate"))
    refits = stored(fit(fold_groups(copies, ["replicate"]), design, ["replicate"], ci))
    each = trade_ratios(refits, predictor, strategy, min_slope, ["replicate"])
    low = (1.0 - ci) / 2.0
    ends = each.groupBy(strategy).agg(
        F.count("estimate").alias("n_boot_used"), F.percentile("estimate", F.array(F.lit(low), F.lit(1.0 - low))).alias("_q")
    )
    failed = refits.where(F.col("failed").isNotNull()).agg(F.count(F.lit(1)))
    used = F.col("n_boot_used") >= 2
    return point.join(ends, strategy, "left").select(
        strategy, "offset", "slope", "estimate", "unstable", "n_boot_used",
        F.when(used, F.col("_q")[0]).alias("ci_lo"), F.when(used, F.col("_q")[1]).alias("ci_hi"), failed.scalar().alias("failed_refits"),
    )


def trade_off_applies(df: DataFrame, predictor: str, strategy: str, min_spread: float = 1e-6) -> DataFrame:
    """One row: whether a trade ratio can be asked for, with the reason when it cannot."""
    row = df.agg(F.coalesce(F.stddev_samp(predictor), F.lit(0.0)).alias("sd"), (F.min(strategy) != F.max(strategy)).alias("two"))
    reason = F.when(F.col("sd") < min_spread, f"{predictor} does not vary").when(~F.col("two"), f"only one {strategy}")
    return row.select(reason.isNull().alias("applicable"), reason.alias("reason"))


def slope_by_level(
    df: DataFrame, response: str, autonomy: str = "alpha", predictor: str = "kappa_offline", group: str = "subject", ci: float = 0.95,
    min_spread: float = 1e-6,
) -> DataFrame:
    """Predictor slope at every autonomy level, whether its interval holds zero, and the first level where it does."""
    rows = df.where(F.col(autonomy).isNotNull())
    spread = rows.groupBy(autonomy).agg(F.count(response).alias("n"), F.coalesce(F.stddev_samp(response), F.lit(0.0)).alias("response_sd"))
    fits = fit_mixed(rows, Design(predictor), response, [autonomy], group, ci)
    slope = fits.where((F.col("term") == predictor) | F.col("failed").isNotNull()).select(autonomy, F.col("estimate").alias("slope"), "ci_lo", "ci_hi", "failed")
    return spread.join(slope, autonomy, "left").withColumn("saturated", F.col("response_sd") < min_spread).withColumn(
        "includes_zero", (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0)
    )


def crossing(levels: DataFrame, autonomy: str = "alpha") -> DataFrame:
    """Lowest level whose slope interval includes zero."""
    return levels.agg(F.min(F.when(F.col("includes_zero"), F.col(autonomy))).alias("alpha_star"), F.count(F.lit(1)).alias("n_levels"))


def guard_fit(df: DataFrame, guard: str = "user_contribution_index", autonomy: str = "alpha", group: str = "subject", ci: float = 0.95) -> DataFrame:
    """Contribution against autonomy: is the user still steering where the slope vanishes?"""
    return fit_mixed(df.where(F.col(guard).isNotNull() & ~F.isnan(F.col(guard))), Design(autonomy), guard, (), group, ci)


def lines(df: DataFrame, keys: Sequence[str], x: str, y: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Least-squares line per group; needs three points and a spread in ``x``.

    With ``bounds`` the x range is cut to where the line stays inside them.
    """
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    ok = df.where(xx.isNotNull() & yy.isNotNull() & ~F.isnan(xx) & ~F.isnan(yy))
    out = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(xx).alias("x_lo"), F.max(xx).alias("x_hi"), F.regr_slope(yy, xx).alias("slope"),
        F.regr_intercept(yy, xx).alias("intercept"),
    ).where((F.col("n") >= 3) & (F.col("x_hi") > F.col("x_lo")))
    if bounds is None:
        return out
    at = [F.when(F.col("slope") != 0, (F.lit(b) - F.col("intercept")) / F.col("slope")) for b in bounds]
    first, last = F.least(*at), F.greatest(*at)
    return out.withColumn("x_lo", F.greatest("x_lo", first)).withColumn("x_hi", F.least("x_hi", last))
