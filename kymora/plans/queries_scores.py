"""Scores, bootstrap intervals, run checks, models and report tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.functions import naming as N
from kymora.functions import responses as X
from kymora.functions.vectors import rounded
from kymora.operators import models as M
from kymora.operators import scores as SC
from kymora.plans import report as R
from kymora.plans.registry import query
from kymora.sources import tables

BASIC = ("effective_acc", "success_rate", "time_to_target_median")
EP = tables.scored_episodes


def means_sql(cell, metrics, source):
    c = "".join(f"{x}, " for x in cell)
    return " UNION ALL ".join(
        f"SELECT {c}subject, '{m}' AS metric, avg({m}) AS mean, count({m}) AS n FROM {source} GROUP BY {c}subject HAVING count({m})>0" for m in metrics
    )


def estimate_sql(name, cell, metrics, source="d_episode", doubles=("quality_level", "alpha", "window_s")):
    """CTEs that state mean, spread and resampled interval per group and metric; the last one is ``name``."""
    keys = [*cell, "metric"]
    k = ", ".join(keys)
    text = "'1337|bootstrap|'"
    for c in cell:
        v = f"CAST(round({c}*1e6) AS BIGINT)" if c in doubles else c
        text += f"||coalesce(CAST({v} AS VARCHAR),'~')||'|'"
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in keys)
    a = ", ".join(f"a.{x}" for x in keys)
    n = name
    return f"""
{n}_m AS ({means_sql(cell, metrics, source)}),
{n}_p AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY subject)-1 AS slot, count(*) OVER (PARTITION BY {k}) AS ns FROM {n}_m),
{n}_d AS (SELECT {k}, rep, CAST(floor(CAST('0x'||substr(md5({text}||metric||'|'||rep||'|'||(slot//4)),1+8*(slot%4),8) AS BIGINT)/4294967296.0::DOUBLE*ns) AS BIGINT) AS pick
   FROM {n}_p, (SELECT unnest(range(1,1001)) AS rep) WHERE ns>=3),
{n}_r AS (SELECT {a}, rep, avg(b.mean) AS m FROM {n}_d a JOIN {n}_p b ON {on} AND a.pick=b.slot GROUP BY {a}, rep),
{n}_c AS (SELECT {k}, quantile_cont(m,0.025) AS ci_lo, quantile_cont(m,0.975) AS ci_hi FROM {n}_r GROUP BY {k}),
{n}_e AS (SELECT {k}, avg(mean) AS mean, coalesce(stddev_samp(mean),0) AS sd, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_subjects FROM {n}_m GROUP BY {k}),
{n} AS (SELECT a.*, ci_lo, ci_hi, CASE WHEN n_subjects<3 THEN n_subjects||' subject(s); a between-subject interval needs at least 3' END AS ci_note
   FROM {n}_e a LEFT JOIN {n}_c b ON {on})"""


def r(*names):
    return [rounded(F.col(n)).alias(n) for n in names]


@query("subject_means", "WITH m AS (" + means_sql(["mapping", "decoder"], BASIC, "d_episode") + ") SELECT mapping, decoder, subject, metric, round(mean,6) AS mean, n FROM m")
def subject_means(spark, d):
    """One mean per subject, condition and metric."""
    cell = ["mapping", "decoder"]
    out = SC.subject_means(SC.subject_sums(tables.episodes(spark, d), cell, BASIC), cell, BASIC)
    return out.select("mapping", "decoder", "subject", "metric", *r("mean"), "n")


@query(
    "condition_estimates",
    "WITH " + estimate_sql("e", ["mapping", "decoder"], BASIC).strip() + " SELECT mapping, decoder, metric, round(mean,6) AS mean, round(sd,6) AS sd, n, n_subjects, round(ci_lo,6) AS ci_lo, round(ci_hi,6) AS ci_hi, ci_note FROM e",
)
def condition_estimates(spark, d):
    """Mean, spread and resampled interval per mapping and decoder, subjects as the unit."""
    cell = ["mapping", "decoder"]
    means = SC.subject_means(SC.subject_sums(tables.episodes(spark, d), cell, BASIC), cell, BASIC)
    return SC.estimates(means, cell).select("mapping", "decoder", "metric", *r("mean", "sd"), "n", "n_subjects", *r("ci_lo", "ci_hi"), "ci_note")


@query(
    "few_subjects_estimates",
    "WITH m AS (" + means_sql(["mapping"], ("success_rate",), "d_episode") + ") SELECT mapping, round(avg(mean),6) AS mean, round(stddev_samp(mean),6) AS sd, count(*) AS n_subjects, CAST(NULL AS DOUBLE) AS ci_lo, CAST(NULL AS DOUBLE) AS ci_hi, count(*)||' subject(s); a between-subject interval needs at least 10' AS ci_note FROM m GROUP BY mapping",
)
def few_subjects_estimates(spark, d):
    """Nine subjects where ten are asked for: a reason instead of an interval."""
    means = SC.subject_means(SC.subject_sums(tables.episodes(spark, d), ["mapping"], ("success_rate",)), ["mapping"], ("success_rate",))
    return SC.estimates(means, ["mapping"], min_subjects=10).select("mapping", *r("mean", "sd"), "n_subjects", *r("ci_lo", "ci_hi"), "ci_note")


AX = ("mapping", "decoder", "quality_level", "alpha")


def _block(block, cell, name):
    cols = [c if c in cell else f"NULL::{t}" for c, t in (("mapping", "VARCHAR"), ("decoder", "VARCHAR"), ("quality_level", "DOUBLE"), ("alpha", "DOUBLE"), ("subject", "INT"))]
    named = ", ".join(f"e.{v} AS {c}" if v == c else f"{v} AS {c}" for v, c in zip(cols, (*AX, "subject"), strict=True))
    rows = f"(SELECT {', '.join(cell) + ',' if cell else ''} count(*) AS n_episodes FROM d_episode {'GROUP BY ' + ', '.join(cell) if cell else ''}) q"
    on = " AND ".join(f"e.{c} IS NOT DISTINCT FROM q.{c}" for c in cell) or "true"
    return f"SELECT '{block}' AS block, {named}, n_episodes, metric, round(mean+1e-11,9) AS mean, round(sd+1e-11,9) AS sd, n, n_subjects, round(ci_lo+1e-11,9) AS ci_lo, round(ci_hi+1e-11,9) AS ci_hi, ci_note FROM {name} e JOIN {rows} ON {on}"


@query(
    "score_blocks",
    "WITH " + ",".join([estimate_sql("c", AX, BASIC).strip(), estimate_sql("s", ["subject"], BASIC), estimate_sql("o", [], BASIC)]) + " "
    + " UNION ALL ".join([_block("by_cell", AX, "c"), _block("by_subject", ["subject"], "s"), _block("overall", [], "o")]),
)
def score_blocks(spark, d):
    """Scores by varying cell, by subject and overall, from one pass over the episodes."""
    out = SC.scores(tables.episodes(spark, d), metrics=BASIC)
    nine = lambda *names: [rounded(F.col(n) + 1e-11, 9).alias(n) for n in names]
    return out.select("block", *AX, "subject", "n_episodes", "metric", *nine("mean", "sd"), "n", "n_subjects", *nine("ci_lo", "ci_hi"), "ci_note")


@query(
    "varying_axes",
    "WITH v0 AS (SELECT * REPLACE ('burst' AS protocol, 2.0 AS window_s, CAST(NULL AS VARCHAR) AS intent_mode) FROM d_scored) SELECT * FROM (VALUES ('mapping'),('decoder'),('quality_level'),('alpha'),('intent_mode'),('protocol'),('window_s'),('latency_ms'),('error_struct')) t(axis) JOIN LATERAL (SELECT CASE axis "
    + " ".join(
        f"WHEN '{a}' THEN (SELECT count(DISTINCT {a})+max(CASE WHEN {a} IS NULL THEN 1 ELSE 0 END) > 1 FROM v0)" for a in SC.CELL_AXES
    ) + " END AS varies) v ON true",
)
def varying_axes(spark, d):
    """Axes that vary; protocol, window and intent mode are held fixed or missing."""
    e = EP(spark, d).withColumn("protocol", F.lit("burst")).withColumn("window_s", F.lit(2.0))
    return SC.axis_variation(e.withColumn("intent_mode", F.lit(None).cast("string"))).select("axis", "varies")


CAND = ("success_rate", "time_to_target_median", "effective_acc", "user_contribution_index")


@query(
    "response_diagnostics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_distinct, round(avg({c}),6) AS mean, round(coalesce(stddev_samp({c}),0),6) AS sd, round(min({c}),6) AS min, round(max({c}),6) AS max FROM d_scored"
        for c in CAND
    ),
)
def response_diagnostics(spark, d):
    return SC.diagnostics(EP(spark, d), CAND).select("column", "n", "n_distinct", *r("mean", "sd", "min", "max"))


@query(
    "fittable_by_response",
    """SELECT * FROM (VALUES
 ('success_rate','kappa_offline',NULL), ('success_rate','flat','the predictor flat does not vary'),
 ('flat','kappa_offline','the response flat is saturated; candidates: success_rate, time_to_target_median')) t(response, predictor, reason) JOIN (SELECT count(DISTINCT subject) AS n_groups FROM d_episode) ON true""",
)
def fittable_by_response(spark, d):
    """Three model requests: one that works, a constant predictor, a constant response."""
    e = tables.episodes(spark, d).withColumn("flat", F.lit(1.0))
    out = None
    for y, x in (("success_rate", "kappa_offline"), ("success_rate", "flat"), ("flat", "kappa_offline")):
        row = SC.fittable(e, response=y, predictor=x, candidates=("success_rate", "time_to_target_median", "flat"))
        row = row.select(F.lit(y).alias("response"), F.lit(x).alias("predictor"), "reason", "n_groups")
        out = row if out is None else out.unionByName(row)
    return out


CHECKS_SQL = """
WITH c AS (SELECT arg_min(mapping, (v, mapping)) AS w, min(v) AS v FROM (SELECT mapping, avg(success_rate) AS v FROM d_episode WHERE effective_acc>=0.9 GROUP BY mapping)),
k AS (SELECT 'ceiling' AS "check", w AS worst_mapping, round(v,6) AS value, 0.3::DOUBLE AS threshold, v>=0.3 AS passed FROM c
UNION ALL SELECT 'floor', NULL, round(avg(success_rate),6), 0.3::DOUBLE, avg(success_rate)<=0.3 FROM d_episode WHERE quality_level=0)"""


def _checks(spark, d):
    e = tables.episodes(spark, d)
    return SC.ceiling_check(e, 0.3, F.col("effective_acc") >= 0.9).unionByName(SC.floor_check(e, 0.3, F.col("quality_level") == 0))


@query("run_checks", CHECKS_SQL + " SELECT * FROM k")
def run_checks(spark, d):
    return _checks(spark, d).withColumn("value", rounded(F.col("value")))


@query("run_checks_passed", CHECKS_SQL + " SELECT count(*) AS n_checks, bool_and(passed) AS all_passed FROM k")
def run_checks_passed(spark, d):
    return SC.all_passed(_checks(spark, d))


@query(
    "conditions_equal",
    """WITH p AS (SELECT subject, mapping, avg(success_rate) FILTER (WHERE decoder='F') AS a, avg(success_rate) FILTER (WHERE decoder='O') AS b,
  avg(effective_acc) FILTER (WHERE decoder='F') AS c, avg(effective_acc) FILTER (WHERE decoder='O') AS e FROM d_episode WHERE decoder IN ('F','O') GROUP BY ALL)
SELECT count(*) AS n_keys, round(greatest(max(abs(a-b)), max(abs(c-e))),6) AS max_abs_diff, greatest(max(abs(a-b)), max(abs(c-e)))=0 AS passed FROM p WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def conditions_equal(spark, d):
    """Do two decoders give the same episodes?  They do not, and the check says so."""
    out = SC.conditions_equal(tables.episodes(spark, d), ["subject", "mapping"], F.col("decoder") == "F", F.col("decoder") == "O", ["success_rate", "effective_acc"])
    return out.withColumn("max_abs_diff", rounded(F.col("max_abs_diff")))


# --- models ---


def _modelled(spark, d):
    """Episodes with the response on the logit scale."""
    return EP(spark, d).withColumn("response", X.transformed(F.col("success_rate"), "logit", 8))


LOGIT = "ln(((success_rate*8+0.5)/9)/(1-(success_rate*8+0.5)/9))"


@query(
    "model_moments",
    f"SELECT CAST(subject AS VARCHAR) AS grp, mapping AS level, CAST(count(*) AS DOUBLE) AS n, round(sum(kappa_offline),6) AS sx, round(sum({LOGIT}),4) AS sy, round(sum(kappa_offline*kappa_offline),6) AS sxx, round(sum(kappa_offline*{LOGIT}),4) AS sxy, round(sum({LOGIT}*{LOGIT}),4) AS syy FROM d_scored GROUP BY subject, mapping",
)
def model_moments(spark, d):
    """Sums per subject and mapping: all that the random-intercept fit needs."""
    design = M.Design("kappa_offline", "mapping", ())
    m = M.moments(_modelled(spark, d), design, "response")
    return m.select("grp", "level", "n", *r("sx", "sxx"), *[rounded(F.col(c), 4).alias(c) for c in ("sy", "sxy", "syy")])


def reml_sql(x, y, source, keys=()):
    """Random-intercept fit of ``y`` on ``x`` by closed forms for two terms and a narrowing search, unrolled."""
    k = "".join(f"{c}, " for c in keys)
    using = f"USING ({', '.join(keys)})" if keys else "ON true"
    value = "(n-2)*ln(s2)+lg+ln(det)"

    def level(name, points):
        """Profile values of a table of (keys, i, theta)."""
        return f"""
{name}_a AS (SELECT {k}i, theta, sum(n) AS n, count(*) AS ng, sum(n-n*n*theta/(1+n*theta)) AS a11, sum(sx-n*sx*theta/(1+n*theta)) AS a12, sum(sxx-sx*sx*theta/(1+n*theta)) AS a22,
   sum(sy-n*sy*theta/(1+n*theta)) AS b1, sum(sxy-sx*sy*theta/(1+n*theta)) AS b2, sum(syy-sy*sy*theta/(1+n*theta)) AS q, sum(ln(1+n*theta)) AS lg FROM ({points}) p JOIN st {using} GROUP BY {k}i, theta),
{name}_b AS (SELECT *, a11*a22-a12*a12 AS det, (a22*b1-a12*b2)/(a11*a22-a12*a12) AS e0, (a11*b2-a12*b1)/(a11*a22-a12*a12) AS e1 FROM {name}_a),
{name} AS (SELECT *, (q-b1*e0-b2*e1)/(n-2) AS s2 FROM {name}_b),
{name}_m AS (SELECT {k}arg_min(i, {value}) AS best, min({value}) AS low, arg_min(theta, {value}) AS theta FROM {name} {"GROUP BY " + ", ".join(keys) if keys else ""})"""

    first = "-18.420680743952367::DOUBLE + i*(32.23619130191664::DOUBLE/42)"
    ids = f"SELECT DISTINCT {', '.join(keys)} FROM st" if keys else "SELECT 1 AS one"
    text = f"""
st AS (SELECT {k}subject, CAST(count(*) AS DOUBLE) AS n, sum({x}) AS sx, sum({y}) AS sy, sum({x}*{x}) AS sxx, sum({x}*{y}) AS sxy, sum({y}*{y}) AS syy FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {k}subject),
ids AS ({ids}),
{level("z", f"SELECT {k}0 AS i, 0.0::DOUBLE AS theta FROM ids").strip()},
{level("g0", f"SELECT {k}i, exp({first}) AS theta FROM ids, (SELECT unnest(range(0,43)) AS i)").strip()},
w0 AS (SELECT {k}{first.replace("i*", "greatest(best-1,0)*")} AS lo, {first.replace("i*", "least(best+1,42)*")} AS hi FROM g0_m)"""
    for r in range(1, 7):
        text += f""",
{level(f"g{r}", f"SELECT {k}i, exp(lo+i*(hi-lo)/24) AS theta FROM w{r - 1}, (SELECT unnest(range(0,25)) AS i)").strip()},
w{r} AS (SELECT {k}lo+greatest(best-1,0)*(hi-lo)/24 AS lo, lo+least(best+1,24)*(hi-lo)/24 AS hi FROM w{r - 1} JOIN g{r}_m {using})"""
    chosen = f"SELECT {''.join(f'g6_m.{c} AS {c}, ' for c in keys)}0 AS i, CASE WHEN g6_m.low < z_m.low THEN g6_m.theta ELSE 0 END AS theta FROM g6_m JOIN z_m {using}"
    text += f""",
{level("f", chosen).strip()},
t AS (SELECT {k}'Intercept' AS term, e0 AS estimate, sqrt(s2*a22/det) AS se, CAST(n AS BIGINT) AS n_obs, ng AS n_groups, theta*s2 AS group_var FROM f
 UNION ALL SELECT {k}'{x}', e1, sqrt(s2*a11/det), CAST(n AS BIGINT), ng, theta*s2 FROM f)"""
    return text


ENDS = "round(estimate-1.959963984540054*se,5)+0.0 AS ci_lo, round(estimate+1.959963984540054*se,5)+0.0 AS ci_hi"
FIVE = lambda *names: [rounded(F.col(n), 5).alias(n) for n in names]
RESPONSE = f"s AS (SELECT *, {LOGIT} AS response FROM d_scored)"


@query(
    "mixed_model",
    "WITH " + RESPONSE + "," + reml_sql("kappa_offline", "response", "s") + f" SELECT term, round(estimate,5)+0.0 AS estimate, round(se,5) AS se, {ENDS}, n_obs, n_groups, round(group_var,5) AS group_var FROM t",
)
def mixed_model(spark, d):
    """Random-intercept fit of the response on kappa, with intervals."""
    out = M.fit_mixed(_modelled(spark, d), M.Design("kappa_offline"), "response")
    return out.select("term", *FIVE("estimate", "se", "ci_lo", "ci_hi"), "n_obs", "n_groups", *FIVE("group_var"))


@query(
    "mixed_model_of_contribution",
    "WITH s AS (SELECT *, user_contribution_index+0.02::DOUBLE*subject AS response FROM d_scored)," + reml_sql("success_rate", "response", "s")
    + f" SELECT term, round(estimate,5)+0.0 AS estimate, round(se,5) AS se, {ENDS}, n_obs, n_groups, round(group_var,5) AS group_var FROM t",
)
def mixed_model_of_contribution(spark, d):
    """The same fit on a response whose level differs between subjects, so the group variance is not zero."""
    e = EP(spark, d).withColumn("response", F.col("user_contribution_index") + 0.02 * F.col("subject"))
    out = M.fit_mixed(e, M.Design("success_rate"), "response")
    return out.select("term", *FIVE("estimate", "se", "ci_lo", "ci_hi"), "n_obs", "n_groups", *FIVE("group_var"))


@query("interaction_model")
def interaction_model(spark, d):
    """Does the kappa slope depend on the mapping?"""
    return M.interaction_fit(_modelled(spark, d), "response")


@query("trade_ratios")
def trade_ratios(spark, d):
    """Mapping offset over accuracy slope, without resampling."""
    e = _modelled(spark, d)
    design = M.Design("effective_acc", "mapping", M.levels_of(e, "mapping", "1-URGENT"))
    return M.trade_ratios(M.fit_mixed(e, design, "response"), "effective_acc", "mapping", 1e-3)


@query("trade_off_bootstrap")
def trade_off_bootstrap(spark, d):
    """The same ratios with intervals from 1000 resampled subject sets."""
    return M.trade_off(_modelled(spark, d), "response", "1-URGENT")


@query(
    "trade_off_applies",
    "SELECT true AS applicable, CAST(NULL AS VARCHAR) AS reason FROM d_episode HAVING stddev_samp(effective_acc)>1e-6 AND count(DISTINCT mapping)>1",
)
def trade_off_applies(spark, d):
    return M.trade_off_applies(EP(spark, d), "effective_acc", "mapping")


SLOPES = "WITH " + RESPONSE + ", sa AS (SELECT * FROM s WHERE alpha IS NOT NULL)," + reml_sql("kappa_offline", "response", "sa", ("alpha",)) + """,
sp AS (SELECT alpha, count(response) AS n, stddev_samp(response) AS sd FROM sa GROUP BY alpha),
lv AS (SELECT sp.alpha, sp.n, sd, estimate, estimate-1.959963984540054*se AS lo, estimate+1.959963984540054*se AS hi FROM sp JOIN t ON t.alpha=sp.alpha AND term='kappa_offline')"""


@query(
    "slope_by_autonomy",
    SLOPES + " SELECT alpha, n, round(sd,5) AS response_sd, round(estimate,5)+0.0 AS slope, round(lo,5)+0.0 AS ci_lo, round(hi,5)+0.0 AS ci_hi, sd<1e-6 AS saturated, lo<=0 AND hi>=0 AS includes_zero FROM lv",
)
def slope_by_autonomy(spark, d):
    """Kappa slope at every autonomy level and whether its interval holds zero."""
    out = M.slope_by_level(_modelled(spark, d), "response")
    return out.select("alpha", "n", *FIVE("response_sd", "slope", "ci_lo", "ci_hi"), "saturated", "includes_zero")


@query("autonomy_crossing", SLOPES + " SELECT min(CASE WHEN lo<=0 AND hi>=0 THEN alpha END) AS alpha_star, count(*) AS n_levels FROM lv")
def autonomy_crossing(spark, d):
    return M.crossing(M.slope_by_level(_modelled(spark, d), "response"))


@query(
    "contribution_guard",
    "WITH " + reml_sql("alpha", "user_contribution_index", "d_scored").strip() + f" SELECT term, round(estimate,5)+0.0 AS estimate, round(se,5) AS se, {ENDS}, n_obs, n_groups, round(group_var,5) AS group_var FROM t",
)
def contribution_guard(spark, d):
    """User contribution against autonomy."""
    out = M.guard_fit(_modelled(spark, d))
    return out.select("term", *FIVE("estimate", "se", "ci_lo", "ci_hi"), "n_obs", "n_groups", *FIVE("group_var"))


@query("model_report")
def model_report(spark, d):
    """All model answers in one long table."""
    e = _modelled(spark, d)
    cols = ["block", "name", "estimate", "lo", "hi", "note"]
    h1 = M.interaction_fit(e, "response").where("is_interaction").select(
        F.lit("interaction").alias("block"), F.col("term").alias("name"), "estimate", F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"), F.col("failed").alias("note"))
    h2 = M.trade_off(e, "response", "1-URGENT", n_boot=200).select(
        F.lit("trade ratio").alias("block"), F.col("mapping").alias("name"), "estimate", F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"), F.when(F.col("unstable"), "unstable").alias("note"))
    levels = M.slope_by_level(e, "response")
    h3 = levels.select(
        F.lit("slope by autonomy").alias("block"), F.col("alpha").cast("string").alias("name"), F.col("slope").alias("estimate"), F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"), F.when(F.col("saturated"), "saturated").alias("note"))
    diag = SC.diagnostics(e, CAND).select(
        F.lit("response").alias("block"), F.col("column").alias("name"), F.col("sd").alias("estimate"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.lit(None).cast("string").alias("note"))
    none = lambda t: F.lit(None).cast(t)
    star = M.crossing(levels).select(
        F.lit("alpha star").alias("block"), F.lit("alpha").alias("name"), F.col("alpha_star").cast("double").alias("estimate"), none("double").alias("lo"), none("double").alias("hi"), F.when(F.col("alpha_star").isNull(), "no interval holds zero").alias("note"))
    guard = M.guard_fit(e).select(
        F.lit("guard").alias("block"), F.col("term").alias("name"), "estimate", F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"), F.col("failed").alias("note"))
    gate = SC.fittable(e, response="response", predictor="kappa_offline", candidates=CAND).select(
        F.lit("gate").alias("block"), F.lit("fittable").alias("name"), F.col("fittable").cast("double").alias("estimate"), none("double").alias("lo"), none("double").alias("hi"), F.col("reason").alias("note"))
    missing = F.col("response").isNull() | F.isnan("response")
    dropped = e.agg(F.count(F.when(missing, 1)).cast("double").alias("estimate")).select(
        F.lit("dropped rows").alias("block"), F.lit("response").alias("name"), "estimate", none("double").alias("lo"), none("double").alias("hi"), none("string").alias("note"))
    parts = (h1, h2, h3, star, guard, gate, dropped, diag)
    return functools.reduce(DataFrame.unionByName, parts).select(*cols)


@query(
    "least_squares_lines",
    """SELECT mapping, decoder, count(*) AS n, round(min(kappa_offline),6) AS x_lo, round(max(kappa_offline),6) AS x_hi, round(regr_slope(success_rate,kappa_offline),6)+0.0 AS slope, round(regr_intercept(success_rate,kappa_offline),6) AS intercept
FROM d_episode GROUP BY ALL HAVING count(*)>=3 AND max(kappa_offline)>min(kappa_offline)""",
)
def least_squares_lines(spark, d):
    out = M.lines(tables.episodes(spark, d), ["mapping", "decoder"], "kappa_offline", "success_rate")
    return out.select("mapping", "decoder", "n", *r("x_lo", "x_hi", "slope", "intercept"))


# --- report tables ---


def cells_sql(cell, metrics, source, extra=""):
    pick = ", ".join(
        f"round(max(CASE WHEN metric='{m}' THEN mean END),6) AS {m}_mean, round(max(CASE WHEN metric='{m}' THEN ci_lo END),6) AS {m}_lo, round(max(CASE WHEN metric='{m}' THEN ci_hi END),6) AS {m}_hi"
        for m in metrics
    )
    return "WITH " + (extra + ", " if extra else "") + estimate_sql("e", cell, metrics, source).strip() + f", t AS (SELECT {', '.join(cell)}, {pick} FROM e GROUP BY {', '.join(cell)})"


def ends(*metrics):
    return [c for m in metrics for c in r(f"{m}_mean", f"{m}_lo", f"{m}_hi")]


@query("cell_table", cells_sql(("decoder", "alpha"), BASIC, "d_episode") + " SELECT * FROM t")
def cell_table(spark, d):
    """Nested scores as plain columns: axes, means and interval ends."""
    return R.cell_scores(tables.episodes(spark, d), ["decoder", "alpha"], BASIC).select("decoder", "alpha", *ends(*BASIC))


@query(
    "report_quality_sweep",
    cells_sql(("mapping", "quality_level"), ("effective_acc", "success_rate"), "d_episode") + " SELECT *, true AS is_sweep, 'unknown' AS label FROM t",
)
def report_quality_sweep(spark, d):
    return R.quality_sweep(tables.episodes(spark, d)).select("mapping", "quality_level", *ends("effective_acc", "success_rate"), "is_sweep", "label")


@query("report_kappa_points", "SELECT mapping, subject, decoder, round(avg(kappa_offline),6) AS kappa_offline, round(avg(success_rate),6) AS success_rate FROM d_episode GROUP BY ALL")
def report_kappa_points(spark, d):
    return R.kappa_points(tables.episodes(spark, d)).select("mapping", "subject", "decoder", *r("kappa_offline", "success_rate"))


@query(
    "report_kappa_lines",
    """WITH p AS (SELECT mapping, subject, decoder, avg(kappa_offline) AS k, avg(success_rate) AS s FROM d_episode GROUP BY ALL),
f AS (SELECT mapping, count(*) AS n, min(k) AS lo, max(k) AS hi, regr_slope(s,k) AS b, regr_intercept(s,k) AS a FROM p GROUP BY mapping)
SELECT mapping, n, round(greatest(lo, least((0-a)/b,(1-a)/b)),6) AS x_lo, round(least(hi, greatest((0-a)/b,(1-a)/b)),6) AS x_hi, round(b,6) AS slope, round(a,6) AS intercept, CAST(NULL AS VARCHAR) AS note FROM f""",
)
def report_kappa_lines(spark, d):
    return R.kappa_lines(tables.episodes(spark, d)).select("mapping", "n", *r("x_lo", "x_hi", "slope", "intercept"), "note")


@query(
    "report_autonomy_sweep",
    cells_sql(("decoder", "alpha"), ("success_rate", "user_contribution_index"), "s", "s AS (SELECT * FROM d_scored WHERE alpha IS NOT NULL)") + " SELECT *, decoder AS label FROM t",
)
def report_autonomy_sweep(spark, d):
    e = _modelled(spark, d)
    out = R.autonomy_sweep(e, M.slope_by_level(e, "response"))
    return out.select("decoder", "alpha", *ends("success_rate", "user_contribution_index"), "label")


@query(
    "report_command_accuracy",
    cells_sql(("mapping", "latency_ms"), ("command_accuracy", "bursts_without_command"), "d_scored") + " SELECT *, 0.25::DOUBLE AS chance FROM t",
)
def report_command_accuracy(spark, d):
    return R.command_accuracy(EP(spark, d)).select("mapping", "latency_ms", *ends("command_accuracy", "bursts_without_command"), "chance")


def _ablation(axis, name, text):
    return f"SELECT '{name}' AS experiment, '{axis}' AS axis, mapping, {text} AS value, round(avg(m),6) AS mean, CAST(NULL AS VARCHAR) AS reason FROM (SELECT mapping, {axis}, subject, avg(success_rate) AS m FROM d_scored GROUP BY ALL) q GROUP BY mapping, {axis}"


@query(
    "report_ablations",
    " UNION ALL ".join([
        _ablation("window_s", "ablation_window", "CAST(CAST(window_s AS INT) AS VARCHAR)||'.0'"), _ablation("latency_ms", "ablation_latency", "CAST(latency_ms AS VARCHAR)"),
        _ablation("error_struct", "ablation_errstruct", "error_struct"), "SELECT 'ablation_protocol', 'protocol', NULL, NULL, NULL, 'not supplied'",
    ]),
)
def report_ablations(spark, d):
    """Three ablations with data and one whose run was not supplied."""
    e = EP(spark, d)
    runs = {"ablation_window": e, "ablation_latency": e, "ablation_errstruct": e, "ablation_protocol": None}
    return R.ablation_grid(spark, runs).withColumn("mean", rounded(F.col("mean")))


@query(
    "report_intent_ablation",
    cells_sql(("intent_mode", "alpha"), ("success_rate",), "s", "s AS (SELECT * FROM d_scored WHERE alpha IS NOT NULL)") + " SELECT * FROM t",
)
def report_intent_ablation(spark, d):
    return R.intent_ablation(EP(spark, d)).select("intent_mode", "alpha", *ends("success_rate"))


@query(
    "display_names",
    """WITH n AS (SELECT CASE mapping WHEN '1-URGENT' THEN 's1_argmax' WHEN '2-HIGH' THEN 's2_weighted_entropy' ELSE mapping END AS mapping, CASE decoder WHEN 'F' THEN 'riemann' ELSE decoder END AS decoder, count(*) AS n FROM d_episode GROUP BY ALL)
SELECT mapping, decoder, CASE mapping WHEN 's1_argmax' THEN 'S1 argmax' WHEN 's2_weighted_entropy' THEN 'S2 weighted + entropy' ELSE 'unknown' END AS mapping_label,
 CASE decoder WHEN 'riemann' THEN 'Riemannian' ELSE decoder END AS decoder_label, 'success rate' AS metric_label, 'uci_excluded_frac' AS raw_label, n FROM n""",
)
def display_names(spark, d):
    """Labels, with the raw name where there is none."""
    m = F.when(F.col("mapping") == "1-URGENT", "s1_argmax").when(F.col("mapping") == "2-HIGH", "s2_weighted_entropy").otherwise(F.col("mapping"))
    dec = F.when(F.col("decoder") == "F", "riemann").otherwise(F.col("decoder"))
    n = tables.episodes(spark, d).groupBy(m.alias("mapping"), dec.alias("decoder")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        "mapping", "decoder", N.mapping_label(F.col("mapping")).alias("mapping_label"), N.decoder_label(F.col("decoder")).alias("decoder_label"),
        N.metric_label(F.lit("success_rate")).alias("metric_label"), N.metric_label(F.lit("uci_excluded_frac")).alias("raw_label"), "n",
    )
