import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kymora.operators import grid as G
from kymora.operators import models as M
from kymora.operators import scores as SC


def estimate(spark, rows, **kw):
    df = spark.createDataFrame(rows, "subject int, mapping string, success_rate double")
    means = SC.subject_means(SC.subject_sums(df, ["mapping"], ["success_rate"]), ["mapping"], ["success_rate"])
    return SC.estimates(means, ["mapping"], **kw)


def test_mean_and_spread_are_over_subjects(spark):
    rows = [(s, "m", v) for s, v in ((1, 0.2), (2, 0.5), (3, 0.8)) for _ in range(4)]
    r = estimate(spark, rows).first()
    assert r["mean"] == pytest.approx(0.5) and r["sd"] == pytest.approx(0.3) and (r["n"], r["n_subjects"]) == (12, 3)
    assert 0.2 - 1e-9 <= r["ci_lo"] < r["mean"] < r["ci_hi"] <= 0.8 + 1e-9


def test_unbalanced_subjects_weigh_the_same(spark):
    rows = [(1, "m", 0.0)] * 8 + [(2, "m", 1.0)] * 2 + [(3, "m", 1.0)] * 2
    assert estimate(spark, rows).first()["mean"] == pytest.approx(2 / 3)


def test_two_subjects_get_a_reason(spark):
    r = estimate(spark, [(1, "m", 0.1), (2, "m", 0.3), (3, "m", float("nan"))]).first()
    assert r["ci_lo"] is None and r["ci_note"].startswith("2 subject(s)") and r["n"] == 2
    one = estimate(spark, [(1, "m", 0.1)]).first()
    assert one["sd"] == 0.0


def test_a_metric_without_values_has_no_row(spark):
    assert estimate(spark, [(1, "m", float("nan")), (2, "m", None)]).count() == 0


def plain_interval(draw, values, n_boot, ci):
    """The same draws, one by one."""
    n, means = len(values), []
    for rep in range(1, n_boot + 1):
        raw = b"".join(hashlib.md5(f"{draw}|{rep}|{b}".encode()).digest() for b in range(-(-n // 4)))
        u = np.frombuffer(raw, dtype=">u4")[:n] / 2**32
        means.append(np.asarray(values)[np.floor(u * n).astype(int)].mean())
    return np.quantile(means, [(1 - ci) / 2, (1 + ci) / 2])


def test_bootstrap_same_as_plain_draws_for_any_size(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=30), "b": rng.normal(size=5), "c": rng.normal(size=700), "d": rng.normal(size=9000)}
    rows = [(k, s, float(v)) for k, vs in groups.items() for s, v in enumerate(vs)] + [("e", 1, 2.0)]
    means = spark.createDataFrame(rows, "k string, subject int, mean double")
    got = SC.bootstrap(means, ["k"], 60, 0.9, [7, F.col("k")]).toPandas().set_index("k")
    texts = means.withColumn("subject", F.format_string("s%05d", "subject"))  # no numbers: same order, same draws
    same = SC.bootstrap(texts, ["k"], 60, 0.9, [7, F.col("k")]).toPandas().set_index("k")
    assert sorted(got.index) == sorted(same.index) == sorted(groups)
    for k, values in groups.items():
        for one in (got, same):
            np.testing.assert_allclose(one.loc[k, ["ci_lo", "ci_hi"]].to_numpy(float), plain_interval(f"7|{k}", values, 60, 0.9), rtol=1e-9)


def test_bootstrap_rows_stay_small_and_a_null_is_a_group(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=500)
    means = spark.createDataFrame([(None, s or None, float(v)) for s, v in enumerate(values)], "k string, subject int, mean double")
    got = SC.bootstrap(means, ["k"], 40, 0.95, [7, F.col("k")], block=64, row_draws=128).collect()  # a replicate in several rows
    assert len(got) == 1 and got[0]["k"] is None
    np.testing.assert_allclose([got[0]["ci_lo"], got[0]["ci_hi"]], plain_interval("7|~", values, 40, 0.95), rtol=1e-9)
    assert SC.bootstrap(means.limit(0), ["k"], 40, 0.95, [7, F.col("k")]).count() == 0


def test_axes_count_a_missing_value(spark):
    df = spark.createDataFrame([("m", 0.5, "d", 1), ("m", None, "d", 1)], "mapping string, alpha double, decoder string, subject int")
    assert SC.cell_axes(df) == ["alpha"]
    assert SC.cell_axes(df.where("alpha is null")) == ["mapping"]


def test_fittable_reasons(spark):
    df = spark.createDataFrame([(s, 1.0, float(s), float(s)) for s in range(4)], "subject int, flat double, x double, y double")
    ask = lambda d, y, x: SC.fittable(d, response=y, predictor=x, candidates=("y", "flat")).first()["reason"]
    assert ask(df, "y", "x") is None
    assert "saturated" in ask(df, "flat", "x") and "y" in ask(df, "flat", "x")
    assert "does not vary" in ask(df, "y", "flat")
    assert "levels" in ask(df.where("subject < 2"), "y", "x")


def sweep(seed=1, subjects=9, slope=0.5, noise=0.02):
    rng = np.random.default_rng(seed)
    shift = {"a": 0.0, "b": 0.05, "c": -0.1}
    rows = []
    for s in range(subjects):
        talent = rng.normal(scale=0.1)
        for m, off in shift.items():
            for level in range(6):
                for _ in range(3 + s % 2):
                    acc = 0.4 + 0.1 * level
                    rows.append((s, m, acc, 0.2 + slope * acc + off + talent + rng.normal(scale=noise)))
    return pd.DataFrame(rows, columns=["subject", "mapping", "effective_acc", "response"])


def dense_reml(pdf, levels, theta):
    x = np.column_stack([np.ones(len(pdf)), *[(pdf["mapping"] == v).to_numpy(float) for v in levels[1:]], pdf["effective_acc"]])
    y, g = pdf["response"].to_numpy(), pdf["subject"].to_numpy()
    v = np.eye(len(y)) + theta * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    s2 = r @ vi @ r / (len(y) - x.shape[1])
    value = (len(y) - x.shape[1]) * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return value, beta, np.sqrt(s2 * np.diag(np.linalg.inv(a))), theta * s2


def test_model_equals_a_dense_fit(spark):
    pdf = sweep().iloc[::9].reset_index(drop=True)  # about 60 rows
    levels = ("a", "b", "c")
    lo, hi = np.log(1e-3), np.log(1e4)
    for _ in range(8):  # coarse to fine
        thetas = np.exp(np.linspace(lo, hi, 33))
        best = min(thetas, key=lambda t: dense_reml(pdf, levels, t)[0])
        step = (hi - lo) / 32
        lo, hi = np.log(best) - step, np.log(best) + step
    _, beta, se, group_var = dense_reml(pdf, levels, best)
    got = M.fit_mixed(spark.createDataFrame(pdf), M.Design("effective_acc", "mapping", levels), "response").toPandas().set_index("term")
    order = ["Intercept", "C(mapping)[T.b]", "C(mapping)[T.c]", "effective_acc"]
    np.testing.assert_allclose(got.loc[order, "estimate"], beta, rtol=1e-6)
    np.testing.assert_allclose(got.loc[order, "se"], se, rtol=2e-3)
    assert got["group_var"].iloc[0] == pytest.approx(group_var, rel=5e-3)
    assert got["n_groups"].iloc[0] == 9 and bool(got["converged"].all())


def test_trade_ratio_is_recovered(spark):
    out = M.trade_off(spark.createDataFrame(sweep()), "response", "a", n_boot=60).toPandas().set_index("mapping")
    assert out.loc["b", "estimate"] == pytest.approx(0.1, abs=0.02) and out.loc["c", "estimate"] == pytest.approx(-0.2, abs=0.02)
    assert (out["ci_lo"] <= out["estimate"]).all() and (out["estimate"] <= out["ci_hi"]).all()
    assert (out["n_boot_used"] == 60).all() and not out["unstable"].any()


def test_flat_slope_is_unstable(spark):
    pdf = sweep(slope=0.0, noise=1e-7)
    out = M.trade_off(spark.createDataFrame(pdf), "response", "a", n_boot=5, min_slope=1e-3).first()
    assert out["unstable"] and out["estimate"] is None and out["ci_lo"] is None
    with pytest.raises(ValueError):
        M.levels_of(spark.createDataFrame(pdf), "mapping", "z")


def test_interaction_terms_are_marked(spark):
    got = M.interaction_fit(spark.createDataFrame(sweep()), "response", "effective_acc").toPandas()
    assert sorted(got.loc[got["is_interaction"], "term"]) == ["effective_acc:C(mapping)[T.b]", "effective_acc:C(mapping)[T.c]"]


def test_crossing_where_the_effect_fades(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(9):
        k = 0.3 + 0.05 * s
        for a in (0.0, 0.2, 0.4, 0.6, 0.8):
            for _ in range(8):
                rows.append((s, a, k, max(0.0, 1 - a / 0.6) * 2.0 * k + rng.normal(scale=0.02), 1 - a))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["subject", "alpha", "kappa_offline", "response", "user_contribution_index"]))
    levels = M.slope_by_level(df, "response")
    assert M.crossing(levels).first()["alpha_star"] == pytest.approx(0.6)
    guard = M.guard_fit(df.withColumn("user_contribution_index", F.col("user_contribution_index") + 0.01 * F.col("subject"))).toPandas().set_index("term")
    assert guard.loc["alpha", "estimate"] == pytest.approx(-1.0, abs=1e-6)


def test_a_model_that_cannot_be_fitted_says_why(spark):
    df = spark.createDataFrame([(s, 1.0, float(s)) for s in range(5)], "subject int, x double, y double")
    r = M.fit_mixed(df, M.Design("x"), "y").collect()
    assert len(r) == 1 and r[0]["failed"] and r[0]["term"] is None


def test_lines_need_three_points_and_a_spread(spark):
    df = spark.createDataFrame([("a", 0.0, 0.5), ("a", 1.0, 1.5), ("a", 2.0, 2.5), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, x double, y double")
    rows = M.lines(df, ["k"], "x", "y", (0.0, 1.0)).collect()
    assert len(rows) == 1 and rows[0]["slope"] == pytest.approx(1.0)
    assert (rows[0]["x_lo"], rows[0]["x_hi"]) == (0.0, pytest.approx(0.5))


def test_a_subject_drawn_twice_is_two_groups(spark):
    df = spark.createDataFrame([(s, float(s)) for s in range(4) for _ in range(3)], "subject int, v double")
    draws = G.draw_subjects(df, 20, 3)
    per = draws.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("resampled").alias("g"), F.countDistinct("subject").alias("s")).collect()
    assert len(per) == 20 and all(r["n"] == 4 and r["g"] == 4 for r in per) and any(r["s"] < 4 for r in per)
    assert G.resample(df, draws).count() == 20 * 4 * 3


def test_conditions_equal(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.25), (2, "b", 0.25), (3, "a", 0.1)], "k int, c string, v double")
    ask = lambda d: SC.conditions_equal(d, ["k"], F.col("c") == "a", F.col("c") == "b", ["v"]).first()
    assert ask(df)["passed"] and ask(df)["n_keys"] == 2
    assert not ask(df.withColumn("v", F.when((F.col("k") == 2) & (F.col("c") == "b"), 0.3).otherwise(F.col("v"))))["passed"]


def test_model_report_has_every_part(spark):
    from kymora.plans import queries_scores as Q

    got = Q.model_report(spark, "/root/testdata/sf0.001").collect()
    assert {r["block"] for r in got} >= {"interaction", "trade ratio", "slope by autonomy", "alpha star", "guard", "gate", "dropped rows", "response"}
    assert [r["estimate"] for r in got if r["block"] == "dropped rows"] == [0.0]
    assert "alpha" in {r["name"] for r in got if r["block"] == "guard"}
