import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kymora.operators import features as FE
from kymora.operators import learners as LE
from kymora.operators import spatial as SP


def flat(m):
    return [float(m[i, j]) for i, j in FE.pairs(len(m))]


def planted(rng, n=90, p=4, classes=3, samples=200):
    """Windows of mixed sources; source k swings five times as far in class k."""
    mix = rng.normal(size=(p, p)) + 2 * np.eye(p)
    rows = []
    for w in range(n):
        scale = np.ones(p)
        scale[w % classes] = 5.0
        x = mix @ (scale[:, None] * rng.normal(size=(p, samples)))
        rows.append((w, w % classes, np.cov(x, bias=True), x))
    return mix, rows


def table(spark, rows):
    return spark.createDataFrame([(k, w, y, None if c is None else flat(c)) for k, w, y, c in rows], "k string, window int, label int, cov array<double>").repartition(3)


def test_planted_sources_are_found(spark):
    mix, rows = planted(np.random.default_rng(21))
    df = table(spark, [("a", w, y, c) for w, y, c, _ in rows])
    fitted = {r["label"]: r for r in SP.fit_spatial(df, ["k"], "label", 4, components=2).collect()}
    back = np.linalg.inv(mix)
    for y, r in fitted.items():
        w = np.array(r["filters"][0])
        assert r["status"] == "fitted" and r["ratios"][0] > 0.8 and r["n"] == 30
        through = w @ mix  # weights of the sources: nearly only the planted one
        assert abs(through[y]) > 5 * np.abs(np.delete(through, y)).max()
        assert abs(w @ back[y]) / np.linalg.norm(w) / np.linalg.norm(back[y]) > 0.97
    out = SP.spatial_log_power(df, SP.fit_spatial(df, ["k"], "label", 4, components=1), ["k"], "label", 4).toPandas()
    assert (np.stack(out["features"]).argmax(1) == out["label"]).mean() > 0.97


def test_same_as_the_eigenproblem_and_the_samples(spark):
    _, rows = planted(np.random.default_rng(22), n=31)
    df = table(spark, [("a", w, y, c) for w, y, c, _ in rows])
    fitted = SP.fit_spatial(df, ["k"], "label", 4, components=4).orderBy("label").collect()
    means = [np.mean([c for _, y, c, _ in rows if y == k], axis=0) for k in range(3)]
    for k, r in enumerate(fitted):
        rest = np.mean([means[j] for j in range(3) if j != k], axis=0)
        want = np.linalg.eigvals(np.linalg.solve(means[k] + rest, means[k])).real
        np.testing.assert_allclose(sorted(r["ratios"]), sorted(want), rtol=1e-8)
        for ratio, w in zip(r["ratios"], np.array(r["filters"]), strict=True):
            np.testing.assert_allclose(means[k] @ w, ratio * (means[k] + rest) @ w, atol=1e-8)
            assert w @ (means[k] + rest) @ w == pytest.approx(1.0) and w[np.abs(w).argmax()] > 0
        far = np.abs(np.array(r["ratios"]) - 0.5)
        assert (np.diff(far) <= 1e-9).all()
    got = {r["window"]: r["features"] for r in SP.spatial_log_power(df, spark.createDataFrame(fitted), ["k"], "label", 4).collect()}
    for w, _, _, x in rows:
        want = [np.log(np.var(np.array(f) @ x)) for r in fitted for f in r["filters"]]
        np.testing.assert_allclose(got[w], want, rtol=1e-8)


def test_odd_rows(spark):
    one, zero = np.diag([1.0, 2.0]), np.zeros((2, 2))
    rows = [("one class", 0, 1, one), ("flat", 0, 0, zero), ("flat", 1, 1, zero), (None, 0, 0, one), (None, 1, 1, np.diag([2.0, 1.0])), (None, 2, None, 9 * one)]
    rows += [(None, 3, 0, None), (None, 4, 1, np.array([[np.nan, 0], [0, 1]])), ("half", 0, 0, np.diag([1.0, 0])), ("half", 1, 1, np.diag([3.0, 0])), ("new", 0, None, one)]
    df = table(spark, rows)
    fitted = SP.fit_spatial(df, ["k"], "label", 2)
    got = {(r["k"], r["label"]): r for r in fitted.collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        ("one class", 1): "one class", ("flat", 0): "no variance", ("flat", 1): "no variance",
        (None, 0): "fitted", (None, 1): "fitted", ("half", 0): "fitted", ("half", 1): "fitted",
    }
    assert got[None, 0]["n"] == 1 and got["one class", 1]["filters"] is None
    assert got["half", 0]["ratios"] == pytest.approx([0.25]) and got["half", 0]["filters"][0] == pytest.approx([0.5, 0])
    out = {(r["k"], r["window"]): r for r in SP.spatial_log_power(df, fitted, ["k"], "label", 2).collect()}
    assert len(out) == len(rows)
    assert {k: r["spatial_status"] for k, r in out.items() if r["spatial_status"] != "fitted"} == {
        ("one class", 0): "no model", ("flat", 0): "no model", ("flat", 1): "no model", ("new", 0): "no model", (None, 3): "no covariance", (None, 4): "no covariance",
    }
    assert out[None, 3]["features"] is None and len(out[None, 2]["features"]) == 4 and out["half", 0]["features"] == pytest.approx([np.log(0.25)] * 2)
    assert SP.fit_spatial(df.limit(0), ["k"], "label", 2).count() == 0 and SP.spatial_log_power(df.limit(0), fitted, ["k"], "label", 2).count() == 0


def test_filters_are_kept_and_loaded(spark, tmp_path):
    _, rows = planted(np.random.default_rng(23), n=24)
    df = table(spark, [("a" if w < 18 else "b", w, y, c) for w, y, c, _ in rows])
    model = LE.SpatialFilters(keys=["k"], outputCol="power", size=4, components=2).fit(df.where("k = 'a'"))
    model.save(f"{tmp_path}/s")
    fresh, kept = (m.transform(df).orderBy("window").toPandas() for m in (model, LE.SpatialFiltersModel.load(f"{tmp_path}/s")))
    pd.testing.assert_frame_equal(fresh, kept)
    assert fresh["power"][:18].map(len).eq(6).all() and fresh["power"][18:].isna().all()


def test_plain_covariance(spark):
    x = np.random.default_rng(24).normal(size=(32, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["c0", "c1", "c2"]).assign(k=1, sample_idx=np.arange(32)))
    (row,) = FE.covariances(df, ["k"], 3, 32, 32, shrink=False).collect()
    np.testing.assert_allclose(row["cov"], flat(np.cov(x.T, bias=True)), rtol=1e-9)
    assert row["shrinkage"] == 0.0
