"""Ordered primitives against pandas, with buckets far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymora.operators import series


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    parts = []
    for key, n in (("hot", 500), ("b", 37), ("c", 1)):
        t = np.sort(rng.choice(5000, n, replace=False))
        v = rng.normal(size=n)
        parts.append(pd.DataFrame({"key": key, "t": t, "v": v, "some": np.where(rng.random(n) < 0.3, v, np.nan)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    d = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    return d.withColumn("some", F.when(F.isnan("some"), None).otherwise(F.col("some"))).repartition(5)


def test_dense_index_matches_cumcount(df, frame):
    got = series.dense_index(df, ["key"], ["t"], F.floor(F.col("t") / 50), "i").toPandas().sort_values(["key", "t"])
    want = frame.sort_values(["key", "t"])
    assert got["i"].tolist() == want.groupby("key").cumcount().tolist()


@pytest.mark.parametrize("width", [7, 1000000])
def test_scan_last_max_sum(df, frame, width):
    outputs = {"last": ("last", F.col("some")), "top": ("max", F.col("v")), "total": ("sum", F.col("v"))}
    got = series.scan(df, ["key"], ["t"], F.floor(F.col("t") / width), outputs).toPandas().sort_values(["key", "t"]).reset_index(drop=True)
    want = frame.sort_values(["key", "t"]).reset_index(drop=True)
    g = want.groupby("key")
    np.testing.assert_allclose(got["last"].astype(float), g["some"].transform(lambda s: s.ffill().shift()), equal_nan=True)
    np.testing.assert_allclose(got["top"].astype(float), g["v"].transform(lambda s: s.cummax().shift()), equal_nan=True)
    np.testing.assert_allclose(got["total"].astype(float), g["v"].transform(lambda s: s.cumsum().shift().fillna(0)), atol=1e-12)


def test_lagged_crosses_buckets(df, frame):
    placed = series.dense_index(df, ["key"], ["t"], F.lit(0), "i")
    got = series.lagged(placed, ["key"], "i", {"before": F.col("v")}, rows=8).toPandas().sort_values(["key", "t"])
    want = frame.sort_values(["key", "t"]).groupby("key")["v"].shift()
    assert len(got) == len(frame)
    np.testing.assert_allclose(got["before"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.9])
def test_moving_mean_matches_pandas(df, frame, alpha):
    placed = series.dense_index(df, ["key"], ["t"], F.lit(0), "i")
    got = series.ewm_mean(placed, ["key"], "i", F.col("v"), alpha, "m").toPandas().sort_values(["key", "t"])
    want = frame.sort_values(["key", "t"]).groupby("key")["v"].transform(lambda s: s.ewm(alpha=alpha).mean())
    np.testing.assert_allclose(got["m"], want, atol=1e-10)


def test_moving_standardise_matches_pandas(df, frame):
    placed = series.dense_index(df, ["key"], ["t"], F.lit(0), "i")
    got = series.moving_standardise(placed, ["key"], "i", "v", 0.05, 20, 1e-4, "z").toPandas().sort_values(["key", "t"])

    def one(s):
        m = s.ewm(alpha=0.05).mean()
        dev = s - m
        z = dev / np.maximum(1e-4, np.sqrt((dev * dev).ewm(alpha=0.05).mean()))
        head = s.iloc[:20]
        z.iloc[:20] = (head - head.mean()) / max(1e-4, head.std(ddof=0))
        return z

    want = frame.sort_values(["key", "t"]).groupby("key")["v"].transform(one)
    np.testing.assert_allclose(got["z"], want, atol=1e-5)


def test_fold_does_not_depend_on_chunks(df):
    placed = series.dense_index(df, ["key"], ["t"], F.lit(0), "i")

    def step(state, row):
        total = 0.9 * state[0] + abs(row[0])
        return ([0.0], (1, total)) if total > 4 else ([total], (0, total))

    fields = [("fired", T.IntegerType()), ("total", T.DoubleType())]
    whole, cut = (
        series.ordered_fold(placed, ["key"], "i", ["v"], 1, fields, step, rows).orderBy("key", "i").toPandas() for rows in (10**6, 16)
    )
    pd.testing.assert_frame_equal(whole, cut[whole.columns])
    assert whole["fired"].sum() > 5


def test_bad_parameters_are_refused(df):
    with pytest.raises(ValueError):
        series.ewm_mean(df, ["key"], "t", F.col("v"), 0.0, "m")
    with pytest.raises(ValueError):
        series.scan(df, ["key"], ["t"], F.lit(0), {"x": ("median", F.col("v"))})
