import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from kymora.functions import vectors as V
from kymora.operators import features as FE
from kymora.operators import learners as LE
from kymora.operators import logistic
from kymora.operators import splits as L


def table(spark, seed=3, n=600, p=5, subjects=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    s = rng.integers(1, subjects + 1, n)
    x = rng.normal(size=(n, p)) + np.eye(3, p)[y] * s[:, None]
    return spark.createDataFrame(pd.DataFrame({"row": np.arange(n), "subject": s, "label": y, "x": x.tolist()})).repartition(4)


def posteriors(df, name="row"):
    return {r[name]: (None if r["posterior"] is None else np.array(r["posterior"]), r["model_status"]) for r in df.collect()}


def test_every_key_equals_its_own_fit_of_the_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    df = table(spark)
    model = {r["subject"]: r for r in logistic.fit_logistic(df, ["subject"], "x", "label", 5, c=0.7).collect()}
    assert all(r["converged"] and r["reason"] is None and r["steps"] < 15 for r in model.values())
    for subject, got in model.items():
        own = df.where(F.col("subject") == subject)
        data = own.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
        want = LogisticRegression(family="multinomial", regParam=1 / (0.7 * own.count()), standardization=False, tol=1e-14, maxIter=1000).fit(data)
        np.testing.assert_allclose(got["weights"], want.coefficientMatrix.toArray(), atol=1e-6)
        np.testing.assert_allclose(got["bias"], want.interceptVector.toArray(), atol=1e-6)


def test_partitions_and_blocks_do_not_matter(spark, monkeypatch):
    df = table(spark)
    one = {r["subject"]: np.array(r["weights"]) for r in logistic.fit_logistic(df, ["subject"], "x", "label", 5).collect()}
    monkeypatch.setattr(logistic, "BLOCK_NUMBERS", 20)
    monkeypatch.setattr(logistic, "PIECE", 7)
    monkeypatch.setattr(logistic, "HELD", 100)
    two = {r["subject"]: np.array(r["weights"]) for r in logistic.fit_logistic(df.coalesce(1), ["subject"], "x", "label", 5).collect()}
    for k in one:
        np.testing.assert_allclose(one[k], two[k], atol=1e-9)


def test_halved_steps_reach_the_optimum(spark):
    """Full Newton steps overshoot on nearly separable data of a large scale."""
    rng = np.random.default_rng(1)
    y = np.arange(200) % 2
    x = (50 * (y * 2 - 1) + rng.normal(size=200))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"label": y, "x": x.tolist()}))
    r = logistic.fit_logistic(df, [], "x", "label", 1, c=1e4).first()
    w = np.array([[*a, b] for a, b in zip(r["weights"], r["bias"], strict=True)])
    p, _ = logistic._probabilities(x, w)
    p[np.arange(200), y] -= 1
    assert r["converged"] and np.abs(p.T @ x + w[:, :1] / 1e4).max() < 1e-5


@pytest.mark.parametrize("name", ["discriminant", "logistic"])
def test_rows_without_a_model_stay(spark, name):
    rng = np.random.default_rng(2)
    rows = [(i, k, i // 2 % 2, (rng.normal(size=3) + 4 * (i // 2 % 2)).tolist()) for i, k in enumerate(["a", None] * 40)]
    train = spark.createDataFrame([*rows, (900, "flat", 0, [1.0, 2.0, 3.0]), (901, "flat", 1, [1.0, 2.0, 3.0]), (902, "single", 1, [0.0] * 3)], "row int, k string, label int, x array<double>")
    asked = spark.createDataFrame([*rows[:6], (100, "b", 0, [0.0] * 3), (101, "a", 0, None), (102, "flat", 0, [1.0, 2.0, 3.0]), (103, "a", 0, [0.0, None, 1.0]), (104, "single", 0, [1.0] * 3)], "row int, k string, label int, x array<double>")
    got = posteriors(FE.decode(name, train, asked, ["k"], "x", "label", 3))
    assert len(got) == 11
    for i in range(6):
        assert got[i][1] == "ok" and got[i][0].argmax() == i // 2 % 2
    assert got[100] == (None, "no model") and got[101] == (None, "no features") and got[103] == (None, "no features")
    if name == "discriminant":
        assert got[102] == (None, "no spread within classes")
    else:
        assert got[104][1] == "one class" and got[104][0].tolist() == [0.0, 1.0]


def test_all_keys_without_train_rows(spark):
    df = table(spark)
    out = posteriors(FE.decode("logistic", df.limit(0), df, ["subject"], "x", "label", 5))
    assert len(out) == 600 and all(v == (None, "no model") for v in out.values())
    with pytest.raises(KeyError):
        FE.decode("other", df, df, [], "x", "label", 5)


@pytest.mark.parametrize("kind", [LE.DiscriminantDecoder, LE.LogisticDecoder])
def test_saved_and_loaded_decoder_gives_the_same(spark, tmp_path, kind):
    df = table(spark)
    decoder = kind(keys=["subject"], featuresCol="x", labelCol="label", size=5)
    decoder.save(f"{tmp_path}/estimator")
    again = kind.load(f"{tmp_path}/estimator")
    assert again.getKeys() == ["subject"] and again.getSize() == 5
    fitted = decoder.fit(df.where("subject < 3"))
    fitted.save(f"{tmp_path}/model")
    loaded = LE.LinearDecoderModel.load(f"{tmp_path}/model")
    a, b = posteriors(fitted.transform(df)), posteriors(loaded.transform(df))
    c = posteriors(again.fit(df.where("subject < 3")).transform(df))
    for i, (p, status) in a.items():
        assert b[i][1] == c[i][1] == status
        if p is not None:
            assert (b[i][0] == p).all() and np.allclose(c[i][0], p, atol=1e-6)
    assert {s for _, s in a.values()} == {"ok", "no model"}


def test_pipeline_of_scaling_and_decoding_is_kept(spark, tmp_path):
    rng = np.random.default_rng(7)
    n = 400
    y = np.arange(n) % 2
    pdf = pd.DataFrame({"row": np.arange(n), "subject": y * 0 + np.arange(n) % 3, "label": y, "u": 100 + 10 * rng.normal(size=n) + 30 * y, "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).withColumn("x", F.array("u", "v"))
    scaled = LE.KeyedScaler(keys=["subject"], inputCols=["u", "v"])
    from pyspark.ml.feature import SQLTransformer

    stages = [scaled, SQLTransformer(statement="SELECT *, array(u, v) AS z FROM __THIS__"), LE.LogisticDecoder(keys=["subject"], featuresCol="z", labelCol="label", size=2)]
    model = Pipeline(stages=stages).fit(df)
    out = model.transform(df)
    assert out.where(V.argmax_class(F.col("posterior")) == F.col("label")).count() > 0.9 * n
    model.save(f"{tmp_path}/pipeline")
    loaded = PipelineModel.load(f"{tmp_path}/pipeline")
    a, b = posteriors(out), posteriors(loaded.transform(df))
    assert all((a[i][0] == b[i][0]).all() for i in a)


def test_scaling_keeps_null_keys_and_keys_without_train_rows(spark):
    rows = [(1, "a", "T", 1.0), (2, "a", "T", 3.0), (3, "a", "E", 5.0), (4, None, "T", 2.0), (5, None, "E", 4.0), (6, "b", "E", 1.0)]
    df = spark.createDataFrame(rows, "i int, k string, session string, x double")
    got = {r["i"]: (r["x"], r["scaling_status"]) for r in L.standardise_on_train(df, ["x"], F.col("session") == "T", ["k"]).collect()}
    assert got == {1: (-1.0, "ok"), 2: (1.0, "ok"), 3: (3.0, "ok"), 4: (0.0, "ok"), 5: (2.0, "ok"), 6: (None, "no train rows")}


def reference_mean(mats):
    """Plain gradient descent with small steps."""
    def fun(m, f):
        w, q = np.linalg.eigh(m)
        return (q * f(w)) @ q.T

    g = sum(mats) / len(mats)
    for _ in range(400):
        root, inv = fun(g, np.sqrt), fun(g, lambda w: w**-0.5)
        t = sum(fun(inv @ m @ inv, np.log) for m in mats) / len(mats)
        g = root @ fun(0.2 * t, np.exp) @ root
    return g


def test_mean_of_a_wide_spread_settles(spark):
    rng = np.random.default_rng(11)

    def wide(n, scale):
        out = []
        for _ in range(n):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            out.append((q * np.exp(scale * rng.normal(size=3))) @ q.T)
        return out

    groups = {"narrow": wide(8, 0.3), "wide": wide(12, 1.8), None: wide(3, 2.0)}
    rows = [(k, [float(m[i, j]) for i, j in FE.pairs(3)]) for k, ms in groups.items() for m in ms]
    got = {r["k"]: FE._square(r["ref"], 3) for r in FE.geometric_mean(spark.createDataFrame(rows, "k string, cov array<double>"), ["k"], 3, 1e-3).collect()}
    assert set(got) == set(groups)
    for k, ms in groups.items():
        np.testing.assert_allclose(got[k], reference_mean(ms), rtol=2e-2, atol=1e-3)


def test_tangent_space_model(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(i, i % 2, [float(m[a, b]) for a, b in FE.pairs(2)]) for i in range(12) for m in [(lambda z: z @ z.T + np.eye(2))(rng.normal(size=(2, 2)))]]
    df = spark.createDataFrame(rows, "i int, k int, m array<double>")
    model = LE.TangentSpace(keys=["k"], inputCol="m", outputCol="t", size=2).fit(df.where("k = 0"))
    model.save(f"{tmp_path}/t")
    out = {r["i"]: r["t"] for r in LE.TangentSpaceModel.load(f"{tmp_path}/t").transform(df).collect()}
    assert all(out[i] is None for i in range(1, 12, 2))
    assert np.allclose(np.mean([out[i] for i in range(0, 12, 2)], axis=0), 0, atol=1e-6)


def test_information_from_quantile_bins(spark):
    rng = np.random.default_rng(13)
    n = 500
    y = rng.integers(0, 3, n)
    x = np.stack([np.exp(9 * rng.normal(size=n)) + y, np.round(rng.normal(size=n)), np.full(n, 7.0), rng.normal(size=n) * 1e-9 + y], 1)
    x[5, 0], x[6, 0] = np.inf, -np.inf
    df = spark.createDataFrame(pd.DataFrame({"label": y, "x": x.tolist()})).repartition(5)
    got = {r["feature"]: r["information"] for r in FE.mutual_information(df, "x", "label", bins=8, slots=16).collect()}
    for f in range(4):
        rank = np.array([(x[:, f] < v).sum() for v in x[:, f]])
        joint = pd.crosstab(rank * 8 // n, y).to_numpy() / n
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.nansum(joint * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))))
        assert got[f] == pytest.approx(want, abs=1e-9)
