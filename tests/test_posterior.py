import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kymora.operators import posterior as P


def table(seed, bursts=12, per=7):
    rng = np.random.default_rng(seed)
    label = np.repeat(rng.integers(0, 4, bursts), per)
    logits = rng.normal(size=(bursts * per, 4))
    logits[np.arange(len(label)), label] += 0.8
    p = np.exp(logits)
    p = (p / p.sum(1, keepdims=True)).astype(np.float32)
    return p, label


def frame(spark, seed, subject=1):
    p, label = table(seed)
    pdf = pd.DataFrame({
        "window_id": range(len(label)), "subject": subject, "burst_id": np.arange(len(label)) // 7,
        "t_rel": 2.0 + 0.25 * (np.arange(len(label)) % 7), "label": label, "posterior": [r.tolist() for r in p],
    })
    return spark.createDataFrame(pdf).withColumn("posterior", F.col("posterior").cast("array<float>"))


def accuracy_at(p, label, lam):
    hot = np.eye(4)[label]
    return float((np.argmax((lam * hot + (1 - lam) * p.astype(float)).astype(np.float32), 1) == label).mean())


def bisected(p, label, target):
    if target <= accuracy_at(p, label, 0.0):
        return 0.0
    low, high = 0.0, 1.0
    while high - low >= 1e-3:
        mid = (low + high) / 2
        low, high = (low, mid) if accuracy_at(p, label, mid) >= target else (mid, high)
    return high


def test_quality_levels_equal_a_bisection(spark):
    df = frame(spark, 1, 1).unionByName(frame(spark, 2, 2)).unionByName(frame(spark, 3, 3))
    for mode, levels in (("gap_fraction", (0.0, 0.2, 0.5, 0.8, 1.0)), ("absolute", (0.3, 0.75, 0.9, 1.0))):
        for r in P.quality_levels(df, ["subject"], levels, mode).collect():
            p, label = table(r["subject"])
            base = accuracy_at(p, label, 0.0)
            target = base + r["level"] * (1 - base) if mode == "gap_fraction" else r["level"]
            assert r["lam"] == bisected(p, label, target)
            assert r["achieved_accuracy"] == pytest.approx(accuracy_at(p, label, r["lam"]))


def test_mixing_ends(spark):
    df = frame(spark, 4)
    done = df.withColumn("posterior", P.mixed(F.col("posterior"), F.col("label"), 1.0))
    assert P.accuracy(done, ["subject"]).first()["accuracy"] == 1.0
    same = df.withColumn("m", P.mixed(F.col("posterior"), F.col("label"), 0.0))
    assert same.where(F.col("m") != F.col("posterior")).count() == 0


def test_smoothing_keeps_the_winner(spark):
    df = frame(spark, 5)
    both = df.withColumn("s", P.smoothed(F.col("posterior"), 0.3))
    assert P.accuracy(both, ["subject"]).first() == P.accuracy(both, ["subject"], "s").first()
    with pytest.raises(ValueError):
        P.smoothed(F.col("posterior"), 1.5)


def test_jitter_clamps_inside_the_burst(spark):
    got = P.jittered(frame(spark, 6), 2).orderBy("window_id").toPandas()
    src = frame(spark, 6).orderBy("window_id").toPandas()
    for b, block in got.groupby("burst_id"):
        original = src[src["burst_id"] == b]["posterior"].tolist()
        assert [list(x) for x in block["posterior"]] == [list(original[max(i - 2, 0)]) for i in range(len(original))]


def test_burst_errors_hold_one_wrong_class(spark):
    df = frame(spark, 7)
    got = P.burst_errors(df, 9, 0.3, 3.0).orderBy("window_id").toPandas()
    src = df.orderBy("window_id").toPandas()
    hit = got["held_class"] >= 0
    assert 0 < hit.sum() < len(got)
    assert (got.loc[hit, "held_class"] != got.loc[hit, "label"]).all()
    for i in got.index[hit]:
        p = np.asarray(got.at[i, "posterior"])
        assert p.argmax() == got.at[i, "held_class"] and p.max() == pytest.approx(max(src.at[i, "posterior"]))
        assert p.sum() == pytest.approx(1.0, abs=1e-5)
    chunked = P.burst_errors(df, 9, 0.3, 3.0, chunk_rows=2).orderBy("window_id").toPandas()
    assert chunked["held_class"].tolist() == got["held_class"].tolist()
    assert P.burst_errors(df, 9, 0.0, 3.0).where("held_class >= 0").count() == 0


def test_draws_do_not_depend_on_partitioning(spark):
    df = frame(spark, 8)
    a, b = (P.burst_errors(df.repartition(n), 1, 0.3, 2.0).orderBy("window_id").toPandas()["held_class"].tolist() for n in (1, 7))
    assert a == b


def test_agreement_by_hand(spark):
    df = spark.createDataFrame([(0, 0)] * 4 + [(0, 1)] * 1 + [(1, 1)] * 3 + [(1, 0)] * 2, "y int, z int")
    r = P.agreement(df, [], "y", "z").first()
    assert r["accuracy"] == pytest.approx(0.7)
    assert r["kappa"] == pytest.approx((0.7 - 0.5) / 0.5)


def test_unknown_names_are_refused(spark):
    df = frame(spark, 1)
    with pytest.raises(ValueError):
        P.quality_levels(df, ["subject"], [0.5], "other")
    with pytest.raises(ValueError):
        P.with_error_structure(df, "other")
    with pytest.raises(ValueError):
        P.quality_levels(df, ["subject"], [1.5])
