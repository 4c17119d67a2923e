import math

import pytest
from pyspark.sql import functions as F

from kymora.functions import responses as X
from kymora.functions import vectors as V
from kymora.operators import asof
from kymora.operators import commands as C
from kymora.operators import trace as TR


def velocities(spark, headings, target=0, hold=5):
    steps = [(1, i * hold + j + 1, target, math.cos(math.radians(h)), math.sin(math.radians(h))) for i, h in enumerate(headings) for j in range(hold)]
    return spark.createDataFrame(steps, "episode_id int, step bigint, target_idx int, vx double, vy double")


@pytest.mark.parametrize("headings,want", [([0, 180, 0, 180], 3), ([0, 45, 90], 0), ([0, 90], 0), ([0, 91], 1), ([0], 0)])
def test_reversals_by_hand(spark, headings, want):
    assert TR.mean_reversals(velocities(spark, headings)).first()["direction_reversals"] == want


def test_reversals_skip_still_rows_and_average_targets(spark):
    a = velocities(spark, [0, 180])
    still = a.withColumn("vx", F.when(F.col("step").between(4, 7), 0.0).otherwise(F.col("vx"))).withColumn("vy", F.when(F.col("step").between(4, 7), 0.0).otherwise(F.col("vy")))
    quiet = spark.createDataFrame([(1, 100, 3, 0.0, 0.0)], a.schema)
    assert TR.mean_reversals(still.unionByName(quiet)).first()["direction_reversals"] == 0.5


def test_contribution(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 0.0, 2.0, 0.0, True), (1, 0.0, 1.0, 0.0, -1.0, True), (1, 0.0, 0.0, 1.0, 0.0, True), (1, 1.0, 0.0, 1.0, 0.0, False), (2, 1.0, 0.0, 0.0, 0.0, True)],
        "k int, ix double, iy double, vx double, vy double, m boolean",
    )
    uci, out = TR.contribution(F.col("m"))
    got = {r["k"]: (r["u"], r["o"]) for r in df.groupBy("k").agg(uci.alias("u"), out.alias("o")).collect()}
    assert got[1] == (pytest.approx(0.0), pytest.approx(1 / 3)) and got[2] == (None, 1.0)


def outcomes(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "episode_id int, acquired boolean, duration_s double, path_length double, straight_line double, collisions int")


def test_outcome_metrics(spark):
    o = outcomes(spark, [(True, 10.0, 2.0, 1.0, 1), (True, 20.0, 1.0, 0.0, 0), (False, 600.0, 9.0, 1.0, 2), (True, 4.0, 0.0, 0.0, 0)])
    r = TR.outcome_metrics(o, 8).first()
    assert (r["n_success"], r["n_timeouts"], r["collisions"], r["success_rate"]) == (3, 1, 3, 0.375)
    assert r["path_efficiency"] == pytest.approx((0.5 + 1.0) / 2)
    m = TR.median_time(o).first()
    assert (m["time_to_target_median"], m["time_to_target_excluded"]) == (10.0, 1)
    none = outcomes(spark, [(False, 600.0, 9.0, 1.0, 2)])
    assert TR.median_time(none).first()["time_to_target_median"] is None
    assert TR.outcome_metrics(none, 8).first()["path_efficiency"] is None


@pytest.mark.parametrize("rate,seconds,want", [(1.0, 60.0, 24.0), (0.125, 60.0, 0.0), (0.05, 60.0, 0.0), (0.5, 60.0, None), (1.0, 0.0, "null")])
def test_information_rate(spark, rate, seconds, want):
    got = spark.range(1).select(X.information_rate(F.lit(rate), 8, F.lit(seconds)).alias("b")).first()["b"]
    if want is None:
        want = (3 + 0.5 * math.log2(0.5) + 0.5 * math.log2(0.5 / 7)) * 8
    assert got is None if want == "null" else got == pytest.approx(want)


def test_half_count_logit(spark):
    r = spark.range(1).select(X.transformed(F.lit(1.0), "logit", 8).alias("a"), X.transformed(F.lit(1.2), "logit", 8).alias("b"), X.transformed(F.lit(0.0), "log", 8).alias("c")).first()
    assert r["a"] == pytest.approx(math.log(8.5 / 0.5)) and r["b"] is None and r["c"] is None


def test_dwell_starts_again_after_leaving(spark):
    flags = [1, 1, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([(1, i + 1, 0, bool(f)) for i, f in enumerate(flags)], "episode_id int, step bigint, target_idx int, inside boolean")
    r = TR.first_dwell(df, F.col("inside"), 0.1, 0.3).first()
    assert (r["longest_hold"], r["acquired_step"], r["acquired"]) == (3, 6, True)
    assert TR.entries(df, F.col("inside"), ["episode_id"]).first()["n_entries"] == 2


def test_latest_value_after_latency(spark):
    v = spark.createDataFrame([(1, 2.0, "a"), (1, 2.25, "b"), (1, 2.5, "c")], "k int, t double, x string")
    p = spark.createDataFrame([(1, n) for n in (2.0, 2.25, 2.4, 2.75, 9.0)] + [(2, 5.0)], "k int, now double")
    got = sorted(((r["k"], r["now"]), r["x"]) for r in asof.latest_available(v, p, ["k"], "t", "now", 0.25, ["x"]).collect())
    assert got == [((1, 2.0), None), ((1, 2.25), "a"), ((1, 2.4), "a"), ((1, 2.75), "c"), ((1, 9.0), "c"), ((2, 5.0), None)]
    with pytest.raises(ValueError):
        asof.latest_available(v, p, ["k"], "t", "now", -1.0, ["x"])


def test_equal_posteriors_are_two_updates(spark):
    s = spark.createDataFrame([(1, i, w) for i, w in enumerate([None, 5, 5, 6, None, 6])], "k int, step bigint, window_id bigint")
    got = [r["decoder_update"] for r in asof.mark_updates(s, ["k"], "step", "window_id").orderBy("step").collect()]
    assert got == [False, True, False, True, False, True]


def posteriors(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, posterior array<double>").withColumn("posterior", F.col("posterior").cast("array<float>"))


def test_stateless_mappings(spark):
    df = posteriors(spark, [[0.25] * 4, [0.0, 1.0, 0.0, 0.0], [0.5, 0.5, 0.0, 0.0]])
    a = C.apply_mapping("s1_argmax", df).orderBy("i").collect()
    assert [(r["ux"], r["uy"]) for r in a] == [(-0.15, 0.0), (0.15, 0.0), (-0.15, 0.0)]
    w = C.apply_mapping("s2_weighted", df).orderBy("i").collect()
    assert [r["ux"] for r in w] == pytest.approx([0.0, 0.15, 0.0])
    h = df.select(V.normalised_entropy(F.col("posterior")).alias("h")).collect()
    assert [r["h"] for r in h] == pytest.approx([1.0, 0.0, 0.5])
    with pytest.raises(KeyError):
        C.apply_mapping("s9", df)


def test_missing_posterior_gives_zero_and_a_flag(spark):
    df = spark.createDataFrame([(None,)], "posterior array<float>")
    r = C.apply_mapping("s1_argmax", df).first()
    assert (r["ux"], r["uy"], r["has_command"]) == (0.0, 0.0, False)


def test_shared_control(spark):
    df = posteriors(spark, [[0.0, 1.0, 0.0, 0.0], [0.1, 0.2, 0.3, 0.4]]).withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0)).withColumn("target_idx", F.lit(2))
    ring = V.ring(8)
    none = C.apply_mapping("s4_shared", df, targets=ring, alpha=0.0).orderBy("i").collect()
    user = C.apply_mapping("s2_weighted", df).orderBy("i").collect()
    assert [(r["ux"], r["uy"]) for r in none] == [(r["ux"], r["uy"]) for r in user]
    full = C.apply_mapping("s4_shared", df, targets=ring, obstacles=(), alpha=1.0, intent_mode="blind").collect()
    for r in full:
        assert (r["ux"], r["uy"]) == (pytest.approx(0.0, abs=1e-12), pytest.approx(0.15))
    aware = C.apply_mapping("s4_shared", df, targets=ring, obstacles=(), alpha=1.0).orderBy("i").first()
    assert aware["aim"] == 0 and aware["ux"] == pytest.approx(0.15)
    with pytest.raises(ValueError):
        C.apply_mapping("s4_shared", df, targets=ring, intent_mode="other")


def test_aim_outside_the_window_is_null(spark):
    df = posteriors(spark, [[0.0, 1.0, 0.0, 0.0], [0.25] * 4])
    aim = C.attractive_target(F.lit(0.0), F.lit(0.0), F.col("posterior"), [(-1.0, 0.0), (0.0, 1.0)], 60.0)
    assert [r["a"] for r in df.orderBy("i").select(aim.alias("a")).collect()] == [None, None]


def test_repulsion_reaches_to_d0(spark):
    x, y = C.repulsion(F.lit(0.2), F.lit(0.0), [(0.0, 0.0), (5.0, 0.0)], 0.02, 0.35)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(0.02 * (1 / 0.2 - 1 / 0.35)) and r["y"] == 0.0


def test_evidence_by_hand(spark):
    p = [[0.7, 0.1, 0.1, 0.1], [0.25] * 4, [0.25] * 4, [0.05, 0.05, 0.1, 0.8]]
    df = posteriors(spark, p).withColumn("k", F.lit(1))
    got = C.accumulate_evidence(df, ["k"], ["i"], F.lit(0)).orderBy("i").collect()
    e, want = [0.0] * 4, []
    for row in p:
        e = [0.8 * a + math.log(float(b) + 1e-6) for a, b in zip(e, row, strict=True)]
        top = max(e)
        want.append(e.index(top) if top > -1 else -1)
        if top > -1:
            e = [0.0] * 4
    assert [r["emitted"] for r in got] == want and want[0] == 0


def test_hold_ends(spark):
    e = spark.createDataFrame([(1, 1.0, 3), (1, 1.2, -1)], "k int, at double, emitted int")
    s = spark.createDataFrame([(1, t) for t in (0.9, 1.0, 1.4, 1.5)], "k int, now double")
    got = [r["held_class"] for r in C.held_emission(e, s, ["k"], "at", "now", 0.5, []).orderBy("now").collect()]
    assert got == [-1, 3, 3, -1]


def test_overrides(spark):
    c = spark.createDataFrame([("s1_argmax", 0.5, None), ("s4_shared", 0.5, "aware"), ("s2_weighted", None, "blind"), ("s3_evidence", None, None)], "mapping string, alpha double, intent_mode string")
    assert {(r["mapping"], r["bad_params"]) for r in C.override_problems(c).collect()} == {("s1_argmax", "alpha"), ("s2_weighted", "intent_mode")}


def test_clip_keeps_the_heading(spark):
    x, y = V.clip_to(F.lit(3.0), F.lit(4.0), 0.5)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (pytest.approx(0.3), pytest.approx(0.4))
    with pytest.raises(ValueError):
        V.clip_to(F.lit(1.0), F.lit(1.0), 0.0)


def test_constant_lookup_of_a_null_index(spark):
    df = spark.createDataFrame([(1,), (None,)], "i int")
    assert [r["v"] for r in df.select(V.pick_const(F.col("i"), [5.0, 6.0]).alias("v")).collect()] == [6.0, None]


def test_no_aim_leaves_repulsion_only(spark):
    df = posteriors(spark, [[0.25] * 4]).withColumn("x", F.lit(0.2)).withColumn("y", F.lit(0.0))
    r = C.shared_command(df, V.ring(8), [(0.0, 0.0)], alpha=1.0).first()
    assert r["aim"] is None and r["uy"] == 0.0 and r["ux"] == pytest.approx(0.02 * (1 / 0.2 - 1 / 0.35))
