import pytest
from pyspark.sql import functions as F

from kymora.operators import windows as W
from kymora.sources import recordings as R


@pytest.fixture()
def trials(spark):
    return spark.createDataFrame([(i, 1, "T", 0, i % 4, 8.0 * i + 3.0) for i in range(4)], "trial_id int, subject int, session string, run int, class int, onset_s double")


def test_fractional_stride_does_not_drift(spark):
    df = spark.createDataFrame([("a", 875)], "k string, n bigint")
    got = sorted(r["start_sample"] for r in W.window_starts(df, ["k"], "n", 500, 62.5).collect())
    assert got == [0, 63, 125, 188, 250, 313, 375]


def test_segments_do_not_change_the_starts(spark, monkeypatch):
    df = spark.createDataFrame([("a", 2000), ("b", 40)], "k string, n bigint")
    whole = sorted(map(tuple, W.window_starts(df, ["k"], "n", 100, 7.3).collect()))
    monkeypatch.setattr(W, "SEGMENT", 64)
    assert sorted(map(tuple, W.window_starts(df, ["k"], "n", 100, 7.3).collect())) == whole
    assert all(k == "a" for k, _ in whole)


def test_burst_windows_end_on_the_clock(trials):
    got = W.build_windows(trials, "burst").where("trial_id = 2").orderBy("start_sample").collect()
    assert [r["t_rel"] for r in got] == pytest.approx([2.0, 2.252, 2.5, 2.752, 3.0, 3.252, 3.5])
    assert {r["burst_onset"] for r in got} == {19.5} and not any(r["boundary"] for r in got)


def test_stitched_windows_follow_their_last_sample(trials):
    got = W.build_windows(trials, "stitched").orderBy("start_sample").collect()
    assert got[0]["start_sample"] == 0 and max(r["start_sample"] for r in got) + 500 <= 4 * 875
    for r in got:
        last = r["start_sample"] + 499
        assert r["trial_id"] == last // 875
        assert r["boundary"] == (r["start_sample"] // 875 != last // 875)
        assert r["t_rel"] == pytest.approx((last + 1 - 875 * (last // 875)) / 250)


def test_cut_of_a_ramp_across_blocks(spark):
    n = 500
    s = spark.range(n).select(F.lit(1).alias("subject"), F.lit("c").alias("channel"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("value"))
    starts = spark.createDataFrame([(i, 1, 37 * i) for i in range(12)], "window_id int, subject int, start bigint")
    got = W.cut(s, starts, ["subject"], ["subject", "channel"], "window_id", "start", 40).collect()
    assert len(got) == 12
    for r in got:
        assert r["signal"] == [float(v) for v in range(r["start"], r["start"] + 40)]


def test_truncation_policy(spark):
    t = spark.createDataFrame([(1, 1, 0.0), (2, 1, 9.0), (3, 1, 9.6), (4, 1, -2.0)], "trial_id int, subject int, onset double")
    n = spark.createDataFrame([(1, 100)], "subject int, n_samples bigint")
    got = {r["trial_id"]: (r["status"], r["shortfall"]) for r in W.plan_epochs(t, n, ["subject"], onset="onset", sfreq=10.0, tmin=0.5, n=6, max_short=3).collect()}
    assert got == {1: ("ok", 0), 2: ("truncated", 1), 3: ("error", 7), 4: ("error", 0)}


def test_overlap_is_strict_and_sees_long_spans(spark):
    p = spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "a", 10.0, 11.0), (3, "a", 20000.0, 20001.0), (4, "b", 0.0, 9e9)], "id int, k string, start double, stop double")
    s = spark.createDataFrame([("a", 1.0, 10.0), ("a", 10.5, 20000.5)], "k string, start double, stop double")
    got = {r["id"]: r["hit"] for r in W.overlaps_any(p, s, ["k"], "id", "start", "stop", "hit").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_bad_protocols_are_refused(trials):
    with pytest.raises(ValueError):
        W.build_windows(trials, "other")
    with pytest.raises(ValueError):
        W.build_windows(trials, "burst", first_window="pad")
    with pytest.raises(ValueError):
        W.build_windows(trials, "burst", window_s=9.0)


def test_recording_report(spark):
    t = spark.createDataFrame([(1, "T", r) for r in (0, 1)] + [(1, "E", 0)], "subject int, session string, run int")
    want = spark.createDataFrame([(1, "T"), (1, "E"), (2, "T"), (2, "E")], "subject int, session string")
    lines = {r["subject"]: r for r in R.report(R.verify(t, want, 2, 2)).collect()}
    assert lines[1]["runs"] == "2/1" and lines[1]["status"] == "session E: 1 runs, expected 2; session E: 1 trials, expected 2"
    assert lines[2]["runs"] == "0/0"


def test_session_keys(spark):
    t = spark.createDataFrame([(1, "0train"), (1, "1test"), (2, "0train"), (3, "0train"), (3, "1test"), (3, "x")], "subject int, key string")
    bad = {r["subject"]: (r["missing"], r["n_unknown"]) for r in R.session_key_problems(t, "key", {"0train": "T", "1test": "E"}).collect()}
    assert bad == {2: ("1test", 0), 3: ("", 1)}


def test_no_range_and_no_trial_is_lost(spark):
    s = spark.createDataFrame([(1, c, i, float(i)) for c, n in (("a", 100), ("b", 20)) for i in range(n)], "subject int, channel string, sample_idx bigint, value double")
    r = spark.createDataFrame([(0, 1, 0), (1, 1, 15), (2, 1, 95), (3, 1, 5000), (4, 1, -3), (5, 2, 0), (6, None, 0), (7, 1, None)], "window_id int, subject int, start bigint")
    got = {(x["window_id"], x["channel"]): (x["status"], x["signal"] and len(x["signal"])) for x in W.cut(s, r, ["subject"], ["subject", "channel"], "window_id", "start", 10).collect()}
    assert got == {
        (0, "a"): ("ok", 10), (0, "b"): ("ok", 10), (1, "a"): ("ok", 10), (1, "b"): ("short", 5), (2, "a"): ("short", 5), (2, "b"): ("outside", None), (3, "a"): ("outside", None),
        (3, "b"): ("outside", None), (4, "a"): ("outside", None), (4, "b"): ("outside", None), (5, None): ("no recording", None), (6, None): ("no recording", None),
        (7, "a"): ("outside", None), (7, "b"): ("outside", None),
    }
    t = spark.createDataFrame([(1, 1, 0.0), (2, 2, 0.0), (3, None, 0.0)], "trial_id int, subject int, onset double")
    n = spark.createDataFrame([(1, 100)], "subject int, n_samples bigint")
    plan = W.plan_epochs(t, n, ["subject"], onset="onset", sfreq=10.0, tmin=0.5, n=6, max_short=3)
    assert {x["trial_id"]: (x["status"], x["shortfall"]) for x in plan.collect()} == {1: ("ok", 0), 2: ("no recording", None), 3: ("no recording", None)}
