import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kymora.operators import windows as W
from kymora.sources import snapshots as S
from kymora.streaming import online as O

SCHEMA = "decoder string, subject int, v double"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def content(spark, root, version=None):
    return sorted(tuple(r) for r in S.read(spark, root, version).select("decoder", "subject", "v").collect())


def test_versions_replace_addresses_in_one_step(spark, tmp_path):
    root = f"{tmp_path}/store"
    assert S.commit(rows_of(spark, ("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)), root, ["decoder", "subject"]) == 1
    with pytest.raises(FileExistsError):
        S.commit(rows_of(spark, ("a", 1, 9.0), ("c", 1, 9.0)), root, ["decoder", "subject"])
    assert S.commit(rows_of(spark, ("a", 1, 9.0), ("b", 1, 8.0), ("c", 7, 7.0)), root, ["decoder", "subject"], replace=True) == 2
    assert content(spark, root) == [("a", 1, 9.0), ("a", 2, 2.0), ("b", 1, 8.0), ("c", 7, 7.0)]
    assert content(spark, root, 1) == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)]
    with pytest.raises(KeyError):
        S.read(spark, root, 5)
    with pytest.raises(ValueError):
        S.commit(rows_of(spark, (None, 1, 9.0)), root, ["decoder", "subject"])
    assert S.versions(spark, root) == [1, 2]


@pytest.mark.parametrize("step", ["data", "manifest", "publish"])
def test_a_writer_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    root = f"{tmp_path}/store"
    S.commit(rows_of(spark, ("a", 1, 1.0)), root, ["decoder", "subject"])

    def stop(*_, **__):
        raise OSError("lost")

    fresh = rows_of(spark, ("a", 1, 2.0), ("b", 2, 2.0))
    if step == "data":  # some files are there, the writer is gone
        fresh.write.partitionBy("decoder", "subject").parquet(f"{root}/data/commit=broken")
    else:
        monkeypatch.setattr(S, "_publish" if step == "publish" else "manifest", stop)
        with pytest.raises(OSError):
            S.commit(fresh, root, ["decoder", "subject"], replace=True)
        monkeypatch.undo()
    assert content(spark, root) == [("a", 1, 1.0)]
    assert S.commit(fresh, root, ["decoder", "subject"], replace=True) == 2
    assert content(spark, root) == [("a", 1, 2.0), ("b", 2, 2.0)]


def test_trials_that_break_the_contract_make_no_version(spark, tmp_path):
    """Plans of trials, with an error row or one without recording, are refused; truncated ones are not."""
    root = f"{tmp_path}/plans"
    lengths = spark.createDataFrame([(1, 100), (2, 100)], "subject int, n_samples bigint")
    trials = [(1, 0, 1.0), (1, 1, 9.5), (2, 0, 2.0), (2, 1, 5.0)]

    def plan(*more):
        rows = spark.createDataFrame([*trials, *more], "subject int, trial int, onset double").repartition(3)
        return W.plan_epochs(rows, lengths, ["subject"], onset="onset", sfreq=10.0, tmin=0.0, n=8, max_short=4).drop("n_samples")

    refuse = {"status": ["error", "no recording"]}
    assert S.commit(plan(), root, ["subject"], refuse=refuse) == 1
    for more, counts in (
        ([(1, 2, 9.9), (1, 3, -1.0)], {("status", "error"): 2}),
        ([(7, 0, 1.0)], {("status", "no recording"): 1}),
        ([(1, 2, 50.0), (7, 0, 1.0), (8, 0, 1.0)], {("status", "error"): 1, ("status", "no recording"): 2}),
    ):
        with pytest.raises(S.RefusedRows) as error:
            S.commit(plan(*more), root, ["subject"], replace=True, refuse=refuse)
        assert error.value.counts == counts
    assert S.versions(spark, root) == [1]
    held = {(r["subject"], r["trial"]): r["status"] for r in S.read(spark, root).collect()}
    assert held == {(1, 0): "ok", (1, 1): "truncated", (2, 0): "ok", (2, 1): "ok"}
    assert S.commit(plan((7, 0, 1.0)), root, ["subject"], replace=True) == 2  # kept with its status where not refused
    assert S.commit(plan().limit(0), f"{root}-empty", ["subject"], refuse=refuse) == 1
    assert S.commit(plan().where("false"), f"{root}-none", ["subject"], refuse=refuse) == 1


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    S.commit(rows_of(spark, ("a", 1, 1.0)), root, ["decoder", "subject"])
    with monkeypatch.context() as m:  # both looked before either published
        m.setattr(S, "versions", lambda *_: [1])
        S.commit(rows_of(spark, ("b", 1, 2.0)), root, ["decoder", "subject"], base=1)
        with pytest.raises(S.ConcurrentCommit):
            S.commit(rows_of(spark, ("b", 1, 3.0)), root, ["decoder", "subject"], base=1)
    with pytest.raises(S.ConcurrentCommit):
        S.commit(rows_of(spark, ("c", 1, 3.0)), root, ["decoder", "subject"], base=1)
    assert content(spark, root) == [("a", 1, 1.0), ("b", 1, 2.0)]
    with pytest.raises(FileNotFoundError):
        S.read(spark, f"{tmp_path}/none")


def events(spark, tmp_path, name, n, seed):
    """Rows in files, in an order of arrival that differs from that of their times."""
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, base + dt.timedelta(seconds=i + (rng.choice([-40, -15, 0, 0]) if i > 50 else 0))) for i in range(n)]
    files = f"{tmp_path}/{name}.parquet"
    for k in range(0, n, 50):
        spark.createDataFrame(rows[k : k + 50], "arrival bigint, k int, ts timestamp").coalesce(1).write.mode("append").parquet(files)
    return rows


def late_by_hand(rows, delay):
    newest, late = {}, set()
    for i, k, t in rows:
        if k in newest and t < newest[k] - dt.timedelta(seconds=delay):
            late.add(i)
        newest[k] = max(newest.get(k, t), t)
    return late


def test_late_rows_go_aside_and_nothing_is_lost_over_a_restart(spark, tmp_path):
    rows = events(spark, tmp_path, "e", 200, 1)
    schema = "arrival bigint, k int, ts timestamp"
    run = lambda: O.run_aside(O.late_policy(spark.readStream.schema(schema).parquet(f"{tmp_path}/e.parquet"), ["k"], "arrival", "ts", 20.0), "is_late", f"{tmp_path}/out")
    kept, aside, counts = run()
    more = [(1000 + i, i % 3, rows[-1][2] - dt.timedelta(seconds=100 if i < 5 else -i)) for i in range(10)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    kept, aside, counts = run()  # the second run goes on from the state of the first
    late = late_by_hand(rows + more, 20.0)
    assert {r["arrival"] for r in aside.collect()} == late and len(late) > 5
    assert sorted(r["arrival"] for r in kept.collect()) == sorted({i for i, _, _ in rows + more} - late)
    got = counts.agg(F.sum("n_kept"), F.sum("n_aside"), F.sum("n_dropped")).first()
    assert tuple(got) == (210 - len(late), len(late), 0)


def test_rows_the_engine_drops_are_counted(spark, tmp_path):
    events(spark, tmp_path, "d", 200, 2)
    old = [(5000, 0, dt.datetime(2023, 1, 1)), (5001, 1, dt.datetime(2023, 1, 1))]
    stream = lambda: spark.readStream.schema("arrival bigint, k int, ts timestamp").parquet(f"{tmp_path}/d.parquet")
    windows = lambda: O.sliding_windows(stream(), "ts", "30 seconds", "10 seconds", "10 seconds", ["k"], [F.count(F.lit(1)).alias("n")]).withColumn("aside", F.lit(False))
    O.run_aside(windows(), "aside", f"{tmp_path}/w")
    last = [(6000, k, dt.datetime(2024, 1, 2)) for k in range(3)]
    spark.createDataFrame(old + last, "arrival bigint, k int, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d.parquet")
    rows, _, counts = O.run_aside(windows(), "aside", f"{tmp_path}/w")
    kept, dropped = rows.agg(F.sum("n")).first()[0], counts.agg(F.sum("n_dropped")).first()[0]
    assert dropped == 2 and kept + dropped + len(last) == 205  # the last windows are still open
