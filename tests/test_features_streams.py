import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kymora.functions import vectors as V
from kymora.operators import features as FE
from kymora.streaming import online as O


def test_filter_equals_the_recursion(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=700)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(len(x)), "v": x})).repartition(4)
    got = FE.band_filter(df, ["k"], "i", "v", sfreq=250.0, bands=[(20.0, 60.0)], order=2, rows=8).orderBy("i").toPandas()["filtered"].to_numpy()
    zeros, poles, gain = FE.butterworth_bandpass(2, 20.0, 60.0, 250.0)
    b, a = gain * np.real(np.poly(zeros)), np.real(np.poly(poles))
    want = np.zeros(len(x))
    for t in range(len(x)):
        want[t] = sum(b[j] * x[t - j] for j in range(len(b)) if t >= j) - sum(a[j] * want[t - j] for j in range(1, len(a)) if t >= j)
    np.testing.assert_allclose(got, want, atol=1e-9)



def test_filtered_blocks_leave_in_bounded_pieces():
    n, rows = 1500, 1024
    x = np.random.default_rng(3).normal(size=(n + 1, rows))
    lists = lambda y: pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * rows), pa.array(y.ravel()))
    before = pa.concat_arrays([pa.nulls(1, pa.list_(pa.float64())), lists(x[1:n])])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists(x[1:]), before], ["block", "own", "before"])
    responses = [FE.impulse_response(2, lo, hi, 250.0) for lo, hi in ((20.0, 40.0), (40.0, 70.0), (70.0, 100.0))]
    seen = []
    base = pa.total_allocated_bytes()
    tracemalloc.start()
    for b in FE._filter_blocks(responses, ["block"])([batch]):
        assert b.nbytes < 4 << 20 and pa.total_allocated_bytes() - base < 16 << 20
        seen += zip(b.column("block").to_pylist(), b.column("band").to_pylist(), strict=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all results are 37 MB, as Python numbers 147
    assert seen == [(i, k) for i in range(n) for k in range(3)]


def test_a_missing_sample_takes_its_block_and_the_next(spark):
    df = spark.createDataFrame([(1, i, None if i == 600 else float("nan") if i == 2600 else float(i % 7)) for i in range(5000)], "k int, i long, v double")
    got = FE.band_filter(df, ["k"], "i", "v", sfreq=250.0, bands=[(20.0, 60.0)], order=2, rows=512).orderBy("i").toPandas()
    assert got["filtered"].isna().tolist() == [i // 512 in (1, 2, 5, 6) for i in range(5000)]
    assert (got["i"] == np.arange(5000)).all() and got["band"].eq(0).all()


def test_band_gain():
    h = FE.impulse_response(4, 4.0, 38.0, 250.0)
    gain = lambda f: abs((h * np.exp(-2j * np.pi * f / 250 * np.arange(len(h)))).sum())
    assert gain(12.3) == pytest.approx(1.0, abs=1e-3) and gain(4.0) == pytest.approx(2**-0.5, abs=1e-6) and gain(38.0) == pytest.approx(2**-0.5, abs=1e-6)
    assert gain(0.5) < 1e-3 and gain(110.0) < 1e-3
    with pytest.raises(ValueError):
        FE.butterworth_bandpass(4, 4.0, 200.0, 250.0)


def spd(rng, n, p):
    out = []
    for _ in range(n):
        a = rng.normal(size=(p, p))
        out.append(a @ a.T + np.eye(p))
    return out


def test_shrunk_covariance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(64, 3)) @ rng.normal(size=(3, 3))
    pdf = pd.DataFrame(x, columns=["c0", "c1", "c2"]).assign(k=1, sample_idx=np.arange(64))
    got = FE.covariances(spark.createDataFrame(pdf), ["k"], 3, 32, 32).orderBy("window").collect()
    assert len(got) == 2
    for w, r in enumerate(got):
        e = np.cov(x[32 * w : 32 * w + 32].T, bias=True)
        alpha, mu = (e**2).mean(), np.trace(e) / 3
        s = min((alpha + mu**2) / (33 * (alpha - mu**2 / 3)), 1.0)
        want = (1 - s) * e + s * mu * np.eye(3)
        np.testing.assert_allclose(r["cov"], [want[i, j] for i, j in FE.pairs(3)], rtol=1e-9)


def test_geometric_mean_of_a_matrix_and_its_inverse(spark):
    rng = np.random.default_rng(5)
    a = spd(rng, 1, 3)[0]
    rows = [(1, [float(m[i, j]) for i, j in FE.pairs(3)]) for m in (a, np.linalg.inv(a))]
    df = spark.createDataFrame(rows, "k int, cov array<double>")
    ref = FE.geometric_mean(df, ["k"], 3)
    np.testing.assert_allclose(ref.first()["ref"], [1, 0, 0, 1, 0, 1], atol=1e-8)
    t = np.array([r["features"] for r in FE.tangent_features(df, ref, ["k"], 3).collect()])
    np.testing.assert_allclose(t[0], -t[1], atol=1e-7)


def test_decoders(spark):
    rng = np.random.default_rng(6)
    y = np.arange(240) % 3
    x = rng.normal(size=(240, 4)) + 3 * np.eye(3, 4)[y]
    df = spark.createDataFrame(pd.DataFrame({"subject": np.where(np.arange(240) < 120, 1, 2), "label": y, "x": x.tolist()}))
    for name, keys in (("discriminant", ["subject"]), ("logistic", [])):
        out = FE.decode(name, df, df, keys, "x", "label", 4)
        assert out.where(~V.is_distribution(F.col("posterior"))).count() == 0
        assert out.where(F.array_position("posterior", F.array_max("posterior")) - 1 == F.col("label")).count() > 215
    with pytest.raises(KeyError):
        FE.decode("other", df, df, [], "x", "label", 4)
    flat = FE.decode_with_udf(df, lambda b: np.full((len(b), 3), 1 / 3), "x")
    assert flat.where(~V.is_distribution(F.col("posterior"))).count() == 0


def test_logistic_fits_one_model_per_key(spark):
    y = np.arange(80) % 2
    subject = np.where(np.arange(80) < 40, 1, 2)
    x = np.stack([np.where(subject == 1, y, 1 - y), np.zeros(80)], 1).astype(float)  # the subjects have opposite signs
    df = spark.createDataFrame(pd.DataFrame({"subject": subject, "label": y, "x": x.tolist()}))
    out = FE.decode("logistic", df, df, ["subject"], "x", "label", 2)
    assert out.where(F.array_position("posterior", F.array_max("posterior")) - 1 == F.col("label")).count() == 80


def test_registered_decoders_read_all_entries(spark, monkeypatch):
    from kymora.plans import queries_features as Q

    rng = np.random.default_rng(8)
    y = np.arange(1260) % 4
    x = 0.1 * rng.normal(size=(1260, 64))
    x[np.arange(1260), 60 + y] += 1  # only the last four entries tell the labels
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1260), "label": y, "embedding": x.tolist()}))
    monkeypatch.setattr(Q.tables, "read", lambda *_: df)
    for q in (Q.decoded_posteriors, Q.logistic_posteriors):
        out = q(spark, "")
        right = F.array_position("posterior", F.array_max("posterior")) - 1 == F.col("label")
        assert out.agg(F.avg(right.cast("int"))).first()[0] > 0.95


def test_information_of_a_copy_and_of_noise(spark):
    df = spark.createDataFrame([(i % 2, [float(i % 2), 0.5]) for i in range(100)], "label int, x array<double>")
    got = {r["feature"]: r["information"] for r in FE.mutual_information(df, "x", "label").collect()}
    assert got[0] == pytest.approx(np.log(2)) and got[1] == pytest.approx(0.0)


# --- streams over several late-arriving files ---

START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    """Six files of rows that reach back up to an hour behind the file before."""
    rng = np.random.default_rng(8)
    n = 360
    minute = np.sort(rng.uniform(0, 1440, n))
    arrival = np.argsort(minute + rng.uniform(0, 60, n), kind="stable")
    rows = pd.DataFrame({
        "event_id": np.arange(n), "ts": [START + dt.timedelta(microseconds=int(m * 6e7)) for m in minute], "key": np.arange(n) % 4,
        "value": np.round(rng.normal(size=n), 3), "is_value": rng.random(n) < 0.4,
    }).iloc[arrival].reset_index(drop=True)
    rows["arrival"] = np.arange(n)
    for i, part in enumerate(np.array_split(np.arange(n), 6)):
        spark.createDataFrame(rows.iloc[part]).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        f = next((tmp_path / f"part{i}").glob("*.parquet"))
        f.rename(tmp_path / f"rows-{i}.parquet")
    return str(tmp_path), rows


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/rows-0.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "rows-*.parquet").option("maxFilesPerTrigger", "1").parquet(folder)


def test_ordered_state_over_batches_equals_one_pass(spark, folder, tmp_path):
    path, rows = folder
    out = O.moving_standardise(stream(spark, path), ["key"], "ts", "event_id", "2 hours", "value", 0.1, 1e-4)
    got = O.run_append(out, str(tmp_path / "a")).toPandas().set_index("event_id").sort_index()
    final = rows["ts"].max() - pd.Timedelta(hours=2)
    done = rows[rows["ts"] <= final].sort_values("ts")
    want = done.assign(m=done.groupby("key")["value"].transform(lambda s: s.ewm(alpha=0.1).mean())).set_index("event_id").sort_index()
    assert got.index.tolist() == want.index.tolist() and len(got) > 250
    np.testing.assert_allclose(got["mean"], want["m"], atol=1e-9)


def test_latest_available_over_batches(spark, folder, tmp_path):
    path, rows = folder
    out = O.latest_available(stream(spark, path), ["key"], "ts", "event_id", "3 hours", "is_value", "value", 1800.0)
    got = O.run_append(out, str(tmp_path / "b")).toPandas().set_index("event_id")["latest"]
    values = rows[rows["is_value"]]
    for event, latest in got.items():
        r = rows[rows["event_id"] == event].iloc[0]
        seen = values[(values["key"] == r["key"]) & (values["ts"] + pd.Timedelta(minutes=30) <= r["ts"])].sort_values("ts")
        assert (np.isnan(latest) and seen.empty) or latest == seen["value"].iloc[-1]
    assert len(got) > 150


def test_sliding_windows_are_emitted_once(spark, folder, tmp_path):
    path, rows = folder
    out = O.sliding_windows(stream(spark, path), "ts", "2 hours", "1 hour", "15 minutes", ["key"], [F.count(F.lit(1)).alias("n")])
    got = O.run_append(out, str(tmp_path / "c")).toPandas()
    assert not got.duplicated(["key", "window_start"]).any()
    for r in got.itertuples():
        hit = rows[(rows["key"] == r.key) & (rows["ts"] >= r.window_start) & (rows["ts"] < r.window_end)]
        assert len(hit) == r.n


def test_bursts_and_late_rows(spark, folder, tmp_path):
    path, rows = folder
    got = O.run_append(O.segment_bursts(stream(spark, path), "ts", "2 hours", "20 minutes", ["key"], [F.count(F.lit(1)).alias("n")]), str(tmp_path / "d")).toPandas()
    assert (got["n"] > 0).all() and got["n"].sum() <= len(rows) and len(got) > 20
    late = O.run_append(O.late_policy(stream(spark, path), ["key"], "arrival", "ts", 600.0), str(tmp_path / "e")).toPandas().set_index("arrival")["is_late"]
    newest = rows.groupby("key")["ts"].transform(lambda s: s.cummax().shift())
    want = (rows["ts"] < newest - pd.Timedelta(minutes=10)).to_numpy()
    assert late.sort_index().tolist() == want.tolist() and want.sum() > 10


def test_update_mode_keeps_the_last_version(spark, folder, tmp_path):
    path, rows = folder
    out = O.tumbling_metrics(stream(spark, path), "ts", "6 hours", "6 hours", ["key"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")])
    got = O.run_update(out, str(tmp_path / "f"), ["window_start", "window_end", "key"]).toPandas()
    assert got["n"].sum() == len(rows)


def test_evidence_with_hold(spark, folder, tmp_path):
    path, _ = folder
    s = stream(spark, path).select("*", F.lit(0.7).alias("p0"), F.lit(0.3).alias("p1"))
    got = O.run_append(O.accumulate_evidence(s, ["key"], "ts", "event_id", "2 hours", ["p0", "p1"], hold_s=1.0), str(tmp_path / "g")).toPandas()
    assert (got["emitted"] == 0).all() and (got["held"] == 0).all()
