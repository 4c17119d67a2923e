import pytest
from pyspark.sql import functions as F

from kymora.operators import grid as G
from kymora.operators import splits as L
from kymora.sources import posterior_store as PS
from kymora.sources import runs as RN
from kymora.sources import synthetic as SY

NINE = list(range(1, 10))
FOUR = ["s1_argmax", "s2_weighted", "s3_evidence", "s4_shared"]
ALPHAS = [0.0, 0.143, 0.286, 0.429, 0.571, 0.714, 0.857, 1.0]
BASE = {
    "subjects": NINE, "decoders": ["riemann"], "mappings": FOUR, "quality_levels": [0.0], "protocols": ["burst"], "windows_s": [2.0],
    "error_structures": ["none"], "intent_modes": [None], "alphas": [None], "latencies_ms": [250],
}
THREE = ["fbcsp", "riemann", "eegnet"]
EXPERIMENTS = {
    "main": ({"decoders": THREE}, 10, 1080),
    "lambda_sweep": ({"quality_levels": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]}, 10, 2160),
    "alpha_sweep": ({"decoders": THREE, "mappings": ["s4_shared"], "intent_modes": ["aware"], "alphas": ALPHAS}, 10, 2160),
    "alpha_sweep_blind": ({"decoders": THREE, "mappings": ["s4_shared"], "intent_modes": ["blind"], "alphas": ALPHAS}, 10, 2160),
    "ablation_latency": ({"latencies_ms": [0, 125, 250, 500]}, 5, 720),
    "ablation_window": ({"windows_s": [1.0, 2.0, 3.0]}, 5, 540),
    "ablation_errstruct": ({"error_structures": ["smoothing", "jitter", "burst"]}, 5, 540),
    "ablation_intent_blind": ({"mappings": ["s4_shared"], "intent_modes": ["aware", "blind"], "alphas": [0.3, 0.5, 0.7]}, 10, 540),
    "ablation_protocol": ({"protocols": ["burst", "stitched"]}, 5, 360),
}


def test_grids_have_their_sizes_and_no_cell_twice(spark):
    every = None
    for name, (change, seeds, n) in EXPERIMENTS.items():
        cells = G.enumerate_cells(spark, name, {**BASE, **change}, seeds)
        assert cells.count() == n
        every = cells if every is None else every.unionByName(cells)
    assert every.count() == 10260
    assert G.duplicate_keys(every, G.cell_key()).count() == 0


def test_grid_order_is_the_product_order(spark):
    cells = G.in_grid_order(G.enumerate_cells(spark, "x", {**BASE, "subjects": [1, 2], "mappings": ["a", "b"]}, 2)).collect()
    assert [(r["subject"], r["mapping"], r["seed"]) for r in cells] == [(s, m, k) for s in (1, 2) for m in "ab" for k in (0, 1)]
    with pytest.raises(KeyError):
        G.enumerate_cells(spark, "x", {k: v for k, v in BASE.items() if k != "alphas"}, 1)


def test_variant_under_a_foreign_key_is_refused(spark):
    with pytest.raises(ValueError):
        G.variant_table(spark, {"burst_w1000": {"protocol": "burst", "window_s": 2.0, "stride_s": 0.25, "gap_s": 2.0, "hashes": {}}})


def test_each_burst_once_per_cycle(spark):
    pool = spark.createDataFrame([(1, b, b % 2) for b in range(14)], "subject int, burst_id bigint, label int")
    ask = spark.createDataFrame([(e, s, 1, s % 2) for e in (1, 2) for s in range(42)] + [(1, 100, 1, 3)], "episode_id int, step bigint, subject int, class int")
    got = G.draw_bursts(ask, pool, 5)
    per = got.where("class < 2").groupBy("episode_id", "class", "cycle").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("burst_id").alias("d")).collect()
    assert len(per) == 2 * 2 * 3 and all(r["n"] == 7 and r["d"] == 7 for r in per)
    orders = {e: [r["burst_id"] for r in got.where(f"episode_id={e} and class=0").orderBy("step").collect()] for e in (1, 2)}
    assert orders[1] != orders[2]
    assert got.where("class = 3").first()["burst_id"] is None
    assert [(r["class"], r["n_requests"]) for r in G.unmatched_classes(ask, pool).collect()] == [(3, 1)]


def test_permutations(spark):
    df = spark.range(30).select(G.permuted_classes(4, 1, F.col("id")).alias("p"))
    assert df.where(~G.is_permutation(F.col("p"), 4)).count() == 0
    assert df.distinct().count() > 5
    with pytest.raises(ValueError):
        G.band_table(spark, 4.0, 40.0, 5.0)
    bands = [tuple(r) for r in G.band_table(spark, 4.0, 5.0, 0.1).orderBy("band").collect()]
    assert bands[0] == (0, 4.0, 4.1) and bands[-1] == (9, 4.9, 5.0) and len(bands) == 10


def data(spark, n=21):
    rows = spark.range(n).select(
        F.col("id").alias("window_id"), F.lit(1).alias("subject"), F.floor(F.col("id") / 7).alias("burst_id"), (2.0 + 0.25 * (F.col("id") % 7)).alias("t_rel"),
        F.lit(1).alias("label"), F.expr("cast(array(0.1, 0.6, 0.2, 0.1) as array<float>)").alias("posterior"), F.lit(False).alias("boundary"),
        F.lit("riemann").alias("decoder"), F.lit("burst").alias("protocol"), F.lit(2000).alias("window_ms"), F.lit(250).alias("stride_ms"),
        F.lit("abcd").alias("cfg_hash"), F.lit("E").alias("session"),
    )
    bursts = spark.range(n // 7).select(F.lit(1).alias("subject"), F.col("id").alias("burst_id"), (F.col("id") * 8.0).alias("burst_onset"), (F.col("id") * 8.0 + 3.5).alias("burst_offset"))
    return rows, bursts


def test_store_round_trip_and_refusals(spark, tmp_path):
    rows, bursts = data(spark)
    path = str(tmp_path / "p")
    PS.write_posteriors(rows, bursts, path)
    back = PS.read_posteriors(spark, path, decoder="riemann", session="E")
    assert back.count() == 21 and back.schema["label"].dataType.simpleString() == "tinyint"
    assert "PartitionFilters: [isnotnull(decoder" in back._jdf.queryExecution().toString().replace("\n", " ")
    with pytest.raises(Exception, match="already holds"):
        PS.write_posteriors(rows, bursts, path)
    PS.write_posteriors(rows, bursts, path, force=True)
    assert PS.read_posteriors(spark, path).count() == 21
    with pytest.raises(KeyError):
        PS.read_posteriors(spark, path, nothing=1)
    meta = PS.provenance(PS.read_posteriors(spark, path)).first()
    assert (meta["n_windows"], meta["n_bursts"], meta["boundary_windows"], meta["in_sample"]) == (21, 3, 0, False)
    assert '"n_windows":21' in PS.provenance_json(PS.provenance(PS.read_posteriors(spark, path))).first()["meta"]


@pytest.mark.parametrize(
    "change,rule",
    [
        (lambda r, b: (r.withColumn("posterior", F.expr("cast(array(0.5,0.6,0.2,0.1) as array<float>)")), b), "not a distribution"),
        (lambda r, b: (r.withColumn("posterior", F.expr("cast(array(-0.1,0.8,0.2,0.1) as array<float>)")), b), "not a distribution"),
        (lambda r, b: (r.withColumn("posterior", F.expr("cast(array('NaN',0.8,0.2,0.1) as array<float>)")), b), "not a distribution"),
        (lambda r, b: (r.withColumn("label", F.lit(4)), b), "label out of range"),
        (lambda r, b: (r.withColumn("t_rel", F.lit(2.0)), b), "time not increasing"),
        (lambda r, b: (r, b.where("burst_id < 2")), "unknown burst"),
        (lambda r, b: (r, b.withColumn("burst_offset", F.col("burst_onset") - 1)), "burst ends before it starts"),
    ],
)
def test_bad_rows_are_refused(spark, tmp_path, change, rule):
    rows, bursts = change(*data(spark))
    with pytest.raises(ValueError, match=rule):
        PS.write_posteriors(rows, bursts, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()


def test_schema_contract():
    names = RN.EPISODES.names
    assert len(names) == 32 and RN.schema_problems(list(names)) == {}
    assert RN.schema_problems(names[1:])["missing"] == ["experiment"]
    assert RN.schema_problems([*names, "x"])["extra"] == ["x"]
    assert RN.schema_problems([names[1], names[0], *names[2:]])["reordered"] == [names[1], names[0]]


def test_runs_publish_whole_and_guard_the_summary(spark, tmp_path):
    cells = spark.createDataFrame([("main", "r1", 1, "burst_w2000", float("nan")), ("main", "r1", 2, "burst_w2000", 0.5)], "experiment string, run_id string, subject int, variant string, alpha double")
    variants = G.variant_table(spark, {"burst_w2000": {"protocol": "burst", "window_s": 2.0, "stride_s": 0.25, "gap_s": 2.0, "hashes": {"a": None}}})
    ep = RN.episode_frame(cells, variants)
    assert ep.columns == RN.EPISODES.names and ep.where("alpha is null").count() == 1 and ep.first()["stride_s"] == 0.25
    path = str(tmp_path / "runs")
    summary = RN.meta_block(ep, 1, True)
    with pytest.raises(FileNotFoundError):
        RN.load_run(spark, path)
    RN.write_run(ep, summary, ep.select("experiment", "run_id").distinct().withColumn("config", F.lit("{}")), path)
    with pytest.raises(FileExistsError):
        RN.write_run(ep, summary, ep.select("experiment", "run_id").distinct().withColumn("config", F.lit("{}")), path)
    back = RN.load_run(spark, path, "main")
    assert back["episodes"].count() == 2 and back["episodes"].columns == RN.EPISODES.names
    with pytest.raises(FileExistsError):
        RN.write_summary(spark, summary, path)
    RN.write_summary(spark, RN.meta_block(ep, 99, True), path, force=True)
    assert RN.load_run(spark, path)["summary"].first()["seed"] == 99
    with pytest.raises(ValueError):
        RN.validate_schema(ep.drop("lam"))


def test_synthetic_accuracy_and_classes(spark):
    b = spark.range(400).select(F.lit(1).alias("subject"), F.col("id").alias("burst_id"))
    p = SY.synthetic_posteriors(b, 3, accuracy=1.0)
    assert p.where(F.array_position("posterior", F.array_max("posterior")) - 1 != F.col("label")).count() == 0
    assert {r["count"] for r in p.groupBy("label").count().collect()} == {700}
    half = SY.synthetic_posteriors(b, 3, accuracy=0.5)
    share = half.select(F.avg((F.array_position("posterior", F.array_max("posterior")) - 1 == F.col("label")).cast("int"))).first()[0]
    assert abs(share - 0.5) < 0.04
    with pytest.raises(ValueError):
        SY.synthetic_posteriors(b, 3, accuracy=1.5)


def trials(spark):
    return spark.range(240).select(
        F.col("id").alias("trial_id"), F.lit(1).alias("subject"), F.when(F.col("id") < 120, "T").otherwise("E").alias("session"), (F.col("id") % 4).cast("int").alias("class"), F.col("id").cast("double").alias("x"))


def test_folds_stay_in_the_train_session(spark):
    f = L.inner_folds(trials(spark), 5, 1)
    assert f.where("session <> 'T' or fold is null").count() == 0 and f.count() == 120
    assert {r["count"] for r in f.groupBy("fold", "class").count().collect()} == {6}
    assert L.inner_folds(trials(spark), 31, 1).where("fold is not null").count() == 0
    with pytest.raises(ValueError):
        L.inner_folds(trials(spark), 1, 1)


def test_holdout_share(spark):
    h = L.holdout(trials(spark), 0.2, 1, ["subject"])
    assert {r["n"] for r in h.where("validation").groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()} == {12}


def test_scaling_never_sees_test_rows(spark):
    t = trials(spark)
    a = L.standardise_on_train(t, ["x"], F.col("session") == "T", ["subject"]).where("session='T'").orderBy("trial_id").collect()
    spoiled = t.withColumn("x", F.when(F.col("session") == "E", 1e9).otherwise(F.col("x")))
    b = L.standardise_on_train(spoiled, ["x"], F.col("session") == "T", ["subject"]).where("session='T'").orderBy("trial_id").collect()
    assert [r["x"] for r in a] == [r["x"] for r in b]


def test_split_problems(spark):
    assert L.split_problems(trials(spark)).count() == 0
    assert L.split_problems(trials(spark).where("session='T'")).first()["n_test"] == 0
