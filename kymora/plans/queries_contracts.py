"""Datasets, runs, grids, keys, draws, splits and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kymora.functions import hashing as H
from kymora.functions import naming as N
from kymora.functions import responses as X
from kymora.functions import vectors as V
from kymora.functions.vectors import rounded
from kymora.operators import grid as G
from kymora.operators import posterior as P
from kymora.operators import splits as L
from kymora.plans.queries_posterior import spread
from kymora.plans.registry import query
from kymora.plans.sql_views import u01
from kymora.session import shared_dir
from kymora.sources import posterior_store as PS
from kymora.sources import runs as RN
from kymora.sources import snapshots
from kymora.sources import synthetic as SY
from kymora.sources import tables


def scratch(spark, name):
    """A fresh folder for a write; never reused."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _dataset(spark, d):
    """Posterior rows with the fields a dataset is addressed by."""
    p = tables.posteriors(spark, d)
    decoder = F.element_at(F.array(F.lit("fbcsp"), F.lit("riemann"), F.lit("eegnet")), (F.col("burst_id") % 3 + 1).cast("int"))
    return p.select(
        "*", decoder.alias("decoder"), F.lit("burst").alias("protocol"), F.lit(2000).alias("window_ms"), F.lit(250).alias("stride_ms"),
        F.lit("0a1b2c3d").alias("cfg_hash"), F.when(F.col("burst_id") % 2 == 0, "T").otherwise("E").alias("session"),
        (F.col("window_id") % 11 == 0).alias("boundary"),
    )


SET_SQL = """
WITH c AS (SELECT *, CASE burst_id%3 WHEN 0 THEN 'fbcsp' WHEN 1 THEN 'riemann' ELSE 'eegnet' END AS decoder, CASE WHEN burst_id%2=0 THEN 'T' ELSE 'E' END AS session FROM d_argmax)"""


@query(
    "posterior_round_trip",
    SET_SQL + " SELECT window_id, subject, decoder, session, label, burst_id, t_rel, burst_id*8.0::DOUBLE+3.0 AS burst_onset, round(p0,6) AS p0, round(p1,6) AS p1, round(p2,6) AS p2, round(p3,6) AS p3 FROM c",
)
def posterior_round_trip(spark, d):
    """Validated write of every dataset, then a checked read."""
    path = scratch(spark, "posteriors")
    PS.write_posteriors(_dataset(spark, d), tables.bursts(spark, d), path)
    back = PS.read_posteriors(spark, path)
    return spread(
        back.select(
            "window_id", "subject", "decoder", "session", F.col("label").cast("int").alias("label"),
            F.col("burst_id").cast("bigint").alias("burst_id"), F.col("t_rel").cast("double").alias("t_rel"),
            F.col("burst_onset").cast("double").alias("burst_onset"), "posterior",
        )
    )


@query(
    "posterior_by_address",
    SET_SQL + " SELECT subject, session, count(*) AS n, round(avg(CAST(pred=label AS INT)),6) AS accuracy FROM c WHERE decoder='riemann' AND session='E' GROUP BY ALL",
)
def posterior_by_address(spark, d):
    """Only the folders of one decoder and session are read."""
    path = scratch(spark, "posteriors")
    PS.write_posteriors(_dataset(spark, d), tables.bursts(spark, d), path)
    rows = PS.read_posteriors(spark, path, decoder="riemann", session="E")
    return P.accuracy(rows, ["subject", "session"]).withColumn("accuracy", rounded(F.col("accuracy")))


def _damaged(spark, d):
    """Rows with planted faults of every kind, and a burst table with two."""
    p = _dataset(spark, d)
    w = F.col("window_id")
    scaled = F.transform("posterior", lambda v: (v * 1.1).cast("float"))
    rows = p.select(
        w.alias("window_id"), "subject", F.when(F.col("burst_id") % 23 == 5, F.col("burst_id") + 1000000).otherwise(F.col("burst_id")).alias("burst_id"),
        F.when(w % 53 == 0, -1).otherwise(F.col("label")).alias("label"),
        (F.col("t_rel") - F.when(w % 31 == 3, 0.5).otherwise(0.0)).alias("t_rel"),
        F.when(w % 37 == 0, scaled).otherwise(F.col("posterior")).alias("posterior"),
    )
    b = tables.bursts(spark, d)
    return rows, b.withColumn("burst_offset", F.when(F.col("burst_id") % 19 == 4, F.col("burst_onset") - 1).otherwise(F.col("burst_offset")))


@query(
    "posterior_problems",
    """
WITH r AS (SELECT * REPLACE (CASE WHEN burst_id%23=5 THEN burst_id+1000000 ELSE burst_id END AS burst_id), t_rel - CASE WHEN window_id%31=3 THEN 0.5 ELSE 0 END AS t FROM d_posterior),
g AS (SELECT *, lag(t) OVER (PARTITION BY subject, burst_id ORDER BY window_id) AS before FROM r)
SELECT subject, burst_id, window_id, 'not a distribution' AS rule FROM r WHERE window_id%37=0
UNION ALL SELECT subject, burst_id, window_id, 'label out of range' FROM r WHERE window_id%53=0
UNION ALL SELECT subject, burst_id, window_id, 'time not increasing' FROM g WHERE t<=before
UNION ALL SELECT subject, burst_id, window_id, 'unknown burst' FROM r WHERE burst_id>=1000000
UNION ALL SELECT subject, burst_id, CAST(NULL AS BIGINT), 'burst ends before it starts' FROM d_burst WHERE burst_id%19=4""",
)
def posterior_problems(spark, d):
    return PS.problems(*_damaged(spark, d))


@query(
    "posterior_row_checks",
    "SELECT subject, count(*) AS n, count(*) FILTER (WHERE window_id%37=0) AS n_bad, round(max(CASE WHEN window_id%37=0 THEN 1.1 ELSE 1.0 END*(p0+p1+p2+p3)),4) AS worst_sum FROM d_posterior GROUP BY subject",
)
def posterior_row_checks(spark, d):
    rows, _ = _damaged(spark, d)
    p = F.col("posterior")
    return rows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~V.is_distribution(p), 1)).alias("n_bad"),
        rounded(F.max(V.row_sum(p)), 4).alias("worst_sum"),
    )


META_SQL = SET_SQL + """,
m AS (SELECT decoder, session, subject, label, pred, count(*) AS n FROM c GROUP BY ALL),
t AS (SELECT decoder, session, subject, sum(n) AS n, sum(CASE WHEN label=pred THEN n ELSE 0 END) AS hit FROM m GROUP BY ALL),
r AS (SELECT decoder, session, subject, label AS k, sum(n) AS r FROM m GROUP BY ALL), q AS (SELECT decoder, session, subject, pred AS k, sum(n) AS c FROM m GROUP BY ALL),
e AS (SELECT decoder, session, subject, sum(r*c) AS rc FROM r JOIN q USING (decoder, session, subject, k) GROUP BY ALL),
k AS (SELECT decoder, session, subject, CASE WHEN coalesce(rc,0)<>n*n THEN (hit/n-coalesce(rc,0)/(n*n))/(1-coalesce(rc,0)/(n*n)) END AS kappa FROM t LEFT JOIN e USING (decoder, session, subject)),
a AS (SELECT decoder, session, subject, count(*) AS n_windows, count(DISTINCT burst_id) AS n_bursts, count(*) FILTER (WHERE window_id%11=0) AS boundary_windows FROM c GROUP BY ALL)"""


@query(
    "dataset_provenance",
    META_SQL + " SELECT decoder, session, subject, n_windows, n_bursts, boundary_windows, round(kappa,6) AS kappa_window, session='T' AS in_sample FROM a JOIN k USING (decoder, session, subject)",
)
def dataset_provenance(spark, d):
    return PS.provenance(_dataset(spark, d)).select(
        "decoder", "session", "subject", "n_windows", "n_bursts", "boundary_windows", rounded(F.col("kappa_window")).alias("kappa_window"), "in_sample"
    )


# --- episode tables and runs ---

EXPERIMENTS = {
    "1-URGENT": "main", "2-HIGH": "lambda_sweep", "3-MEDIUM": "alpha_sweep", "4-NOT SPECIFIED": "ablation_latency", "5-LOW": "ablation_window",
}


def experiment_name():
    return N.lookup(F.col("mapping"), EXPERIMENTS)


EXPERIMENT_SQL = "CASE mapping WHEN '1-URGENT' THEN 'main' WHEN '2-HIGH' THEN 'lambda_sweep' WHEN '3-MEDIUM' THEN 'alpha_sweep' WHEN '4-NOT SPECIFIED' THEN 'ablation_latency' ELSE 'ablation_window' END"
VARIANTS = {
    "burst_w1000": {"protocol": "burst", "window_s": 1.0, "stride_s": 0.25, "gap_s": 2.0, "hashes": {"F": "11aa0001", "O": "11aa0002"}},
    "burst_w2000": {"protocol": "burst", "window_s": 2.0, "stride_s": 0.25, "gap_s": 2.0, "hashes": {"F": "22bb0001", "O": "22bb0002", "P": None}},
    "stitched_w2000": {"protocol": "stitched", "window_s": 2.0, "stride_s": 0.5, "gap_s": 0.0, "hashes": {"F": "33cc0001", "P": "33cc0003"}},
}


def _cells(spark, d):
    """Episodes as cells: replay condition and decoder vary with the order number."""
    e = tables.episodes(spark, d)
    i = F.col("episode_id")
    return e.select(
        "*", F.when(i % 7 == 0, "stitched").otherwise("burst").alias("protocol"),
        F.when(i % 7 == 0, 2.0).when(i % 5 == 0, 3.0).when(i % 3 == 0, 1.0).otherwise(2.0).alias("window_s"),
        experiment_name().alias("experiment"),
    )


CELL_SQL = """
WITH c AS (SELECT *, CASE WHEN episode_id%7=0 THEN 'stitched' ELSE 'burst' END AS protocol,
   CASE WHEN episode_id%7=0 THEN 2000 WHEN episode_id%5=0 THEN 3000 WHEN episode_id%3=0 THEN 1000 ELSE 2000 END AS ms FROM d_episode),
v AS (SELECT *, protocol||'_w'||ms AS variant FROM c),
h AS (SELECT * FROM (VALUES ('burst_w1000','F','11aa0001'),('burst_w1000','O','11aa0002'),('burst_w2000','F','22bb0001'),('burst_w2000','O','22bb0002'),('burst_w2000','P',NULL),
  ('stitched_w2000','F','33cc0001'),('stitched_w2000','P','33cc0003')) t(variant, decoder, posterior_hash))"""


@query(
    "variant_addresses",
    CELL_SQL + """ SELECT v.variant, v.decoder, CASE WHEN v.variant NOT IN (SELECT variant FROM h) THEN 'no variant' WHEN h.variant IS NULL THEN 'decoder not listed'
 WHEN h.posterior_hash IS NULL THEN 'hash is empty' ELSE 'ok' END AS status, h.posterior_hash, count(*) AS n FROM v LEFT JOIN h ON h.variant=v.variant AND h.decoder=v.decoder GROUP BY ALL""",
)
def variant_addresses(spark, d):
    """Which dataset each cell reads, and why some read none."""
    cells = G.dataset_address(_cells(spark, d), G.variant_table(spark, VARIANTS))
    return cells.groupBy("variant", "decoder", "status", "posterior_hash").agg(F.count(F.lit(1)).alias("n"))


@query("unreachable_cells", CELL_SQL + " SELECT variant, count(*) AS n FROM v WHERE variant NOT IN (SELECT variant FROM h) GROUP BY variant")
def unreachable_cells(spark, d):
    out = G.unreachable(_cells(spark, d), G.variant_table(spark, VARIANTS))
    return out.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cells_per_dataset",
    CELL_SQL + """, s AS (SELECT subject, count(*) AS n_windows, avg(CAST(pred=label AS INT)) AS acc FROM d_argmax GROUP BY subject)
SELECT v.subject, v.decoder, v.variant, count(*) AS n_cells, max(n_windows) AS n_windows, round(max(acc),6) AS accuracy FROM v JOIN s USING (subject) GROUP BY ALL""",
)
def cells_per_dataset(spark, d):
    """Cells that share a dataset, with what the dataset holds (worked out once per dataset)."""
    sets = P.accuracy(tables.posteriors(spark, d), ["subject"])
    cells = G.with_variant(_cells(spark, d)).groupBy("subject", "decoder", "variant").agg(F.count(F.lit(1)).alias("n_cells"))
    return cells.join(sets, "subject").select(
        "subject", "decoder", "variant", "n_cells", F.col("n").alias("n_windows"), rounded(F.col("accuracy")).alias("accuracy")
    )


def _episode_rows(spark, d):
    cells = G.with_variant(_cells(spark, d))
    i = F.col("episode_id")
    perm = N.joined_text(G.permuted_classes(4, 1337, i))
    full = cells.select(
        "*", F.lit("20240101-000000-0a1b2c3d").alias("run_id"), (i % 2 * 250).alias("latency_ms"), F.lit("none").alias("error_struct"),
        F.lit(None).cast("string").alias("intent_mode"), (i % 10).alias("seed"), perm.alias("direction_perm"),
        F.col("success_rate").alias("command_accuracy"), (F.col("success_rate") * 8).alias("n_success"), (i % 3).alias("n_timeouts"),
        (F.col("success_rate") * 40.0).alias("effective_itr"), (i % 4).alias("bursts_without_command"), (i % 5 + 100.0).alias("wall_time_s"),
    )
    return RN.episode_frame(full, G.variant_table(spark, VARIANTS), missing="keep")


EP_SQL = CELL_SQL + f""",
w AS (SELECT * FROM (VALUES ('burst_w1000',1.0::FLOAT,0.25::FLOAT),('burst_w2000',2.0::FLOAT,0.25::FLOAT),('stitched_w2000',2.0::FLOAT,0.5::FLOAT)) t(variant, window_s, stride_s)),
ep AS (SELECT v.*, w.window_s, w.stride_s, {EXPERIMENT_SQL} AS experiment FROM v LEFT JOIN w USING (variant))"""


@query(
    "episode_table",
    EP_SQL + """ SELECT experiment, subject::TINYINT AS subject, decoder, mapping, quality_level::FLOAT AS quality_level, alpha::FLOAT AS alpha, window_s, stride_s,
 (episode_id%2*250)::SMALLINT AS latency_ms, protocol, kappa_offline::FLOAT AS kappa_offline, success_rate::FLOAT AS success_rate, (success_rate*8)::TINYINT AS n_success, time_to_target_median::FLOAT AS time_to_target_median,
 CASE WHEN variant IN (SELECT variant FROM w) THEN 'ok' ELSE 'no variant' END AS variant_status, count(*) AS n
 FROM ep GROUP BY ALL""",
)
def episode_table(spark, d):
    """Episode table in contract order and types, counted over its distinct rows; no episode is left out."""
    cols = ["experiment", "subject", "decoder", "mapping", "quality_level", "alpha", "window_s", "stride_s", "latency_ms", "protocol",
            "kappa_offline", "success_rate", "n_success", "time_to_target_median"]
    status = F.when(F.col("window_s").isNull(), "no variant").otherwise("ok").alias("variant_status")
    return _episode_rows(spark, d).groupBy(*cols, status).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cells_without_variant_refused",
    CELL_SQL + " SELECT variant, count(*) AS n, true AS refused FROM v WHERE variant NOT IN (SELECT variant FROM h) GROUP BY variant",
)
def cells_without_variant_refused(spark, d):
    """An episode table is refused while cells name a variant that is not described; here are the cells."""
    cells, variants = _cells(spark, d), G.variant_table(spark, VARIANTS)
    try:
        RN.episode_frame(G.with_variant(cells), variants)
        refused = False
    except ValueError:
        refused = True
    return G.unreachable(cells, variants).groupBy("variant").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


STORE_SQL = SET_SQL + """ SELECT subject, decoder, session, {hash} AS cfg_hash, count(*) AS n_windows, round(sum(t_rel),3) AS t_rel FROM c {where} GROUP BY ALL"""


def _store_counts(spark, path):
    back = PS.read_posteriors(spark, path, validate=True)
    return back.groupBy("subject", "decoder", "session", "cfg_hash").agg(
        F.count(F.lit(1)).alias("n_windows"), rounded(F.sum(F.col("t_rel").cast("double")), 3).alias("t_rel")
    )


@query("store_grows_by_address", STORE_SQL.format(hash="'00112233'", where=""))
def store_grows_by_address(spark, d):
    """Datasets written in steps to one store; a hash of digits stays text, and a second write of an address is refused."""
    path = scratch(spark, "store")
    rows, bursts = _dataset(spark, d).withColumn("cfg_hash", F.lit("00112233")), tables.bursts(spark, d)
    for part in (F.col("subject") < 4, F.col("subject") >= 4):
        PS.write_posteriors(rows.where(part), bursts.where(part), path)
    try:
        PS.write_posteriors(rows.where("subject = 1"), bursts.where("subject = 1"), path)
    except FileExistsError:
        return _store_counts(spark, path)
    raise AssertionError("an address that exists was written again")


@query("store_replaces_one_address", STORE_SQL.format(hash="'0a1b2c3d'", where="WHERE subject<>2 OR session<>'T' OR burst_id%4=0"))
def store_replaces_one_address(spark, d):
    """A forced write replaces the addresses it brings and no others."""
    path = scratch(spark, "store")
    rows, bursts = _dataset(spark, d), tables.bursts(spark, d)
    PS.write_posteriors(rows, bursts, path)
    part = (F.col("subject") == 2) & (F.col("session") == "T") & (F.col("burst_id") % 4 == 0)
    PS.write_posteriors(rows.where(part), bursts.where("subject = 2"), path, force=True)
    return _store_counts(spark, path)


@query(
    "run_round_trip",
    EP_SQL + " SELECT experiment, mapping, count(*) AS n_episodes, round(avg(success_rate),5) AS success_rate FROM ep GROUP BY ALL",
)
def run_round_trip(spark, d):
    """Publish the runs, load them back through the manifest, and count."""
    path = scratch(spark, "runs")
    episodes = _episode_rows(spark, d)
    summary = RN.meta_block(episodes, 1337, False)
    config = episodes.select("experiment", "run_id").distinct().withColumn("config", F.lit('{"seed":1337}'))
    RN.write_run(episodes, summary, config, path)
    back = RN.load_run(spark, path)["episodes"]
    return back.groupBy("experiment", "mapping").agg(
        F.count(F.lit(1)).alias("n_episodes"), rounded(F.avg(F.col("success_rate").cast("double")), 5).alias("success_rate")
    )


@query(
    "summary_replaced",
    EP_SQL + " SELECT experiment, count(*) AS n_episodes, CASE WHEN experiment='main' THEN 7 ELSE 1337 END AS seed FROM ep GROUP BY experiment",
)
def summary_replaced(spark, d):
    """Summaries of one experiment replaced on purpose; the others are left alone."""
    path = scratch(spark, "runs")
    episodes = _episode_rows(spark, d)
    RN.meta_block(episodes, 1337, False).write.partitionBy("experiment", "run_id").parquet(f"{path}/summary")
    again = RN.meta_block(episodes.where(F.col("experiment") == "main"), 7, False)
    RN.write_summary(spark, again, path, force=True)
    return spark.read.parquet(f"{path}/summary").select("experiment", "n_episodes", "seed")


@query(
    "run_metadata",
    EP_SQL + """ SELECT experiment, count(*) AS n_episodes, round(sum(episode_id%5+100.0::DOUBLE),3) AS wall_time_s, 1000 AS n_boot, 0.95::DOUBLE AS ci, 3 AS min_subjects, 'subjects' AS resampled, 1337 AS seed, false AS synthetic
 FROM ep GROUP BY experiment""",
)
def run_metadata(spark, d):
    return RN.meta_block(_episode_rows(spark, d), 1337, False).drop("run_id").withColumn("wall_time_s", rounded(F.col("wall_time_s"), 3))


@query(
    "schema_contract",
    EP_SQL + """, size AS (SELECT count(*) AS n FROM ep)
SELECT k AS table_is, n AS n_rows, missing, extra, reordered FROM size, (VALUES
 ('as published', '', '', ''), ('without a column', 'wall_time_s', '', ''), ('with one more', '', 'note', ''), ('in another order', '', '', 'experiment,run_id')) t(k, missing, extra, reordered)""",
)
def schema_contract(spark, d):
    """The episode table as it is, short of a column, with one more, and in another order: what the contract says of each."""
    e = _episode_rows(spark, d)
    first, second, *rest = e.columns
    cases = {
        "as published": e, "without a column": e.drop("wall_time_s"), "with one more": e.withColumn("note", F.lit("x")),
        "in another order": e.select(second, first, *rest),
    }
    out = None
    for name, table in cases.items():
        found = RN.schema_problems(table.columns)
        said = [F.lit(",".join(sorted(found.get(k, [])))).alias(k) for k in ("missing", "extra", "reordered")]
        row = table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_is"), "n_rows", *said)
        out = row if out is None else out.unionByName(row)
    return out


PRED = f"CASE WHEN {u01('5', chr(39) + 'hit' + chr(39), 'trial_id')}<0.6 THEN class ELSE (class+1)%5 END"
FIT_CTE = f"""
WITH p AS (SELECT subject, session, class, {PRED} AS pred FROM d_trial),
m AS (SELECT subject, class, pred, count(*) AS n FROM p WHERE session='E' GROUP BY ALL),
t AS (SELECT subject, sum(n) AS n, sum(CASE WHEN class=pred THEN n ELSE 0 END) AS hit FROM m GROUP BY subject),
r AS (SELECT subject, class AS k, sum(n) AS r FROM m GROUP BY ALL), c AS (SELECT subject, pred AS k, sum(n) AS c FROM m GROUP BY ALL),
e AS (SELECT r.subject, sum(r*c) AS rc FROM r JOIN c USING (subject, k) GROUP BY r.subject),
f AS (SELECT t.subject, (SELECT count(*) FROM p WHERE p.subject=t.subject AND session='T') AS n_train, CAST(n AS BIGINT) AS n_test, hit/n AS accuracy, (hit/n-rc/(n*n))/(1-rc/(n*n)) AS kappa FROM t JOIN e USING (subject))"""


def _fit_report(spark, d):
    t = tables.trials(spark, d)
    hit = H.u01(5, "hit", F.col("trial_id")) < 0.6
    p = t.withColumn("pred", F.when(hit, F.col("class")).otherwise((F.col("class") + 1) % 5))
    train, test = L.train_test(p)
    n_train = train.groupBy("subject").agg(F.count(F.lit(1)).alias("n_train"))
    return P.agreement(test, ["subject"], "class", "pred").withColumnRenamed("n", "n_test").join(n_train, "subject")


@query("fit_report", FIT_CTE + " SELECT subject, n_train, n_test, round(accuracy,6) AS accuracy, round(kappa,6) AS kappa FROM f")
def fit_report(spark, d):
    return _fit_report(spark, d).select("subject", "n_train", "n_test", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("kappa")).alias("kappa"))


@query(
    "fit_report_overall",
    FIT_CTE + " SELECT count(*) AS n_subjects, round(avg(kappa),6) AS mean_kappa, round(stddev_samp(kappa),6) AS sd_kappa, CASE WHEN avg(kappa) BETWEEN 0.4 AND 0.55 THEN 'within' ELSE 'outside' END AS verdict FROM f",
)
def fit_report_overall(spark, d):
    k = F.avg("kappa")
    return _fit_report(spark, d).agg(
        F.count(F.lit(1)).alias("n_subjects"), rounded(k).alias("mean_kappa"), rounded(F.stddev_samp("kappa")).alias("sd_kappa"),
        F.when(k.between(0.4, 0.55), "within").otherwise("outside").alias("verdict"),
    )


@query(
    "synthetic_posteriors",
    f"""
WITH b AS (SELECT CAST(o_custkey%9+1 AS INT) AS subject, o_orderkey AS burst_id FROM orders),
l AS (SELECT *, (row_number() OVER (PARTITION BY subject ORDER BY md5('11|label|'||burst_id))-1)%4 AS label FROM b),
w AS (SELECT *, unnest(range(0,7)) AS w FROM l),
c AS (SELECT *, {u01("11", "'correct'", "burst_id", "w")}<0.75 AS ok, CAST(floor({u01("11", "'other'", "burst_id", "w")}*3) AS INT) AS o FROM w)
SELECT subject, CAST(label AS INT) AS label, CAST(CASE WHEN ok THEN label WHEN o>=label THEN o+1 ELSE o END AS INT) AS pred, w, count(*) AS n, round(sum(0.7::FLOAT::DOUBLE),3) AS peak_mass FROM c GROUP BY ALL""",
)
def synthetic_posteriors(spark, d):
    """Posteriors of known accuracy, one burst per order, counted by class and prediction."""
    bursts = tables.read(spark, d, "orders").select((F.col("o_custkey") % 9 + 1).cast("int").alias("subject"), F.col("o_orderkey").alias("burst_id"))
    p = SY.synthetic_posteriors(bursts, 11)
    return p.groupBy("subject", "label", V.argmax_class(F.col("posterior")).alias("pred"), F.col("w").cast("bigint").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(F.array_max("posterior").cast("double")), 3).alias("peak_mass")
    )


# --- grid ---

AXES = {
    "subjects": list(range(1, 10)), "decoders": ["F", "O", "P"],
    "mappings": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "quality_levels": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0],
    "protocols": ["burst"], "windows_s": [2.0], "error_structures": ["none"], "intent_modes": [None],
    "alphas": [None, 0.0, 0.25, 0.5, 0.75, 1.0], "latencies_ms": [250],
}


@query(
    "grid_coverage",
    """
WITH g AS (SELECT s.subject, d.decoder, m.mapping, q.q, a.a, r.seed,
   ((((s.i*3+d.i)*5+m.i)*6+q.i)*6+a.i)*2+r.seed AS cell_idx
  FROM (SELECT CAST(i+1 AS INT) AS subject, i FROM range(9) t(i)) s, (VALUES ('F',0),('O',1),('P',2)) d(decoder,i),
   (VALUES ('1-URGENT',0),('2-HIGH',1),('3-MEDIUM',2),('4-NOT SPECIFIED',3),('5-LOW',4)) m(mapping,i), (SELECT i, i AS q FROM range(6) t(i)) q,
   (VALUES (-1,0),(0,1),(1,2),(2,3),(3,4),(4,5)) a(a,i), (SELECT CAST(i AS INT) AS seed FROM range(2) t(i)) r),
n AS (SELECT subject, decoder, mapping, CAST(round(quality_level*5) AS INT) AS q, coalesce(CAST(round(alpha*4) AS INT),-1) AS a, count(*) AS n FROM d_episode GROUP BY ALL)
SELECT cell_idx, g.subject, g.decoder, g.mapping, g.q*0.2::DOUBLE AS quality_level, CASE WHEN g.a>=0 THEN g.a*0.25::DOUBLE END AS alpha, seed, coalesce(n,0) AS n_episodes FROM g LEFT JOIN n ON n.subject=g.subject AND n.decoder=g.decoder AND n.mapping=g.mapping AND n.q=g.q AND n.a=g.a""",
)
def grid_coverage(spark, d):
    """Every cell of a grid in order, with the episodes recorded for it."""
    cells = G.enumerate_cells(spark, "coverage", AXES, 2)
    q, a = F.round(F.col("quality_level") * 5).cast("int"), F.coalesce(F.round(F.col("alpha") * 4).cast("int"), F.lit(-1))
    keys = ["subject", "decoder", "mapping", "_q", "_a"]
    seen = tables.episodes(spark, d).groupBy("subject", "decoder", "mapping", q.alias("_q"), a.alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    out = cells.withColumn("_q", q).withColumn("_a", a).join(seen, keys, "left")
    return G.in_grid_order(out).select(
        "cell_idx", "subject", "decoder", "mapping", (F.col("_q") * 0.2).alias("quality_level"), "alpha", "seed", F.coalesce("_n", F.lit(0)).alias("n_episodes")
    )


KEY_SQL = """'planned|'||subject||'|'||decoder||'|'||mapping||'|'||CAST(round(quality_level*1e6) AS BIGINT)||'|burst|2000000|none|~|'||coalesce(CAST(CAST(round(alpha*1e6) AS BIGINT) AS VARCHAR),'~')||'|250|'||episode_id%4"""


def _keyed(spark, d):
    cols = {
        "experiment": F.lit("planned"), "protocol": F.lit("burst"), "window_s": F.lit(2.0), "error_struct": F.lit("none"),
        "intent_mode": F.lit(None).cast("string"), "latency_ms": F.lit(250), "seed": F.col("episode_id") % 4,
    }
    return tables.episodes(spark, d), G.cell_key(cols)


@query("cell_keys", f"SELECT episode_id, {KEY_SQL} AS cell_key FROM d_episode")
def cell_keys(spark, d):
    e, key = _keyed(spark, d)
    return e.select("episode_id", key.alias("cell_key"))


@query("repeated_cells", f"SELECT {KEY_SQL} AS cell_key, count(*) AS n FROM d_episode GROUP BY 1 HAVING count(*)>1")
def repeated_cells(spark, d):
    return G.duplicate_keys(*_keyed(spark, d))


@query(
    "row_fingerprints",
    """SELECT episode_id, substr(sha256('{"decoder":"'||decoder||'","mapping":"'||mapping||'","subject":'||subject||'}'),1,8) AS fingerprint FROM d_episode""",
)
def row_fingerprints(spark, d):
    """Hash of named fields; the listed one does not count."""
    fields = {"subject": F.col("subject"), "mapping": F.col("mapping"), "decoder": F.col("decoder"), "n_workers": F.lit(8)}
    return tables.episodes(spark, d).select("episode_id", H.payload_hash(fields, exclude=("n_workers",)).alias("fingerprint"))


@query("hashed_uniforms", f"SELECT o_orderkey, round({u01('42', 'o_orderkey', 'o_custkey')},9) AS u FROM orders")
def hashed_uniforms(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", rounded(H.u01(42, F.col("o_orderkey"), F.col("o_custkey")), 9).alias("u"))


@query("run_ids", "SELECT o_orderkey, strftime(o_orderdate,'%Y%m%d-%H%M%S')||'-'||substr(sha256(o_orderstatus),1,8) AS run_id FROM orders")
def run_ids(spark, d):
    o = tables.read(spark, d, "orders")
    return o.select("o_orderkey", N.run_id(F.col("o_orderdate"), H.short_hash(F.col("o_orderstatus"))).alias("run_id"))


@query(
    "variant_keys",
    CELL_SQL + " SELECT variant, protocol, count(*) AS n FROM v GROUP BY ALL",
)
def variant_keys(spark, d):
    return G.with_variant(_cells(spark, d)).groupBy("variant", "protocol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "direction_permutations",
    """WITH k AS (SELECT episode_id, k FROM d_episode, (SELECT unnest(range(0,4)) AS k))
SELECT episode_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY md5('1337|'||episode_id||'|'||k)) AS direction_perm, list_sort(list(k))=[0,1,2,3] AS valid FROM k GROUP BY episode_id""",
)
def direction_permutations(spark, d):
    """Class-to-direction table of every episode, drawn from its content."""
    perm = G.permuted_classes(4, 1337, F.col("episode_id"))
    return tables.episodes(spark, d).select("episode_id", N.joined_text(perm).alias("direction_perm"), G.is_permutation(perm, 4).alias("valid"))


@query(
    "band_edges",
    "SELECT CAST(floor((value-4)/4) AS INT) AS band, min(4.0::DOUBLE+4*floor((value-4)/4)) AS low, min(8.0::DOUBLE+4*floor((value-4)/4)) AS high, count(*) AS n FROM events WHERE value>=4 AND value<40 GROUP BY 1",
)
def band_edges(spark, d):
    """Values per 4-wide band between 4 and 40."""
    b = G.band_of(F.col("value"), 4.0, 40.0, 4.0)
    n = tables.read(spark, d, "events").groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n")).where(F.col("band").isNotNull())
    return n.join(G.band_table(spark, 4.0, 40.0, 4.0), "band").select("band", "low", "high", "n")


@query(
    "plain_values",
    """SELECT mapping, count(*) FILTER (WHERE alpha IS NULL) AS n_null_alpha, round(avg(alpha),6) AS mean_alpha, '{"mapping":"'||mapping||'","n":'||count(*)||',"nothing":null}' AS as_json FROM d_episode GROUP BY mapping""",
)
def plain_values(spark, d):
    """NaN becomes null, six places, and keys in alphabetical order in the JSON text."""
    e = tables.episodes(spark, d).withColumn("alpha", X.nan_to_null(F.coalesce("alpha", F.lit(float("nan")))))
    per = e.groupBy("mapping").agg(
        F.count(F.when(F.col("alpha").isNull(), 1)).alias("n_null_alpha"), rounded(F.avg("alpha")).alias("mean_alpha"), F.count(F.lit(1)).alias("n")
    )
    return per.select("mapping", "n_null_alpha", "mean_alpha", F.to_json(F.struct("mapping", "n", F.lit(None).cast("string").alias("nothing")), {"ignoreNullFields": "false"}).alias("as_json"))


@query(
    "override_problems",
    f"""WITH c AS (SELECT CASE {EXPERIMENT_SQL} WHEN 'main' THEN 's1_argmax' WHEN 'lambda_sweep' THEN 's2_weighted' WHEN 'alpha_sweep' THEN 's3_evidence' ELSE 's4_shared' END AS mapping, alpha,
  CASE WHEN episode_id%6=0 THEN 'aware' END AS intent_mode FROM d_episode),
b AS (SELECT mapping, concat_ws(',', CASE WHEN alpha IS NOT NULL THEN 'alpha' END, CASE WHEN intent_mode IS NOT NULL THEN 'intent_mode' END) AS bad_params FROM c WHERE mapping<>'s4_shared')
SELECT mapping, bad_params, count(*) AS n FROM b WHERE bad_params<>'' GROUP BY ALL""",
)
def override_problems(spark, d):
    """Cells that set a parameter their mapping does not have."""
    from kymora.operators.commands import override_problems as check

    name = N.lookup(experiment_name(), {"main": "s1_argmax", "lambda_sweep": "s2_weighted", "alpha_sweep": "s3_evidence", "ablation_latency": "s4_shared", "ablation_window": "s4_shared"})
    cells = tables.episodes(spark, d).select(name.alias("mapping"), "alpha", F.when(F.col("episode_id") % 6 == 0, "aware").alias("intent_mode"))
    return check(cells).groupBy("mapping", "bad_params").agg(F.count(F.lit(1)).alias("n"))


@query("unit_vector_check", "SELECT episode_id, count(*) FILTER (WHERE abs(sqrt(ix*ix+iy*iy)-1)>1e-6) AS n_intent_off, count(*) FILTER (WHERE abs(sqrt(vx*vx+vy*vy)-1)>1e-6) AS n_velocity_off FROM d_trace GROUP BY episode_id")
def unit_vector_check(spark, d):
    off = lambda x, y: F.count(F.when(F.abs(V.hypot(F.col(x), F.col(y)) - 1.0) > 1e-6, 1))
    return tables.trace(spark, d).groupBy("episode_id").agg(off("ix", "iy").alias("n_intent_off"), off("vx", "vy").alias("n_velocity_off"))


@query(
    "usable_responses",
    """SELECT mapping, count(*) AS n, count(*) FILTER (WHERE time_to_target_median IS NULL) AS n_dropped, round(avg(ln(time_to_target_median)),6) AS mean_log,
 round(avg(ln(((success_rate*8+0.5)/9)/(1-(success_rate*8+0.5)/9))),6) AS mean_logit, count(*) FILTER (WHERE success_rate<=0) AS n_outside_log FROM d_episode GROUP BY mapping""",
)
def usable_responses(spark, d):
    """Rows with a response, rows dropped, the response transforms and domain violations."""
    e = tables.episodes(spark, d)
    t, s = F.col("time_to_target_median"), F.col("success_rate")
    return e.groupBy("mapping").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(t.isNull() | F.isnan(t), 1)).alias("n_dropped"),
        rounded(F.avg(X.transformed(t, "log", 8))).alias("mean_log"), rounded(F.avg(X.transformed(s, "logit", 8))).alias("mean_logit"),
        F.count(F.when(~X.in_domain(s, "log"), 1)).alias("n_outside_log"),
    )


@query("feature_checks", "SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding)<>64) AS n_wrong_size, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))>0) AS n_not_finite FROM embeddings GROUP BY label")
def feature_checks(spark, d):
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return tables.read(spark, d, "embeddings").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(v) != 64, 1)).alias("n_wrong_size"), F.count(F.when(bad, 1)).alias("n_not_finite")
    )


@query(
    "labels_contiguous",
    "SELECT subject, session, count(DISTINCT class) AS n_classes, max(class) AS top, min(class)=0 AND max(class)+1=count(DISTINCT class) AS contiguous FROM (SELECT subject, session, CASE WHEN subject=2 AND class=1 THEN 0 ELSE class END AS class FROM d_trial) GROUP BY ALL",
)
def labels_contiguous(spark, d):
    """Labels must run from zero without a hole; subject 2 gets one here."""
    hole = (F.col("subject") == 2) & (F.col("class") == 1)
    t = tables.trials(spark, d).withColumn("class", F.when(hole, 0).otherwise(F.col("class")))
    n = F.countDistinct("class")
    return t.groupBy("subject", "session").agg(
        n.alias("n_classes"), F.max("class").alias("top"), ((F.min("class") == 0) & (F.max("class") + 1 == n)).alias("contiguous")
    )


@query("class_counts", "WITH c AS (SELECT subject, class, count(*) AS n FROM d_trial GROUP BY ALL) SELECT subject, class, n, min(n) OVER (PARTITION BY subject) AS smallest_class FROM c")
def class_counts(spark, d):
    t = tables.trials(spark, d)
    return t.groupBy("subject", "class").agg(F.count(F.lit(1)).alias("n")).join(L.smallest_class(t, ["subject"]), "subject")


# --- draws ---


def _requests(spark, d):
    ev = tables.trace(spark, d)
    return ev.select("episode_id", "step", (F.col("episode_id") % 9 + 1).cast("int").alias("subject"), (F.col("event_id") % 5).cast("int").alias("class"))


@query(
    "bursts_drawn",
    f"""
WITH q AS (SELECT episode_id, step, CAST(episode_id%9+1 AS INT) AS subject, CAST(event_id%5 AS INT) AS class FROM d_trace),
s AS (SELECT subject, label AS class, burst_id, row_number() OVER (PARTITION BY subject, label ORDER BY md5('9|pool|'||burst_id))-1 AS slot FROM d_burst),
z AS (SELECT subject, class, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT q.*, row_number() OVER (PARTITION BY episode_id, q.class ORDER BY step)-1 AS k FROM q),
j AS (SELECT k.*, z.n, k.k//z.n AS cycle FROM k LEFT JOIN z USING (subject, class)),
m AS (SELECT *, [1000000007,1000000009,1000000021,1000000033,1000000087,1000000093,1000000097,1000000103][CAST(floor({u01("9", "'multiplier'", "episode_id", "class", "cycle")}*8) AS INT)+1] AS prime,
   CAST(floor({u01("9", "'offset'", "episode_id", "class", "cycle")}*n) AS BIGINT) AS shift FROM j)
SELECT m.episode_id, m.step, m.subject, m.class, m.cycle, s.burst_id FROM m LEFT JOIN s ON s.subject=m.subject AND s.class=m.class AND s.slot=((k%n)*(prime%n)+shift)%n""",
)
def bursts_drawn(spark, d):
    """A burst for every request, each once per cycle; class 4 has none and stays null."""
    out = G.draw_bursts(_requests(spark, d), tables.bursts(spark, d), 9)
    return out.select("episode_id", "step", "subject", "class", "cycle", "burst_id")


@query(
    "unmatched_classes",
    "SELECT CAST(episode_id%9+1 AS INT) AS subject, CAST(event_id%5 AS INT) AS class, count(*) AS n_requests FROM d_trace q WHERE NOT EXISTS (SELECT 1 FROM d_burst b WHERE b.subject=q.episode_id%9+1 AND b.label=q.event_id%5) GROUP BY ALL",
)
def unmatched_classes(spark, d):
    return G.unmatched_classes(_requests(spark, d), tables.bursts(spark, d))


DRAW_SQL = f"""
WITH s AS (SELECT subject, row_number() OVER (ORDER BY substr(md5(CAST(subject AS VARCHAR)),1,3), subject)-1 AS i FROM (SELECT DISTINCT subject FROM d_episode)),
n AS (SELECT count(*) AS n FROM s),
g AS (SELECT r.replicate, s.i AS copy, CAST(floor({u01("77", "'resample'", "replicate", "s.i")}*n) AS BIGINT) AS pick FROM s, n, (SELECT CAST(unnest(range(1,41)) AS INT) AS replicate) r),
w AS (SELECT replicate, copy, s.subject, s.subject||'_r'||copy AS resampled FROM g JOIN s ON s.i=g.pick)"""


@query("resampled_subjects", DRAW_SQL + " SELECT replicate, copy, subject, resampled FROM w")
def resampled_subjects(spark, d):
    return G.draw_subjects(tables.episodes(spark, d), 40, 77)


@query(
    "resampled_means",
    DRAW_SQL + ", e AS (SELECT subject, count(*) AS n, avg(success_rate) AS m FROM d_episode GROUP BY subject) SELECT replicate, count(DISTINCT resampled) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, round(avg(m),6) AS mean_success FROM w JOIN e USING (subject) GROUP BY replicate",
)
def resampled_means(spark, d):
    """Replicates of whole subjects; episodes are averaged per subject before they are repeated."""
    e = tables.episodes(spark, d)
    per = e.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.avg("success_rate").alias("m"))
    out = G.resample(per, G.draw_subjects(e, 40, 77))
    return out.groupBy("replicate").agg(F.countDistinct("resampled").alias("n_groups"), F.sum("n").alias("n_rows"), rounded(F.avg("m")).alias("mean_success"))


PREFERRED = {
    "quality_sweep": ("lambda_sweep", "main"), "kappa_against_success": ("main", "lambda_sweep"),
    "autonomy_sweep": ("alpha_sweep_blind", "alpha_sweep"), "command_accuracy": ("ablation_latency", "main"),
    "intent_ablation": ("ablation_intent_blind", "nothing_else"),
}


@query(
    "runs_for_figures",
    f"""
WITH r AS (SELECT {EXPERIMENT_SQL.replace("mapping", "o_orderpriority")} AS experiment, o_orderstatus AS run_id, min(o_orderkey) AS given FROM orders GROUP BY ALL),
f AS (SELECT experiment, arg_min(run_id, given) AS run_id, min(given) AS given FROM r GROUP BY experiment),
p AS (SELECT * FROM (VALUES ('quality_sweep','lambda_sweep',0),('quality_sweep','main',1),('kappa_against_success','main',0),('kappa_against_success','lambda_sweep',1),('autonomy_sweep','alpha_sweep_blind',0),
  ('autonomy_sweep','alpha_sweep',1),('command_accuracy','ablation_latency',0),('command_accuracy','main',1),('intent_ablation','ablation_intent_blind',0),('intent_ablation','nothing_else',1)) t(figure, experiment, rank)),
m AS (SELECT figure, experiment, run_id, row_number() OVER (PARTITION BY figure ORDER BY CASE WHEN run_id IS NULL THEN 99 ELSE rank END) AS k FROM p LEFT JOIN f USING (experiment))
SELECT figure, CASE WHEN run_id IS NULL THEN (SELECT arg_min(experiment, given) FROM r) ELSE experiment END AS experiment, coalesce(run_id, (SELECT arg_min(run_id, given) FROM r)) AS run_id FROM m WHERE k=1""",
)
def runs_for_figures(spark, d):
    """Preferred run per figure, any run where none of the preferred exists."""
    runs = tables.read(spark, d, "orders").withColumnRenamed("o_orderpriority", "mapping").groupBy(
        experiment_name().alias("experiment"), F.col("o_orderstatus").alias("run_id")
    ).agg(F.min("o_orderkey").alias("given"))
    rows = [(fig, e, i) for fig, es in PREFERRED.items() for i, e in enumerate(es)]
    return G.pick_runs(runs, spark.createDataFrame(rows, "figure string, experiment string, rank int"))


# --- set operations ---


@query(
    "session_differences",
    """SELECT 'T' AS only_in, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate<TIMESTAMP '1998-04-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate>=TIMESTAMP '1998-04-01')
UNION ALL SELECT 'E', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate>=TIMESTAMP '1998-04-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate<TIMESTAMP '1998-04-01')
UNION ALL SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderdate>=TIMESTAMP '1998-04-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate<TIMESTAMP '1998-04-01')""",
)
def session_differences(spark, d):
    """Customers seen in one session only, each way, and in both: one pass over the orders."""
    o = tables.read(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1998-04-01").cast("timestamp_ntz")
    per = o.groupBy("o_custkey").agg(F.bool_or(early).alias("t"), F.bool_or(~early).alias("e"))
    where = F.when(F.col("t") & F.col("e"), "both").when(F.col("t"), "T").otherwise("E")
    return per.groupBy(where.alias("only_in")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_is_exact",
    """SELECT subject, count(*) FILTER (WHERE session='T') AS n_train, count(*) FILTER (WHERE session='E') AS n_test, count(*)-count(DISTINCT trial_id) AS n_shared,
 count(DISTINCT trial_id) FILTER (WHERE session IN ('T','E'))=count(*) AS covers FROM d_trial GROUP BY subject""",
)
def split_is_exact(spark, d):
    """Train and test trials: nothing shared, nothing lost."""
    t = tables.trials(spark, d)
    train, test = L.train_test(t)
    sides = train.withColumn("side", F.lit(1)).unionByName(test.withColumn("side", F.lit(2))).groupBy("subject", "trial_id").agg(
        F.max(F.when(F.col("side") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("side") == 2, 1).otherwise(0)).alias("b")
    )
    per = sides.groupBy("subject").agg(
        F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.count(F.when((F.col("a") == 1) & (F.col("b") == 1), 1)).alias("n_shared"), F.count(F.lit(1)).alias("_u")
    )
    whole = t.groupBy("subject").agg(F.count(F.lit(1)).alias("_all"))
    return per.join(whole, "subject").select("subject", "n_train", "n_test", "n_shared", (F.col("_u") == F.col("_all")).alias("covers"))


@query("split_problems", """WITH x AS (SELECT subject, CASE WHEN subject=4 AND session='E' THEN 'X' ELSE session END AS session FROM d_trial)
SELECT subject, count(*) FILTER (WHERE session='T') AS n_train, count(*) FILTER (WHERE session='E') AS n_test, count(*) FILTER (WHERE session IS NULL OR session NOT IN ('T','E')) AS n_unknown
FROM x GROUP BY subject HAVING n_train=0 OR n_test=0 OR n_unknown>0""")
def split_problems(spark, d):
    """Subject 4 has its second session renamed, which the split refuses."""
    t = tables.trials(spark, d)
    return L.split_problems(t.withColumn("session", F.when((F.col("subject") == 4) & (F.col("session") == "E"), "X").otherwise(F.col("session"))))


@query(
    "inner_folds",
    "SELECT trial_id, subject, class, CAST((row_number() OVER (PARTITION BY subject, class ORDER BY md5('21|fold|'||trial_id))-1)%5 AS INT) AS fold FROM d_trial WHERE session='T'",
)
def inner_folds(spark, d):
    return L.inner_folds(tables.trials(spark, d), 5, 21).select("trial_id", "subject", "class", "fold")


@query(
    "stratified_holdout",
    "SELECT trial_id, subject, class, row_number() OVER (PARTITION BY subject, class ORDER BY md5('22|holdout|'||trial_id))-1 < round_even(count(*) OVER (PARTITION BY subject, class)*0.2::DOUBLE,0) AS validation FROM d_trial WHERE session='T'",
)
def stratified_holdout(spark, d):
    train, _ = L.train_test(tables.trials(spark, d))
    return L.holdout(train, 0.2, 22, ["subject"]).select("trial_id", "subject", "class", "validation")


@query(
    "scaled_on_train",
    """WITH f AS (SELECT o_orderkey AS trial_id, o_custkey%9+1 AS s, o_totalprice AS price, o_orderdate<TIMESTAMP '1998-04-01' AS train FROM orders),
m AS (SELECT s, avg(price) FILTER (WHERE train) AS mu, stddev_pop(price) FILTER (WHERE train) AS sd FROM f GROUP BY s)
SELECT trial_id, CAST(s AS INT) AS subject, CASE WHEN train THEN 'T' ELSE 'E' END AS session, round((price-mu)/sd,6)+0.0 AS price FROM f JOIN m USING (s)""",
)
def scaled_on_train(spark, d):
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_totalprice").alias("price"))
    rows = tables.trials(spark, d).select("trial_id", "subject", "session").join(o, "trial_id")
    out = L.standardise_on_train(rows, ["price"], F.col("session") == "T", ["subject"])
    return out.select("trial_id", "subject", "session", rounded(F.col("price")).alias("price"))


@query(
    "top_features",
    "WITH u AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(0,64)) AS feature FROM embeddings), s AS (SELECT feature, round(var_pop(v),9) AS score FROM u GROUP BY feature) SELECT CAST(feature AS INT) AS feature, round(score,6) AS score FROM s ORDER BY s.score DESC, s.feature LIMIT 10",
)
def top_features(spark, d):
    """Ten features with the largest variance; equal scores by index."""
    u = tables.read(spark, d, "embeddings").select(F.posexplode("embedding").alias("feature", "v"))
    s = u.groupBy("feature").agg(F.round(F.var_pop(F.col("v").cast("double")), 9).alias("s"))
    return s.orderBy(F.desc("s"), "feature").limit(10).select("feature", rounded(F.col("s")).alias("score"))


@query(
    "versioned_store",
    """SELECT version, subject, count(*) AS n, CAST(sum(label + CASE WHEN version=2 AND subject=3 THEN 10 ELSE 0 END) AS BIGINT) AS total
FROM d_posterior, (SELECT CAST(unnest([1,2]) AS INT) AS version) GROUP BY ALL""",
)
def versioned_store(spark, d):
    """All subjects committed at once, then one replaced: both versions of the store, read back."""
    p = tables.posteriors(spark, d).select("window_id", "subject", F.col("label").cast("int").alias("label"))
    root = scratch(spark, "store")
    first = snapshots.commit(p, root, ["subject"])
    second = snapshots.commit(p.where("subject = 3").withColumn("label", F.col("label") + 10), root, ["subject"], replace=True)
    read = [snapshots.read(spark, root, v).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("total")).select(F.lit(v).alias("version"), "subject", "n", "total") for v in (first, second)]
    return read[0].unionByName(read[1])
