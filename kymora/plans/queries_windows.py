"""Recordings, trials, windows and cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kymora.functions import naming as N
from kymora.functions.vectors import rounded
from kymora.operators import series
from kymora.operators import windows as W
from kymora.plans.registry import query
from kymora.session import shared_dir
from kymora.sources import recordings as R
from kymora.sources import snapshots, tables


def _lengths(spark, d):
    return tables.samples(spark, d).groupBy("subject", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(
    "window_starts",
    """
WITH l AS (SELECT subject, channel, count(*) AS n FROM d_sample GROUP BY ALL),
g AS (SELECT subject, channel, n, unnest(range(0, CAST(ceil(n/6.25) AS BIGINT)+1)) AS i FROM l)
SELECT subject, channel, CAST(floor(i*6.25::DOUBLE+0.5) AS BIGINT) AS start_sample FROM g WHERE floor(i*6.25::DOUBLE+0.5)+32<=n""",
)
def window_starts(spark, d):
    """Starts of 32-sample windows every 6.25 samples in every series."""
    return W.window_starts(_lengths(spark, d), ["subject", "channel"], "n", 32, 6.25)


BURST_SQL = """
SELECT trial_id, subject, session, CAST(floor(i*62.5::DOUBLE+0.5) AS BIGINT) AS start_sample,
       round((floor(i*62.5::DOUBLE+0.5)+500)/250.0::DOUBLE,6) AS t_rel, class AS label, false AS boundary,
       onset_s+0.5::DOUBLE AS burst_onset, onset_s+4.0::DOUBLE AS burst_offset
FROM d_trial, (SELECT unnest(range(0,20)) AS i) WHERE floor(i*62.5::DOUBLE+0.5)+500<=875"""
STITCHED_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject, session ORDER BY onset_s, trial_id)-1 AS pos,
                  count(*) OVER (PARTITION BY subject, session) AS nt FROM d_trial),
s AS (SELECT subject, session, max(nt)*875 AS total FROM r GROUP BY ALL),
w AS (SELECT subject, session, total, CAST(floor(i*62.5::DOUBLE+0.5) AS BIGINT) AS start_sample
      FROM (SELECT *, unnest(range(0, CAST(total/62.5 AS BIGINT)+2)) AS i FROM s)),
k AS (SELECT *, (start_sample+499)//875 AS pos FROM w WHERE start_sample+500<=total)
SELECT trial_id, k.subject, k.session, start_sample, round((start_sample+500-k.pos*875)/250.0::DOUBLE,6) AS t_rel, class AS label,
       start_sample//875<>k.pos AS boundary, onset_s+0.5::DOUBLE AS burst_onset, onset_s+4.0::DOUBLE AS burst_offset
FROM k JOIN r ON r.subject=k.subject AND r.session=k.session AND r.pos=k.pos"""
WINDOW_COLUMNS = ["trial_id", "subject", "session", "start_sample", "t_rel", "label", "boundary", "burst_onset", "burst_offset"]


def _window_rows(spark, d, protocol):
    out = W.build_windows(tables.trials(spark, d), protocol)
    return out.withColumn("t_rel", rounded(F.col("t_rel"))).select(*WINDOW_COLUMNS)


@query("burst_windows", BURST_SQL)
def burst_windows(spark, d):
    return _window_rows(spark, d, "burst")


@query("stitched_windows", STITCHED_SQL)
def stitched_windows(spark, d):
    return _window_rows(spark, d, "stitched")


@query(
    "stitched_without_boundaries",
    f"SELECT subject, session, count(*) AS n_windows, round(avg(t_rel),6) AS mean_t_rel FROM ({STITCHED_SQL}) q WHERE NOT boundary GROUP BY ALL".replace("WITH r AS", "WITH r AS"),
)
def stitched_without_boundaries(spark, d):
    out = W.build_windows(tables.trials(spark, d), "stitched").where(~F.col("boundary"))
    return out.groupBy("subject", "session").agg(
        F.count(F.lit(1)).alias("n_windows"), rounded(F.avg(F.round("t_rel", 6))).alias("mean_t_rel")
    )


@query(
    "windows_by_protocol",
    f"""SELECT 'burst' AS protocol, label, count(*) AS n, count(*) FILTER (WHERE boundary) AS n_boundary FROM ({BURST_SQL}) a GROUP BY label
UNION ALL SELECT 'stitched', label, count(*), count(*) FILTER (WHERE boundary) FROM ({STITCHED_SQL}) b GROUP BY label""",
)
def windows_by_protocol(spark, d):
    """Both protocols through the one dispatching function."""
    t = tables.trials(spark, d)
    parts = [
        W.build_windows(t, p)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("boundary"), 1)).alias("n_boundary"))
        .withColumn("protocol", F.lit(p))
        for p in W.PROTOCOLS
    ]
    return parts[0].unionByName(parts[1])


def _summary(df):
    return df.select(
        *[c for c in df.columns if c != "signal"],
        F.size("signal").alias("n"),
        rounded(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v)).alias("total"),
        rounded(F.element_at("signal", 1)).alias("first_value"),
        rounded(F.element_at("signal", -1)).alias("last_value"),
    )


@query(
    "extract_windows",
    """
WITH l AS (SELECT subject, channel, count(*) AS n FROM d_sample GROUP BY ALL),
g AS (SELECT subject, channel, n, unnest(range(0, CAST(ceil(n/12.5) AS BIGINT)+1)) AS i FROM l),
w AS (SELECT subject, channel, CAST(floor(i*12.5::DOUBLE+0.5) AS BIGINT) AS start_sample FROM g WHERE floor(i*12.5::DOUBLE+0.5)+32<=n)
SELECT w.subject, w.channel, start_sample, CAST(count(*) AS INT) AS n, round(sum(value),6) AS total,
       arg_min(value, sample_idx) AS first_value, arg_max(value, sample_idx) AS last_value
FROM w JOIN d_sample s ON s.subject=w.subject AND s.channel=w.channel AND sample_idx>=start_sample AND sample_idx<start_sample+32
GROUP BY ALL""",
)
def extract_windows(spark, d):
    """Signal of every 32-sample window of every series."""
    s = tables.samples(spark, d)
    w = W.window_starts(_lengths(spark, d), ["subject", "channel"], "n", 32, 12.5)
    w = w.withColumn("window_id", F.col("start_sample"))
    out = W.cut(s, w, ["subject", "channel"], ["subject", "channel"], "window_id", "start_sample", 32)
    return _summary(out.drop("window_id", "status"))


EPOCH_CTE = """
WITH l AS (SELECT subject, min(n) AS n_samples FROM (SELECT subject, channel, count(*) AS n FROM d_sample GROUP BY ALL) GROUP BY subject),
e AS (SELECT trial_id, d_trial.subject, artifact, n_samples, CAST(round_even(onset_s*0.0015::DOUBLE,0) AS BIGINT)+2 AS start_sample FROM d_trial JOIN l USING (subject)),
p AS (SELECT *, greatest(start_sample+8-n_samples,0) AS shortfall,
             CASE WHEN start_sample<0 OR start_sample+8-n_samples>4 THEN 'error' WHEN start_sample+8-n_samples>0 THEN 'truncated' ELSE 'ok' END AS status FROM e)"""


def _plan(spark, d):
    per = _lengths(spark, d).groupBy("subject").agg(F.min("n").alias("n_samples"))
    # 0.0015 Hz puts the cues of the trial table on the sample numbers of the sample table.
    return W.plan_epochs(
        tables.trials(spark, d), per, ["subject"], onset="onset_s", sfreq=0.0015, tmin=1333.0, n=8, max_short=4
    )


@query("trial_truncation", EPOCH_CTE + " SELECT subject, status, count(*) AS n, max(shortfall) AS worst FROM p GROUP BY ALL")
def trial_truncation(spark, d):
    return _plan(spark, d).groupBy("subject", "status").agg(F.count(F.lit(1)).alias("n"), F.max("shortfall").alias("worst"))


@query(
    "published_trial_plans",
    EPOCH_CTE + " SELECT CAST(subject AS INT) AS subject, trial_id, start_sample, shortfall, status FROM p WHERE status<>'error'",
)
def published_trial_plans(spark, d):
    """Plans of trials as the store took them: one that holds errors is refused, then only the rest is committed and read back."""
    root, plan, refuse = f"{shared_dir(spark)}/plans-{uuid.uuid4().hex}", _plan(spark, d), {"status": ["error", "no recording"]}
    rows = plan.select(F.col("subject").cast("int").alias("subject"), "trial_id", "start_sample", "shortfall", "status")
    try:
        snapshots.commit(rows, root, ["subject"], refuse=refuse)
    except snapshots.RefusedRows:
        snapshots.commit(rows.where(~F.col("status").isin(refuse["status"])), root, ["subject"], refuse=refuse)
    return snapshots.read(spark, root).select(*rows.columns)


@query(
    "epoch_cut",
    EPOCH_CTE + """
SELECT p.subject, s.channel, p.trial_id, p.start_sample, CAST(count(*) AS INT) AS n, round(sum(value),6) AS total,
       arg_min(value, sample_idx) AS first_value, arg_max(value, sample_idx) AS last_value
FROM p JOIN d_sample s ON s.subject=p.subject AND sample_idx>=start_sample AND sample_idx<start_sample+8
WHERE status='ok' GROUP BY ALL""",
)
def epoch_cut(spark, d):
    """Eight samples after every cue, for every channel."""
    ok = _plan(spark, d).where(F.col("status") == "ok")
    return _summary(W.cut(tables.samples(spark, d), ok, ["subject"], ["subject", "channel"], "trial_id", "start_sample", 8).drop("status"))


KEPT_CTE = """WITH l AS (SELECT subject, channel, count(*) AS n FROM d_sample GROUP BY ALL),
t AS (SELECT trial_id, subject+trial_id%2 AS subject, CAST(round_even(onset_s*0.0015::DOUBLE,0) AS BIGINT)-3 AS start_sample FROM d_trial),
j AS (SELECT t.subject, l.channel, trial_id, start_sample, CASE WHEN n IS NULL THEN 'no recording' WHEN start_sample<0 OR start_sample>=n THEN 'outside' WHEN start_sample+8>n THEN 'short' ELSE 'ok' END AS status,
 CAST(CASE WHEN start_sample>=0 AND start_sample<n THEN least(8,n-start_sample) END AS INT) AS n FROM t LEFT JOIN l ON l.subject=t.subject)"""


@query("every_range_with_status", KEPT_CTE + " SELECT subject, channel, trial_id, start_sample, status, n FROM j")
def every_range_with_status(spark, d):
    """Cuts around every cue: whole, short, outside their series, or of a subject without recording; none is lost."""
    t = tables.trials(spark, d)
    start = F.bround(F.col("onset_s") * 0.0015).cast("bigint") - 3
    t = t.select("trial_id", (F.col("subject") + F.col("trial_id") % 2).alias("subject"), start.alias("start_sample"))
    out = W.cut(tables.samples(spark, d), t, ["subject"], ["subject", "channel"], "trial_id", "start_sample", 8)
    return out.select("subject", "channel", "trial_id", "start_sample", "status", F.size("signal").alias("n"))


@query(
    "trials_without_recording",
    """WITH l AS (SELECT subject, min(n) AS n_samples FROM (SELECT subject, channel, count(*) AS n FROM d_sample GROUP BY ALL) WHERE subject<>3 GROUP BY subject),
p AS (SELECT d_trial.subject, n_samples, CAST(round_even(onset_s*0.0015::DOUBLE,0) AS BIGINT)+2 AS start_sample FROM d_trial LEFT JOIN l USING (subject))
SELECT subject, CASE WHEN n_samples IS NULL THEN 'no recording' WHEN start_sample<0 OR start_sample+8-n_samples>4 THEN 'error' WHEN start_sample+8-n_samples>0 THEN 'truncated' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY ALL""",
)
def trials_without_recording(spark, d):
    """Statuses of all trials where one subject has no length row."""
    per = _lengths(spark, d).where("subject <> 3").groupBy("subject").agg(F.min("n").alias("n_samples"))
    plan = W.plan_epochs(tables.trials(spark, d), per, ["subject"], onset="onset_s", sfreq=0.0015, tmin=1333.0, n=8, max_short=4)
    return plan.groupBy("subject", "status").agg(F.count(F.lit(1)).alias("n"))


def _clock(spark, d):
    ev = tables.read(spark, d, "events")
    t = tables.seconds("ts") - 1704067200.0
    return ev.select(F.col("event_id"), (F.col("user_id") % 9 + 1).cast("int").alias("subject"), "event_type", "value", t.alias("t"))


OVERLAP_SQL = """
WITH c AS (SELECT event_id, CAST(user_id%9+1 AS INT) AS subject, event_type, value, epoch_us(ts)/1e6-1704067200.0 AS t FROM events),
q AS (SELECT subject, event_id, EXISTS (SELECT 1 FROM c s WHERE s.subject=c.subject AND s.event_type='error' AND s.t < c.t+4.0*60 AND c.t+0.5*60 < s.t+s.value*30) AS artifact
      FROM c WHERE event_type='click')
"""


def _artifact_flags(spark, d):
    c = _clock(spark, d)
    probes = c.where(F.col("event_type") == "click").select(
        "subject", "event_id", (F.col("t") + 30.0).alias("start"), (F.col("t") + 240.0).alias("stop")
    )
    spans = c.where(F.col("event_type") == "error").select(
        "subject", F.col("t").alias("start"), (F.col("t") + F.col("value") * 30).alias("stop")
    )
    return W.overlaps_any(probes, spans, ["subject"], "event_id", "start", "stop", "artifact")


@query("artifact_overlap", OVERLAP_SQL + "SELECT subject, event_id, artifact FROM q")
def artifact_overlap(spark, d):
    """Cues whose trial window touches a rejected span (long spans included)."""
    return _artifact_flags(spark, d)


@query(
    "artifact_drop_counts",
    OVERLAP_SQL + """SELECT subject, count(*) FILTER (WHERE NOT artifact) AS n_kept, count(*) FILTER (WHERE artifact) AS n_dropped,
EXISTS (SELECT 1 FROM c e WHERE e.subject=q.subject AND e.event_type='error') AS marks_found FROM q GROUP BY subject""",
)
def artifact_drop_counts(spark, d):
    """Kept and dropped trials per subject, and whether any reject mark existed."""
    marks = _clock(spark, d).groupBy("subject").agg(F.bool_or(F.col("event_type") == "error").alias("marks_found"))
    per = _artifact_flags(spark, d).groupBy("subject").agg(
        F.count(F.when(~F.col("artifact"), 1)).alias("n_kept"), F.count(F.when(F.col("artifact"), 1)).alias("n_dropped")
    )
    return per.join(marks, "subject")


@query(
    "labelled_trials",
    "SELECT subject, session, class AS class_from_code, count(*) AS n FROM d_trial WHERE class BETWEEN 0 AND 3 GROUP BY ALL",
)
def labelled_trials(spark, d):
    """Annotations that name a class; the fifth code of the table names none."""
    t = tables.trials(spark, d).withColumn("code", F.col("class") + 769)
    return R.labelled(t, "code").groupBy("subject", "session", "class_from_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_dictionary",
    """SELECT class+769 AS code, CASE WHEN class<4 THEN class END AS class, CASE class WHEN 0 THEN 'left_hand' WHEN 1 THEN 'right_hand' WHEN 2 THEN 'feet' WHEN 3 THEN 'tongue' END AS name,
CASE WHEN class<4 THEN class END AS class_from_name, count(*) AS n FROM d_trial GROUP BY class""",
)
def label_dictionary(spark, d):
    t = tables.trials(spark, d).groupBy((F.col("class") + 769).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    cls = N.class_of_code(F.col("code"))
    return t.select("code", cls.alias("class"), N.class_name(cls).alias("name"), N.class_of_name(N.class_name(cls)).alias("class_from_name"), "n")


@query(
    "trial_numbers",
    """SELECT trial_id, subject, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN session='T' THEN 0 ELSE 1 END, run, onset_s, trial_id)-1 AS trial_no FROM d_trial""",
)
def trial_numbers(spark, d):
    return W.number_trials(tables.trials(spark, d)).select("trial_id", "subject", "trial_no")


@query(
    "epoch_lengths",
    """SELECT class, CAST(round_even((4.0::DOUBLE+0.006::DOUBLE*class-0.5::DOUBLE)*250.0::DOUBLE,0) AS BIGINT) AS n_times,
CAST(round_even((4.0::DOUBLE+0.006::DOUBLE*class-0.5::DOUBLE)*250.0::DOUBLE,0) AS BIGINT)+1 AS n_with_end, count(*) AS n_trials FROM d_trial GROUP BY class""",
)
def epoch_lengths(spark, d):
    """Trial length for spans that end a little later per class, with and without the end sample."""
    tmax = F.lit(4.0) + 0.006 * F.col("class")
    return tables.trials(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n_trials")).select(
        "class", W.epoch_length(0.5, tmax, 250.0).alias("n_times"), W.epoch_length(0.5, tmax, 250.0, True).alias("n_with_end"), "n_trials"
    )


@query(
    "channel_pick",
    "SELECT subject, count(DISTINCT channel) AS n_channels, count(DISTINCT channel)=4 AS ok FROM d_sample WHERE channel<>'error' GROUP BY subject",
)
def channel_pick(spark, d):
    return R.pick_channels(tables.samples(spark, d), ["error"], 4)[1]


@query(
    "scale_check",
    "SELECT subject, round(stddev_pop(value*0.02),6) AS sd, stddev_pop(value*0.02) BETWEEN 0.2 AND 0.9 AS in_range FROM d_sample GROUP BY subject",
)
def scale_check(spark, d):
    return R.scale_check(tables.samples(spark, d), 0.02, 0.2, 0.9).withColumn("sd", rounded(F.col("sd")))


VERIFY_CTE = """
WITH x AS (SELECT s.i AS subject, k.session FROM (SELECT CAST(unnest(range(1,11)) AS INT) AS i) s, (SELECT unnest(['T','E']) AS session) k),
g AS (SELECT subject, session, count(DISTINCT run) AS n_runs, count(*) AS n_trials FROM d_trial GROUP BY ALL),
v AS (SELECT coalesce(x.subject,g.subject) AS subject, coalesce(x.session,g.session) AS session, coalesce(n_runs,0) AS n_runs, coalesce(n_trials,0) AS n_trials
      FROM x FULL JOIN g ON x.subject=g.subject AND x.session=g.session),
c AS (SELECT *, concat_ws('; ', CASE WHEN n_runs<>6 THEN 'session '||session||': '||n_runs||' runs, expected 6' END,
                         CASE WHEN n_trials<>850 THEN 'session '||session||': '||n_trials||' trials, expected 850' END) AS problems FROM v)"""


def _verified(spark, d):
    expected = spark.range(1, 11).select(
        F.col("id").cast("int").alias("subject"), F.explode(F.array(F.lit("T"), F.lit("E"))).alias("session")
    )
    return R.verify(tables.trials(spark, d), expected, 6, 850)


@query("recording_verification", VERIFY_CTE + " SELECT subject, session, n_runs, n_trials, problems FROM c")
def recording_verification(spark, d):
    """Runs and trials per session against what was expected; subject 10 was promised and never came."""
    return _verified(spark, d)


@query(
    "recording_report",
    VERIFY_CTE + """ SELECT subject, max(CASE WHEN session='T' THEN n_runs END)||'/'||max(CASE WHEN session='E' THEN n_runs END) AS runs,
max(CASE WHEN session='T' THEN n_trials END)||'/'||max(CASE WHEN session='E' THEN n_trials END) AS trials,
CASE WHEN bool_and(problems='') THEN 'ok' ELSE string_agg(problems, '; ' ORDER BY session DESC) FILTER (WHERE problems<>'') END AS status FROM c GROUP BY subject""",
)
def recording_report(spark, d):
    return R.report(_verified(spark, d))


KEYS = {"0train": "T", "1test": "E"}


def _raw_keys(spark, d):
    t = tables.trials(spark, d)
    key = F.when(F.col("run") == 5, "2extra").when(F.col("session") == "T", "0train").otherwise("1test")
    key = F.when((F.col("subject") == 3) & (F.col("run") < 5), "0train").otherwise(key)
    return t.withColumn("key", key).drop("session")


RAW_SQL = """
WITH r AS (SELECT subject, run, trial_id, CASE WHEN subject=3 AND run<5 THEN '0train' WHEN run=5 THEN '2extra' WHEN session='T' THEN '0train' ELSE '1test' END AS key FROM d_trial)"""


@query(
    "session_translation",
    RAW_SQL + """, s AS (SELECT DISTINCT subject, CASE key WHEN '0train' THEN 'T' WHEN '1test' THEN 'E' END AS session, run FROM r)
SELECT subject, coalesce(session,'unknown') AS session, run, row_number() OVER (PARTITION BY subject, session ORDER BY run)-1 AS run_position FROM s""",
)
def session_translation(spark, d):
    """Translated session keys, runs in key order; runs under an unknown key are told as such."""
    named = R.normalise_sessions(_raw_keys(spark, d), "key", KEYS, unknown="keep")
    runs = named.select("subject", F.coalesce("session", F.lit("unknown")).alias("session"), "run").distinct()
    return series.dense_index(runs, ["subject", "session"], ["run"], F.lit(0), "run_position")


@query(
    "session_key_problems",
    RAW_SQL + """, k AS (SELECT subject, bool_or(key='0train') AS a, bool_or(key='1test') AS b, count(DISTINCT CASE WHEN key NOT IN ('0train','1test') THEN key END) AS n_unknown FROM r GROUP BY subject)
SELECT subject, concat_ws(',', CASE WHEN NOT a THEN '0train' END, CASE WHEN NOT b THEN '1test' END) AS missing, n_unknown FROM k WHERE NOT a OR NOT b OR n_unknown>0""",
)
def session_key_problems(spark, d):
    return R.session_key_problems(_raw_keys(spark, d), "key", KEYS)


@query(
    "union_of_runs",
    """WITH h AS (SELECT subject, channel, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'a' ELSE 'b' END AS half FROM d_sample),
m AS (SELECT subject, half, string_agg(DISTINCT channel, ',' ORDER BY channel) AS montage FROM h GROUP BY ALL)
SELECT h.subject, count(*) AS n_samples, (SELECT count(DISTINCT montage)=1 FROM m WHERE m.subject=h.subject) AS montage_agrees FROM h GROUP BY h.subject""",
)
def union_of_runs(spark, d):
    """Two halves of the recording put together, with the montage check."""
    s = tables.samples(spark, d).drop("sample_idx")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    both = s.where(F.col("ts") < cut).withColumn("half", F.lit("a")).unionByName(
        s.where(F.col("ts") >= cut).withColumn("half", F.lit("b"))
    )
    n = both.groupBy("subject").agg(F.count(F.lit(1)).alias("n_samples"))
    return n.join(R.montage_agrees(both, "half"), "subject")
