"""Posterior accuracy, mixing, smoothing, jitter, burst errors, quality levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.functions import vectors as V
from kymora.functions.vectors import rounded
from kymora.operators import posterior as P
from kymora.plans.registry import query
from kymora.plans.sql_views import u01
from kymora.sources import tables

LEVELS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
ABSOLUTE = (0.75, 0.80, 0.85, 0.90, 0.95, 1.0)


def spread(df, name="posterior", k=4):
    """Array entries as scalar columns."""
    return df.select(
        *[c for c in df.columns if c != name], *[rounded(F.col(name)[i]).alias(f"p{i}") for i in range(k)]
    )


def argmax_sql(*p):
    a, b, c, d = p
    return f"CASE WHEN {a}>={b} AND {a}>={c} AND {a}>={d} THEN 0 WHEN {b}>={c} AND {b}>={d} THEN 1 WHEN {c}>={d} THEN 2 ELSE 3 END"


def f32(e):
    return f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"


@query(
    "effective_accuracy",
    "SELECT subject, count(*) AS n, round(avg(CAST(pred=label AS INT)),6) AS accuracy FROM d_argmax GROUP BY subject",
)
def effective_accuracy(spark, d):
    return P.accuracy(tables.posteriors(spark, d), ["subject"]).withColumn("accuracy", rounded(F.col("accuracy")))


@query(
    "window_kappa",
    """
WITH m AS (SELECT subject, label, pred, count(*) AS n FROM d_argmax GROUP BY ALL),
t AS (SELECT subject, sum(n) AS n, sum(CASE WHEN label=pred THEN n ELSE 0 END) AS hit FROM m GROUP BY subject),
r AS (SELECT subject, label AS k, sum(n) AS r FROM m GROUP BY ALL), c AS (SELECT subject, pred AS k, sum(n) AS c FROM m GROUP BY ALL),
e AS (SELECT r.subject, sum(r*c) AS rc FROM r JOIN c USING (subject, k) GROUP BY r.subject)
SELECT subject, CAST(n AS BIGINT) AS n, round(hit/n,6) AS accuracy, round((hit/n - rc/(n*n))/(1 - rc/(n*n)),6) AS kappa FROM t JOIN e USING (subject)""",
)
def window_kappa(spark, d):
    p = tables.posteriors(spark, d).withColumn("pred", V.argmax_class(F.col("posterior")))
    out = P.agreement(p, ["subject"], "label", "pred")
    return out.select("subject", "n", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("kappa")).alias("kappa"))


@query(
    "trial_kappa",
    """
WITH s AS (SELECT subject, burst_id, label, sum(p0) AS s0, sum(p1) AS s1, sum(p2) AS s2, sum(p3) AS s3 FROM d_posterior GROUP BY ALL),
a AS (SELECT subject, label, CASE WHEN s0>=s1 AND s0>=s2 AND s0>=s3 THEN 0 WHEN s1>=s2 AND s1>=s3 THEN 1 WHEN s2>=s3 THEN 2 ELSE 3 END AS pred FROM s),
m AS (SELECT subject, label, pred, count(*) AS n FROM a GROUP BY ALL),
t AS (SELECT subject, sum(n) AS n, sum(CASE WHEN label=pred THEN n ELSE 0 END) AS hit FROM m GROUP BY subject),
r AS (SELECT subject, label AS k, sum(n) AS r FROM m GROUP BY ALL), c AS (SELECT subject, pred AS k, sum(n) AS c FROM m GROUP BY ALL),
e AS (SELECT r.subject, sum(r*c) AS rc FROM r JOIN c USING (subject, k) GROUP BY r.subject)
SELECT t.subject, CAST(n AS BIGINT) AS n, round(hit/n,6) AS accuracy,
       round((hit/n - coalesce(rc,0)/(n*n))/(1 - coalesce(rc,0)/(n*n)),6) AS kappa FROM t LEFT JOIN e USING (subject)""",
)
def trial_kappa(spark, d):
    """Agreement with one decision per trial: the class with the largest summed posterior."""
    p = tables.posteriors(spark, d)
    per = p.groupBy("subject", "burst_id", "label").agg(
        F.array(*[F.sum(F.col("posterior")[i].cast("double")) for i in range(4)]).alias("s")
    )
    out = P.agreement(per.withColumn("pred", V.argmax_class(F.col("s"))), ["subject"], "label", "pred")
    return out.select("subject", "n", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("kappa")).alias("kappa"))


MIX = [f32(f"0.4::DOUBLE*CAST(label={i} AS INT)+0.6::DOUBLE*p{i}") for i in range(4)]


@query(
    "oracle_mixing",
    f"""
WITH m AS (SELECT window_id, subject, label, {", ".join(f"{e} AS m{i}" for i, e in enumerate(MIX))} FROM d_posterior)
SELECT window_id, subject, label, {", ".join(f"round(m{i},6) AS p{i}" for i in range(4))},
       {argmax_sql("m0", "m1", "m2", "m3")}=label AS correct FROM m""",
)
def oracle_mixing(spark, d):
    """Every window blended with the truth at weight 0.4."""
    p = tables.posteriors(spark, d).withColumn("posterior", P.mixed(F.col("posterior"), F.col("label"), 0.4))
    return spread(p.select("window_id", "subject", "label", "posterior", P.correct().alias("correct")))


@query(
    "mixing_accuracy",
    f"""
WITH g AS (SELECT unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])::DOUBLE AS lam),
m AS (SELECT subject, lam, label, {", ".join(f32(f"lam*CAST(label={i} AS INT)+(1-lam)*p{i}") + f" AS m{i}" for i in range(4))} FROM d_posterior, g)
SELECT subject, lam, round(avg(CAST({argmax_sql("m0", "m1", "m2", "m3")}=label AS INT)),6) AS accuracy FROM m GROUP BY subject, lam""",
)
def mixing_accuracy(spark, d):
    """Achieved accuracy along a grid of mixing weights."""
    p = tables.posteriors(spark, d).withColumn("lam", F.explode(F.array(*[F.lit(i / 10) for i in range(11)])))
    p = p.withColumn("posterior", P.mixed(F.col("posterior"), F.col("label"), F.col("lam")))
    return P.accuracy(p, ["subject", "lam"]).select("subject", "lam", rounded(F.col("accuracy")).alias("accuracy"))


def bisect_sql(target):
    """Ten halvings per cell, written as the reference result: a search over k/1024."""
    mix = ", ".join(f32(f"(k/1024.0::DOUBLE)*CAST(label={i} AS INT)+(1-k/1024.0::DOUBLE)*p{i}") + f" AS m{i}" for i in range(4))
    return f"""
WITH g AS (SELECT unnest(range(0,1025)) AS k),
a AS (SELECT subject, k, avg(CAST({argmax_sql("m0", "m1", "m2", "m3")}=label AS INT)) AS acc
      FROM (SELECT subject, k, label, {mix} FROM d_posterior, g) GROUP BY subject, k),
b AS (SELECT subject, acc AS baseline FROM a WHERE k=0),
t AS (SELECT subject, level, baseline, {target} AS target FROM b, (SELECT unnest([LEVELS])::DOUBLE AS level)),
h AS (SELECT t.subject, level, baseline, target, min(CASE WHEN acc>=target THEN k END) AS k
      FROM t JOIN a USING (subject) GROUP BY ALL),
f AS (SELECT *, CASE WHEN target<=baseline THEN 0 ELSE coalesce(k,1024) END AS kk FROM h)
SELECT f.subject, level, round(baseline,6) AS baseline, round(target,6) AS target_accuracy, kk/1024.0::DOUBLE AS lam,
       round(acc,6) AS achieved_accuracy FROM f JOIN a ON a.subject=f.subject AND a.k=kk"""


def _levels_out(df):
    return df.select(
        "subject", "level", rounded(F.col("baseline")).alias("baseline"),
        rounded(F.col("target_accuracy")).alias("target_accuracy"), "lam",
        rounded(F.col("achieved_accuracy")).alias("achieved_accuracy"),
    )


@query("quality_levels", bisect_sql("baseline+level*(1-baseline)").replace("LEVELS", "0.0,0.2,0.4,0.6,0.8,1.0"))
def quality_levels(spark, d):
    return _levels_out(P.quality_levels(tables.posteriors(spark, d), ["subject"], LEVELS))


@query("quality_levels_absolute", bisect_sql("level").replace("LEVELS", "0.75,0.80,0.85,0.90,0.95,1.00"))
def quality_levels_absolute(spark, d):
    return _levels_out(P.quality_levels(tables.posteriors(spark, d), ["subject"], ABSOLUTE, "absolute"))


@query(
    "mixing_weight_for_accuracy",
    f"""
WITH g AS (SELECT unnest(range(0,1025)) AS k),
a AS (SELECT subject, k, avg(CAST({argmax_sql("m0", "m1", "m2", "m3")}=label AS INT)) AS acc
      FROM (SELECT subject, k, label, {", ".join(f32(f"(k/1024.0::DOUBLE)*CAST(label={i} AS INT)+(1-k/1024.0::DOUBLE)*p{i}") + f" AS m{i}" for i in range(4))} FROM d_posterior, g) GROUP BY subject, k)
SELECT subject, min(k)/1024.0::DOUBLE AS lam FROM a WHERE acc>=0.8 GROUP BY subject""",
)
def mixing_weight_for_accuracy(spark, d):
    """Smallest mixing weight that reaches 80 % accuracy, per subject."""
    return P.quality_levels(tables.posteriors(spark, d), ["subject"], [0.8], "absolute").select("subject", "lam")


@query(
    "mixed_at_levels_accuracy",
    bisect_sql("baseline+level*(1-baseline)")
    .replace("LEVELS", "0.0,0.2,0.4,0.6,0.8,1.0")
    .replace(
        'SELECT f.subject, level, round(baseline,6) AS baseline, round(target,6) AS target_accuracy, kk/1024.0::DOUBLE AS lam,\n       round(acc,6) AS achieved_accuracy FROM',
        "SELECT f.subject, level, round(acc,6) AS accuracy FROM",
    ),
)
def mixed_at_levels_accuracy(spark, d):
    """Weights joined back to the windows, mixed, and measured again."""
    p = tables.posteriors(spark, d)
    levels = P.quality_levels(p, ["subject"], LEVELS)
    out = P.accuracy(P.mix_to_levels(p, ["subject"], levels), ["subject", "level"])
    return out.select("subject", "level", rounded(F.col("accuracy")).alias("accuracy"))


SMOOTH = [f32(f"0.7::DOUBLE*p{i}+0.3::DOUBLE/4") for i in range(4)]


@query(
    "label_smoothing",
    f"""
WITH m AS (SELECT window_id, label, {", ".join(f"{e} AS m{i}" for i, e in enumerate(SMOOTH))} FROM d_posterior)
SELECT window_id, label, {", ".join(f"round(m{i},6) AS p{i}" for i in range(4))}, {argmax_sql("m0", "m1", "m2", "m3")}=label AS correct FROM m""",
)
def label_smoothing(spark, d):
    p = tables.posteriors(spark, d).withColumn("posterior", P.smoothed(F.col("posterior"), 0.3))
    return spread(p.select("window_id", "label", "posterior", P.correct().alias("correct")))


def jitter_sql(shift):
    return f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY t_rel)-1 AS pos, count(*) OVER (PARTITION BY burst_id)-1 AS last FROM d_posterior)
SELECT a.window_id, a.burst_id, {", ".join(f"round(b.p{i},6) AS p{i}" for i in range(4))}
FROM n a JOIN n b ON a.burst_id=b.burst_id AND b.pos=least(greatest(a.pos-({shift}),0),a.last)"""


@query("temporal_jitter", jitter_sql(2))
def temporal_jitter(spark, d):
    return spread(P.jittered(tables.posteriors(spark, d), 2).select("window_id", "burst_id", "posterior"))


@query("temporal_jitter_early", jitter_sql(-3))
def temporal_jitter_early(spark, d):
    return spread(P.jittered(tables.posteriors(spark, d), -3).select("window_id", "burst_id", "posterior"))


BURST_CTE = f"""
WITH RECURSIVE n AS (
  SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY t_rel) AS pos,
    {u01("1337", "'start'", "window_id")} < 0.2 AS starts,
    greatest(1, ceil(ln(1-{u01("1337", "'length'", "window_id")})/ln(1-1/3.0::DOUBLE))) AS len,
    CAST(floor({u01("1337", "'class'", "window_id")}*3) AS INT) AS w FROM d_posterior),
f AS (
  SELECT burst_id, pos, CASE WHEN starts THEN len-1 ELSE 0 END AS rest, CASE WHEN starts THEN w + CAST(w>=label AS INT) ELSE -1 END AS held FROM n WHERE pos=1
  UNION ALL
  SELECT n.burst_id, n.pos, CASE WHEN f.rest>0 THEN f.rest-1 WHEN n.starts THEN n.len-1 ELSE 0 END,
         CASE WHEN f.rest>0 THEN f.held WHEN n.starts THEN n.w + CAST(n.w>=n.label AS INT) ELSE -1 END
  FROM f JOIN n ON n.burst_id=f.burst_id AND n.pos=f.pos+1),
r AS (SELECT n.window_id, n.subject, n.label, f.held, n.p0, n.p1, n.p2, n.p3, greatest(n.p0,n.p1,n.p2,n.p3) AS top FROM n JOIN f USING (burst_id, pos)),
q AS (SELECT window_id, subject, label, held, {", ".join(f32(f"CASE WHEN held<0 THEN p{i} WHEN held={i} THEN top ELSE (1-top)/3 END") + f" AS m{i}" for i in range(4))} FROM r)"""


@query(
    "burst_error",
    BURST_CTE + f"""
SELECT window_id, held AS held_class, {", ".join(f"round(m{i},6) AS p{i}" for i in range(4))}, {argmax_sql("m0", "m1", "m2", "m3")}=label AS correct FROM q""",
)
def burst_error(spark, d):
    """Stretches of one confident wrong class; draws are hashed from the window id."""
    out = P.burst_errors(tables.posteriors(spark, d), 1337, 0.2, 3.0)
    return spread(out.select("window_id", "held_class", "posterior", P.correct().alias("correct")))


@query(
    "error_structure_accuracy",
    BURST_CTE + f""",
j AS (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY t_rel)-1 AS jp FROM d_posterior),
u AS (
 SELECT 'none' AS error_struct, subject, CAST(pred=label AS INT) AS ok FROM d_argmax
 UNION ALL SELECT 'smoothing', subject, CAST({argmax_sql(*SMOOTH)}=label AS INT) FROM d_posterior
 UNION ALL SELECT 'jitter', a.subject, CAST({argmax_sql("b.p0", "b.p1", "b.p2", "b.p3")}=a.label AS INT)
   FROM j a JOIN j b ON a.burst_id=b.burst_id AND b.jp=greatest(a.jp-2,0)
 UNION ALL SELECT 'burst', subject, CAST({argmax_sql("m0", "m1", "m2", "m3")}=label AS INT) FROM q)
SELECT error_struct, subject, count(*) AS n, round(avg(ok),6) AS accuracy FROM u GROUP BY ALL""",
)
def error_structure_accuracy(spark, d):
    """Achieved accuracy under each named error structure."""
    p = tables.posteriors(spark, d)
    parts = [P.with_error_structure(p, kind) for kind in P.ERROR_KINDS]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return P.accuracy(every, ["error_struct", "subject"]).withColumn("accuracy", rounded(F.col("accuracy")))


@query(
    "argmax_onehot_rowsum",
    "SELECT window_id, pred, CAST(pred=label AS INT) AS onehot_at_label, round(p0+p1+p2+p3,6) AS row_sum FROM d_argmax",
)
def argmax_onehot_rowsum(spark, d):
    p = tables.posteriors(spark, d)
    pred = V.argmax_class(F.col("posterior"))
    hot = F.element_at(V.one_hot(pred, 4), F.col("label") + 1).cast("int")
    return p.select("window_id", pred.alias("pred"), hot.alias("onehot_at_label"),
                    rounded(V.row_sum(F.col("posterior"))).alias("row_sum"))


@query(
    "softmax_scores",
    """
WITH e AS (SELECT vec_id, CAST(unnest(range(0,64)) AS INT) AS entry, exp(unnest(embedding)*3.0::DOUBLE) AS x FROM embeddings)
SELECT vec_id, entry, round(x/sum(x) OVER (PARTITION BY vec_id),6) AS p FROM e""",
)
def softmax_scores(spark, d):
    """Softmax over all entries of every vector."""
    s = F.transform("embedding", lambda v: v.cast("double") * 3.0)
    e = tables.read(spark, d, "embeddings").select("vec_id", F.posexplode(V.softmax(s)).alias("entry", "p"))
    return e.select("vec_id", "entry", rounded(F.col("p")).alias("p"))
