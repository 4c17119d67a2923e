"""As-of joins, replayed control steps, commands and trace metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kymora.functions import responses as X
from kymora.functions import vectors as V
from kymora.functions.vectors import rounded
from kymora.operators import asof, series
from kymora.operators import commands as C
from kymora.operators import trace as TR
from kymora.plans.queries_posterior import argmax_sql, f32
from kymora.plans.registry import query
from kymora.sources import tables

DT = 0.1
TARGETS = V.ring(8)


def r(*names):
    return [rounded(F.col(n)).alias(n) for n in names]


# --- as-of ---

STEPS_CTE = """
WITH b AS (SELECT DISTINCT subject, burst_id FROM d_posterior),
s AS (SELECT subject, burst_id, i AS step, i*0.125::DOUBLE AS now FROM b, (SELECT CAST(unnest(range(0,44)) AS INT) AS i)),
l AS (SELECT s.subject, s.burst_id, s.step, s.now, CASE WHEN now<3.5 THEN p.window_id END AS window_id, CASE WHEN now<3.5 THEN p.label END AS label,
             CASE WHEN now<3.5 THEN p0 END AS p0, CASE WHEN now<3.5 THEN p1 END AS p1, CASE WHEN now<3.5 THEN p2 END AS p2, CASE WHEN now<3.5 THEN p3 END AS p3
      FROM s ASOF LEFT JOIN (SELECT *, t_rel+0.25::DOUBLE AS avail FROM d_posterior) p ON s.subject=p.subject AND s.burst_id=p.burst_id AND s.now>=p.avail),
u AS (SELECT *, window_id IS NOT NULL AND coalesce(lag(window_id) OVER (PARTITION BY subject, burst_id ORDER BY step), -1)<>window_id AS decoder_update FROM l)"""


@query("latest_after_latency", STEPS_CTE + " SELECT subject, burst_id, step, now, window_id FROM l")
def latest_after_latency(spark, d):
    """Newest window usable at every control step, 250 ms after it was produced."""
    return asof.replay(tables.posteriors(spark, d)).select("subject", "burst_id", "step", "now", "window_id")


@query(
    "arrived_by",
    "SELECT subject, burst_id, count(*) FILTER (WHERE t_rel+0.5::DOUBLE<=3.25) AS n_arrived, count(*) AS n FROM d_posterior GROUP BY ALL",
)
def arrived_by(spark, d):
    hit = asof.available(F.col("t_rel"), 0.5, F.lit(3.25))
    return tables.posteriors(spark, d).groupBy("subject", "burst_id").agg(
        F.count(F.when(hit, 1)).alias("n_arrived"), F.count(F.lit(1)).alias("n")
    )


@query("decoder_updates", STEPS_CTE + " SELECT subject, burst_id, step, window_id, decoder_update FROM u WHERE decoder_update")
def decoder_updates(spark, d):
    return asof.replay(tables.posteriors(spark, d)).where("decoder_update").select(
        "subject", "burst_id", "step", "window_id", "decoder_update"
    )


@query(
    "replayed_command_accuracy",
    STEPS_CTE + f""", c AS (SELECT subject, burst_id, decoder_update, label, {argmax_sql("p0", "p1", "p2", "p3")} AS k FROM u)
SELECT subject, round(avg(CASE WHEN decoder_update THEN CAST(k=label AS INT) END),6) AS command_accuracy, count(*) FILTER (WHERE decoder_update) AS commands_issued FROM c GROUP BY subject""",
)
def replayed_command_accuracy(spark, d):
    """Argmax commands on the replayed steps, scored once per decoder update."""
    steps = C.apply_mapping("s1_argmax", asof.replay(tables.posteriors(spark, d)))
    acc, n = TR.command_accuracy(F.col("label"), "ux", "uy")
    return steps.groupBy("subject").agg(rounded(acc).alias("command_accuracy"), n.alias("commands_issued"))


# --- evidence ---

EVIDENCE_CTE = """
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY burst_id, t_rel) AS pos FROM d_posterior),
f AS (
  SELECT n.subject, n.pos, ln(p0+1e-6::DOUBLE) AS a0, ln(p1+1e-6::DOUBLE) AS a1, ln(p2+1e-6::DOUBLE) AS a2, ln(p3+1e-6::DOUBLE) AS a3,
         greatest(ln(p0+1e-6::DOUBLE), ln(p1+1e-6::DOUBLE), ln(p2+1e-6::DOUBLE), ln(p3+1e-6::DOUBLE)) > -1.0 AS fired FROM n WHERE pos=1
  UNION ALL
  SELECT subject, pos, a0, a1, a2, a3, greatest(a0,a1,a2,a3) > -1.0 FROM (
    SELECT n.subject, n.pos, CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a0 END + ln(p0+1e-6::DOUBLE) AS a0, CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a1 END + ln(p1+1e-6::DOUBLE) AS a1,
           CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a2 END + ln(p2+1e-6::DOUBLE) AS a2, CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a3 END + ln(p3+1e-6::DOUBLE) AS a3
    FROM f JOIN n ON n.subject=f.subject AND n.pos=f.pos+1) z),
e AS (SELECT n.window_id, n.subject, n.burst_id, n.t_rel, n.label, greatest(a0,a1,a2,a3) AS top,
        CASE WHEN NOT fired THEN -1 WHEN a0>=a1 AND a0>=a2 AND a0>=a3 THEN 0 WHEN a1>=a2 AND a1>=a3 THEN 1 WHEN a2>=a3 THEN 2 ELSE 3 END AS emitted
      FROM f JOIN n USING (subject, pos))"""


def _evidence(spark, d, chunk_rows=series.CHUNK_ROWS):
    p = tables.posteriors(spark, d)
    return C.accumulate_evidence(
        p, ["subject"], ["burst_id", "t_rel"], F.floor(F.col("burst_id") / 4096), chunk_rows=chunk_rows
    )


@query("evidence_accumulation", EVIDENCE_CTE + " SELECT window_id, subject, round(top,6) AS evidence_max, emitted FROM e")
def evidence_accumulation(spark, d):
    return _evidence(spark, d).select("window_id", "subject", *r("evidence_max"), "emitted")


@query("evidence_accumulation_chunked", EVIDENCE_CTE + " SELECT window_id, subject, round(top,6) AS evidence_max, emitted FROM e")
def evidence_accumulation_chunked(spark, d):
    """The same fold with every series cut into many chunks, as a hot series would be."""
    return _evidence(spark, d, chunk_rows=20).select("window_id", "subject", *r("evidence_max"), "emitted")


HELD_CTE = EVIDENCE_CTE + """,
b AS (SELECT DISTINCT subject, burst_id FROM d_posterior),
s AS (SELECT subject, burst_id, i AS step, burst_id*8.0::DOUBLE+i*0.125::DOUBLE AS clock FROM b, (SELECT CAST(unnest(range(0,44)) AS INT) AS i)),
h AS (SELECT s.subject, s.burst_id, s.step, CASE WHEN s.clock-q.clock<0.5 THEN q.emitted ELSE -1 END AS held_class
      FROM s ASOF LEFT JOIN (SELECT subject, burst_id*8.0::DOUBLE+t_rel AS clock, emitted FROM e WHERE emitted>=0) q ON s.subject=q.subject AND s.clock>=q.clock)"""


def _held(spark, d):
    emitted = _evidence(spark, d).withColumn("clock", F.col("burst_id") * 8.0 + F.col("t_rel"))
    steps = asof.burst_steps(
        tables.posteriors(spark, d).select("subject", "burst_id").distinct(), ["subject", "burst_id"], 0.125, 3.5, 2.0
    ).withColumn("clock", F.col("burst_id") * 8.0 + F.col("now"))
    return C.held_emission(emitted, steps, ["subject"], "clock", "clock", 0.5, ["burst_id", "step"])


@query("emission_hold", HELD_CTE + " SELECT subject, burst_id, step, coalesce(held_class,-1) AS held_class FROM h")
def emission_hold(spark, d):
    """Which class is still being commanded at every control step."""
    return _held(spark, d).select("subject", "burst_id", "step", "held_class")


@query(
    "evidence_command",
    HELD_CTE + """ SELECT subject, burst_id, step, CASE held_class WHEN 0 THEN -0.15 WHEN 1 THEN 0.15 ELSE 0 END::DOUBLE AS ux,
CASE held_class WHEN 2 THEN -0.15 WHEN 3 THEN 0.15 ELSE 0 END::DOUBLE AS uy FROM h""",
)
def evidence_command(spark, d):
    ux, uy = C.class_command(F.col("held_class"))
    return _held(spark, d).select("subject", "burst_id", "step", rounded(ux).alias("ux"), rounded(uy).alias("uy"))


# --- stateless commands on windows ---


@query(
    "argmax_command",
    "SELECT window_id, CASE pred WHEN 0 THEN -0.15 WHEN 1 THEN 0.15 ELSE 0 END::DOUBLE AS ux, CASE pred WHEN 2 THEN -0.15 WHEN 3 THEN 0.15 ELSE 0 END::DOUBLE AS uy FROM d_argmax",
)
def argmax_command(spark, d):
    out = C.apply_mapping("s1_argmax", tables.posteriors(spark, d))
    return out.select("window_id", *r("ux", "uy"))


@query("weighted_command", "SELECT window_id, round(0.15*(p1-p0),6) AS ux, round(0.15*(p3-p2),6) AS uy FROM d_posterior")
def weighted_command(spark, d):
    return C.apply_mapping("s2_weighted", tables.posteriors(spark, d)).select("window_id", *r("ux", "uy"))


ENTROPY = "(-(" + "+".join(f"CASE WHEN p{i}>1e-12 THEN p{i}*ln(p{i}) ELSE 0 END" for i in range(4)) + ")/ln(4.0::DOUBLE))"


@query(
    "weighted_entropy_command",
    f"SELECT window_id, round({ENTROPY},6) AS entropy, round(0.15*(p1-p0)*(1-{ENTROPY}),6)+0.0 AS ux, round(0.15*(p3-p2)*(1-{ENTROPY}),6)+0.0 AS uy FROM d_posterior",
)
def weighted_entropy_command(spark, d):
    out = C.apply_mapping("s2_weighted_entropy", tables.posteriors(spark, d))
    return out.select("window_id", rounded(V.normalised_entropy(F.col("posterior"))).alias("entropy"), *r("ux", "uy"))


@query(
    "arbitration_weight",
    f"SELECT window_id, 0.5::DOUBLE AS alpha_fixed, round(0.9::DOUBLE*{ENTROPY},6) AS alpha_adaptive FROM d_posterior",
)
def arbitration_weight(spark, d):
    p = F.col("posterior")
    return tables.posteriors(spark, d).select(
        "window_id", C.effective_alpha(p, 0.5, "fixed", 0.0, 0.9).alias("alpha_fixed"),
        rounded(C.effective_alpha(p, 0.5, "adaptive", 0.0, 0.9)).alias("alpha_adaptive"),
    )


@query(
    "decoded_direction",
    "SELECT window_id, round((p1-p0)/sqrt((p1-p0)*(p1-p0)+(p3-p2)*(p3-p2)),6) AS dx, round((p3-p2)/sqrt((p1-p0)*(p1-p0)+(p3-p2)*(p3-p2)),6) AS dy FROM d_posterior",
)
def decoded_direction(spark, d):
    dx, dy = C.decoded_direction(F.col("posterior"))
    return tables.posteriors(spark, d).select("window_id", rounded(dx).alias("dx"), rounded(dy).alias("dy"))


@query(
    "missing_posterior_command",
    STEPS_CTE + """ SELECT subject, burst_id, count(*) FILTER (WHERE window_id IS NULL) AS n_missing, count(*) FILTER (WHERE window_id IS NOT NULL) AS n_commanded,
round(sum(coalesce(0.15*(p1-p0),0)),6) AS sum_ux, round(sum(coalesce(0.15*(p3-p2),0)),6) AS sum_uy FROM l GROUP BY ALL""",
)
def missing_posterior_command(spark, d):
    """A missing posterior gives a zero command and is kept apart from a command that is zero."""
    s = C.apply_mapping("s2_weighted", asof.replay(tables.posteriors(spark, d)))
    return s.groupBy("subject", "burst_id").agg(
        F.count(F.when(~F.col("has_command"), 1)).alias("n_missing"),
        F.count(F.when(F.col("has_command"), 1)).alias("n_commanded"),
        rounded(F.sum("ux")).alias("sum_ux"), rounded(F.sum("uy")).alias("sum_uy"),
    )


# --- shared control on steps that carry a position ---

POS_CTE = """
WITH t AS (SELECT *, sum(vx*0.1::DOUBLE) OVER w AS x, sum(vy*0.1::DOUBLE) OVER w AS y FROM d_trace WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
b AS (SELECT *, x-vx*0.1::DOUBLE AS x_before, y-vy*0.1::DOUBLE AS y_before, cos(target_idx*pi()/4) AS tx, sin(target_idx*pi()/4) AS ty FROM t)"""
_z = "(exp(-2*ix)+exp(2*ix)+exp(-2*iy)+exp(2*iy))"
SHARED_CTE = POS_CTE + f""",
q AS (SELECT *, {f32(f"exp(-2*ix)/{_z}")} AS p0, {f32(f"exp(2*ix)/{_z}")} AS p1, {f32(f"exp(-2*iy)/{_z}")} AS p2, {f32(f"exp(2*iy)/{_z}")} AS p3 FROM b),
o AS (SELECT *, 0.15::DOUBLE*(p1-p0) AS wx, 0.15::DOUBLE*(p3-p2) AS wy, sqrt((p1-p0)*(p1-p0)+(p3-p2)*(p3-p2)) AS nb FROM q),
al AS (SELECT o.episode_id, o.step, i, ((cos(i*pi()/4)-x)*(p1-p0)+(sin(i*pi()/4)-y)*(p3-p2))/(sqrt(pow(cos(i*pi()/4)-x,2)+pow(sin(i*pi()/4)-y,2))*nb) AS a
       FROM o, (SELECT CAST(unnest(range(0,8)) AS INT) AS i) WHERE nb>1e-6 AND sqrt(pow(cos(i*pi()/4)-x,2)+pow(sin(i*pi()/4)-y,2))>1e-6),
am AS (SELECT episode_id, step, arg_max(i, (round(a,12), -i)) AS aim, max(a) AS best FROM al GROUP BY ALL),
g AS (SELECT o.*, CASE WHEN best>=0.5000000000000001::DOUBLE THEN aim END AS aim FROM o LEFT JOIN am USING (episode_id, step)),
ob AS (SELECT 0.3512::DOUBLE AS ox, 0.5303::DOUBLE AS oy UNION ALL SELECT -0.3512, -0.5303 UNION ALL SELECT 0.5303, -0.3512),
rp AS (SELECT episode_id, step, sum((x-ox)/d*0.02::DOUBLE*(1/d-1/0.35::DOUBLE)) AS rx, sum((y-oy)/d*0.02::DOUBLE*(1/d-1/0.35::DOUBLE)) AS ry
       FROM (SELECT episode_id, step, x, y, ox, oy, greatest(sqrt((x-ox)*(x-ox)+(y-oy)*(y-oy)),1e-6) AS d FROM o, ob) k WHERE d<0.35 GROUP BY ALL),
h AS (SELECT g.*, coalesce(rx,0) AS rx, coalesce(ry,0) AS ry FROM g LEFT JOIN rp USING (episode_id, step))"""


def auto_sql(aim, name):
    """Autonomy toward a target index, then the blends with the user command."""
    tx, ty = f"cos({aim}*pi()/4)", f"sin({aim}*pi()/4)"
    n = f"sqrt(pow({tx}-x,2)+pow({ty}-y,2))"
    return f"""
{name}0 AS (SELECT *, CASE WHEN {aim} IS NOT NULL AND {n}>1e-6 THEN ({tx}-x)/{n}*0.15 ELSE 0 END + rx AS fx,
                      CASE WHEN {aim} IS NOT NULL AND {n}>1e-6 THEN ({ty}-y)/{n}*0.15 ELSE 0 END + ry AS fy FROM h),
{name} AS (SELECT *, CASE WHEN sqrt(fx*fx+fy*fy)>0.15 THEN fx*0.15/sqrt(fx*fx+fy*fy) ELSE fx END AS ax, CASE WHEN sqrt(fx*fx+fy*fy)>0.15 THEN fy*0.15/sqrt(fx*fx+fy*fy) ELSE fy END AS ay FROM {name}0)"""


def clip_sql(x, y):
    n = f"sqrt(({x})*({x})+({y})*({y}))"
    return f"CASE WHEN {n}>0.15 THEN ({x})*0.15/{n} ELSE {x} END", f"CASE WHEN {n}>0.15 THEN ({y})*0.15/{n} ELSE {y} END"


def _placed(spark, d):
    """Trace steps with a position and a posterior that leans toward the intent."""
    t = TR.with_position(tables.trace(spark, d), DT)
    scores = F.array(-2 * F.col("ix"), 2 * F.col("ix"), -2 * F.col("iy"), 2 * F.col("iy"))
    e = F.transform(scores, lambda v: F.exp(v))
    t = t.withColumn("_e", e)
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    return t.withColumn("posterior", V.as_float(F.transform("_e", lambda v: v / total))).drop("_e")


@query("attractive_target", SHARED_CTE + " SELECT episode_id, step, aim FROM g")
def attractive_target(spark, d):
    """Target best aligned with the decoded intent within 60 degrees, null otherwise."""
    aim = C.attractive_target(F.col("x"), F.col("y"), F.col("posterior"), TARGETS, 60.0)
    return _placed(spark, d).select("episode_id", "step", aim.alias("aim"))


@query("repulsion", SHARED_CTE + " SELECT episode_id, step, round(rx,6)+0.0 AS rx, round(ry,6)+0.0 AS ry FROM h")
def repulsion(spark, d):
    rx, ry = C.repulsion(F.col("x"), F.col("y"), C.OBSTACLES, 0.02, 0.35)
    return TR.with_position(tables.trace(spark, d), DT).select(
        "episode_id", "step", rounded(rx).alias("rx"), rounded(ry).alias("ry")
    )


@query("autonomy_command", SHARED_CTE + "," + auto_sql("aim", "u") + " SELECT episode_id, step, round(ax,6)+0.0 AS ux, round(ay,6)+0.0 AS uy FROM u")
def autonomy_command(spark, d):
    """Shared control at full autonomy: the potential field alone."""
    out = C.apply_mapping("s4_shared", _placed(spark, d), targets=TARGETS, alpha=1.0)
    return out.select("episode_id", "step", *r("ux", "uy"))


_b = clip_sql("0.5*ax+0.5*wx", "0.5*ay+0.5*wy")


@query(
    "shared_command",
    SHARED_CTE + "," + auto_sql("aim", "u") + f" SELECT episode_id, step, round({_b[0]},6)+0.0 AS ux, round({_b[1]},6)+0.0 AS uy FROM u",
)
def shared_command(spark, d):
    out = C.apply_mapping("s4_shared", _placed(spark, d), targets=TARGETS, alpha=0.5)
    return out.select("episode_id", "step", *r("ux", "uy"))


@query(
    "shared_command_blind",
    SHARED_CTE + "," + auto_sql("target_idx", "u") + f" SELECT episode_id, step, target_idx AS aim, round({_b[0]},6)+0.0 AS ux, round({_b[1]},6)+0.0 AS uy FROM u",
)
def shared_command_blind(spark, d):
    """The same blend aimed at the active target instead of the decoded one."""
    out = C.apply_mapping("s4_shared", _placed(spark, d), targets=TARGETS, alpha=0.5, intent_mode="blind")
    return out.select("episode_id", "step", "aim", *r("ux", "uy"))


@query(
    "zero_autonomy_is_weighted",
    "SELECT count(*) AS n, 0.0::DOUBLE AS max_abs_diff, true AS passed FROM d_trace",
)
def zero_autonomy_is_weighted(spark, d):
    """Shared control at weight zero against the weighted mapping, command by command."""
    steps = _placed(spark, d)
    wx, wy = C.weighted_command(F.col("posterior"))
    both = C.apply_mapping("s4_shared", steps, targets=TARGETS, alpha=0.0).withColumn("_wx", wx).withColumn("_wy", wy)
    diff = F.max(F.greatest(F.abs(F.col("ux") - F.col("_wx")), F.abs(F.col("uy") - F.col("_wy"))))
    return both.agg(F.count(F.lit(1)).alias("n"), diff.alias("max_abs_diff")).withColumn("passed", F.col("max_abs_diff") == 0)


@query(
    "clip_speed",
    "SELECT event_id, round(CASE WHEN sqrt(vx*vx+vy*vy)>0.15 THEN vx*0.15/sqrt(vx*vx+vy*vy) ELSE vx END,6)+0.0 AS cx, round(CASE WHEN sqrt(vx*vx+vy*vy)>0.15 THEN vy*0.15/sqrt(vx*vx+vy*vy) ELSE vy END,6)+0.0 AS cy FROM d_trace",
)
def clip_speed(spark, d):
    cx, cy = V.clip_to(F.col("vx"), F.col("vy"), 0.15)
    return tables.trace(spark, d).select("event_id", rounded(cx).alias("cx"), rounded(cy).alias("cy"))


@query(
    "unit_directions",
    "SELECT event_id, CASE WHEN sqrt(vx*vx+vy*vy)>1e-9 THEN round(vx/sqrt(vx*vx+vy*vy),6)+0.0 ELSE 0.0 END AS ux, CASE WHEN sqrt(vx*vx+vy*vy)>1e-9 THEN round(vy/sqrt(vx*vx+vy*vy),6)+0.0 ELSE 0.0 END AS uy, sqrt(vx*vx+vy*vy)>1e-9 AS usable FROM d_trace",
)
def unit_directions(spark, d):
    ux, uy = V.unit(F.col("vx"), F.col("vy"))
    return tables.trace(spark, d).select(
        "event_id", rounded(ux).alias("ux"), rounded(uy).alias("uy"), V.has_direction(F.col("vx"), F.col("vy")).alias("usable")
    )


@query(
    "nearest_class_direction",
    f"SELECT event_id, {argmax_sql('-vx', 'vx', '-vy', 'vy')} AS commanded_class FROM d_trace",
)
def nearest_class_direction(spark, d):
    """Class direction nearest to the command that was sent."""
    k = V.best_aligned(F.col("vx"), F.col("vy"), TR.DIRECTIONS)
    return tables.trace(spark, d).select("event_id", k.alias("commanded_class"))


@query(
    "intended_class",
    POS_CTE + f" SELECT episode_id, step, {argmax_sql('-(tx-x)', 'tx-x', '-(ty-y)', 'ty-y')} AS intended FROM b",
)
def intended_class(spark, d):
    """Class that points most nearly from the position to the active target."""
    t = TR.with_position(tables.trace(spark, d), DT)
    tx, ty = V.ring_position(F.col("target_idx"), 8)
    k = V.best_aligned(tx - F.col("x"), ty - F.col("y"), TR.DIRECTIONS)
    return t.select("episode_id", "step", k.alias("intended"))


@query(
    "target_direction",
    POS_CTE + " SELECT episode_id, step, round((tx-x)/sqrt(pow(tx-x,2)+pow(ty-y,2)),6)+0.0 AS dx, round((ty-y)/sqrt(pow(tx-x,2)+pow(ty-y,2)),6)+0.0 AS dy FROM b",
)
def target_direction(spark, d):
    t = TR.with_position(tables.trace(spark, d), DT)
    tx, ty = V.ring_position(F.col("target_idx"), 8)
    dx, dy = V.unit(tx - F.col("x"), ty - F.col("y"), 0.0)
    return t.select("episode_id", "step", rounded(dx).alias("dx"), rounded(dy).alias("dy"))


@query(
    "target_ring",
    "SELECT target_idx, round(cos(target_idx*pi()/4),6)+0.0 AS tx, round(sin(target_idx*pi()/4),6)+0.0 AS ty, count(*) AS n_attempts FROM d_outcome GROUP BY target_idx",
)
def target_ring(spark, d):
    """Ring position of every target that was attempted."""
    tx, ty = V.ring_position(F.col("target_idx"), 8)
    n = tables.outcomes(spark, d).groupBy("target_idx").agg(F.count(F.lit(1)).alias("n_attempts"))
    return n.select("target_idx", rounded(tx).alias("tx"), rounded(ty).alias("ty"), "n_attempts")


# --- trace metrics ---

REVERSAL_CTE = f"""
WITH m AS (SELECT episode_id, target_idx, step, vx/sqrt(vx*vx+vy*vy) AS ux, vy/sqrt(vx*vx+vy*vy) AS uy FROM d_trace WHERE sqrt(vx*vx+vy*vy)>1e-9),
g AS (SELECT *, lag(ux) OVER w AS lx, lag(uy) OVER w AS ly FROM m WINDOW w AS (PARTITION BY episode_id, target_idx ORDER BY step)),
c AS (SELECT episode_id, target_idx, count(*) FILTER (WHERE lx*ux+ly*uy < {math.cos(math.radians(90.0)) - TR.TURN_TOL!r}::DOUBLE) AS n_reversals FROM g GROUP BY ALL)"""


@query("direction_reversals", REVERSAL_CTE + " SELECT episode_id, target_idx, n_reversals FROM c")
def direction_reversals(spark, d):
    return TR.reversals(tables.trace(spark, d))


@query("mean_direction_reversals", REVERSAL_CTE + " SELECT episode_id, round(avg(n_reversals),6) AS direction_reversals FROM c GROUP BY episode_id")
def mean_direction_reversals(spark, d):
    return TR.mean_reversals(tables.trace(spark, d)).select("episode_id", *r("direction_reversals"))


@query(
    "continuous_dwell",
    POS_CTE + """, i AS (SELECT *, sqrt(pow(tx-x,2)+pow(ty-y,2))<=0.9 AS inside, coalesce(lag(target_idx) OVER (PARTITION BY episode_id ORDER BY step)<>target_idx,false) AS changed FROM b),
k AS (SELECT *, max(CASE WHEN NOT inside THEN step WHEN changed THEN step-1 END) OVER (PARTITION BY episode_id ORDER BY step) AS cut FROM i),
h AS (SELECT *, CASE WHEN inside THEN step-coalesce(cut,0) ELSE 0 END AS held FROM k)
SELECT episode_id, target_idx, max(held) AS longest_hold, min(CASE WHEN held>=2 THEN step END) AS acquired_step, min(CASE WHEN held>=2 THEN step END) IS NOT NULL AS acquired FROM h GROUP BY ALL""",
)
def continuous_dwell(spark, d):
    """First step at which the active target was held for 0.2 s without a break."""
    t = TR.with_position(tables.trace(spark, d), DT)
    tx, ty = V.ring_position(F.col("target_idx"), 8)
    return TR.first_dwell(t, V.hypot(tx - F.col("x"), ty - F.col("y")) <= 0.9, DT, 0.2)


@query(
    "obstacle_entries",
    POS_CTE + """, i AS (SELECT *, least(sqrt(pow(x-0.3512,2)+pow(y-0.5303,2)), sqrt(pow(x+0.3512,2)+pow(y+0.5303,2)), sqrt(pow(x-0.5303,2)+pow(y+0.3512,2)))<0.12 AS inside FROM b),
k AS (SELECT *, lag(inside) OVER (PARTITION BY episode_id ORDER BY step) AS was FROM i)
SELECT episode_id, count(*) FILTER (WHERE inside AND NOT coalesce(was,false)) AS n_entries FROM k GROUP BY episode_id""",
)
def obstacle_entries(spark, d):
    t = TR.with_position(tables.trace(spark, d), DT)
    near = F.least(*[V.hypot(F.col("x") - ox, F.col("y") - oy) for ox, oy in C.OBSTACLES])
    return TR.entries(t, near < 0.12, ["episode_id"])


@query(
    "attempt_paths",
    POS_CTE + """ SELECT episode_id, target_idx, round(sum(sqrt(pow(x-x_before,2)+pow(y-y_before,2))),6) AS path_length,
round(greatest(sqrt(pow(cos(target_idx*pi()/4)-arg_min(x_before,step),2)+pow(sin(target_idx*pi()/4)-arg_min(y_before,step),2))-0.15,0),6) AS straight_line FROM b GROUP BY episode_id, target_idx""",
)
def attempt_paths(spark, d):
    t = TR.with_position(tables.trace(spark, d), DT)
    return TR.attempt_paths(t, 0.15, 8, 1.0).select("episode_id", "target_idx", *r("path_length", "straight_line"))


@query(
    "bursts_without_command",
    """WITH b AS (SELECT episode_id, (step-1)//3 AS burst, bool_or(has_command AND sqrt(vx*vx+vy*vy)>0) AS issued FROM d_trace GROUP BY ALL)
SELECT episode_id, count(*) AS n_bursts, count(*) FILTER (WHERE NOT issued) AS bursts_without_command FROM b GROUP BY episode_id""",
)
def bursts_without_command(spark, d):
    return TR.bursts_without_command(tables.trace(spark, d), F.floor((F.col("step") - 1) / 3))


UCI_SQL = """round(avg(CASE WHEN decoder_update AND has_command AND sqrt(ix*ix+iy*iy)>1e-9 AND sqrt(vx*vx+vy*vy)>1e-9 THEN (ix*vx+iy*vy)/(sqrt(ix*ix+iy*iy)*sqrt(vx*vx+vy*vy)) END),6) AS user_contribution_index,
CASE WHEN count(*) FILTER (WHERE decoder_update AND has_command)>0 THEN round(1-count(*) FILTER (WHERE decoder_update AND has_command AND sqrt(ix*ix+iy*iy)>1e-9 AND sqrt(vx*vx+vy*vy)>1e-9)/count(*) FILTER (WHERE decoder_update AND has_command),6) ELSE 1.0 END AS uci_excluded_frac"""


@query("user_contribution", f"SELECT episode_id, {UCI_SQL} FROM d_trace GROUP BY episode_id")
def user_contribution(spark, d):
    uci, out = TR.contribution(F.col("decoder_update") & F.col("has_command"))
    return tables.trace(spark, d).groupBy("episode_id").agg(
        rounded(uci).alias("user_contribution_index"), rounded(out).alias("uci_excluded_frac")
    )


@query(
    "command_accuracy",
    f"""WITH c AS (SELECT episode_id, decoder_update AND has_command AND sqrt(vx*vx+vy*vy)>0 AS issued, CAST({argmax_sql('-vx', 'vx', '-vy', 'vy')}=event_id%4 AS INT) AS hit FROM d_trace)
SELECT episode_id, round(avg(CASE WHEN issued THEN hit END),6) AS command_accuracy, count(*) FILTER (WHERE issued) AS commands_issued FROM c GROUP BY episode_id""",
)
def command_accuracy(spark, d):
    acc, n = TR.command_accuracy(F.col("event_id") % 4)
    return tables.trace(spark, d).groupBy("episode_id").agg(rounded(acc).alias("command_accuracy"), n.alias("commands_issued"))


# --- outcome metrics ---

EFF = "avg(CASE WHEN acquired AND path_length>0 THEN CASE WHEN straight_line=0 THEN 1.0 ELSE straight_line/path_length END END)"


@query(
    "outcome_counts",
    "SELECT episode_id, count(*) FILTER (WHERE acquired) AS n_success, count(*) FILTER (WHERE NOT acquired) AS n_timeouts, CAST(sum(collisions) AS BIGINT) AS collisions FROM d_outcome GROUP BY episode_id",
)
def outcome_counts(spark, d):
    return TR.outcome_metrics(tables.outcomes(spark, d), 8, names=["n_success", "n_timeouts", "collisions"])


@query("success_rate", "SELECT episode_id, round(count(*) FILTER (WHERE acquired)/8.0::DOUBLE,6) AS success_rate FROM d_outcome GROUP BY episode_id")
def success_rate(spark, d):
    out = TR.outcome_metrics(tables.outcomes(spark, d), 8, names=["success_rate"])
    return out.select("episode_id", *r("success_rate"))


@query(
    "time_to_target",
    "SELECT episode_id, median(duration_s) FILTER (WHERE acquired) AS time_to_target_median, count(*) FILTER (WHERE NOT acquired) AS time_to_target_excluded FROM d_outcome GROUP BY episode_id",
)
def time_to_target(spark, d):
    return TR.median_time(tables.outcomes(spark, d))


@query("path_efficiency", f"SELECT episode_id, round({EFF},6) AS path_efficiency FROM d_outcome GROUP BY episode_id")
def path_efficiency(spark, d):
    out = TR.outcome_metrics(tables.outcomes(spark, d), 8, names=["path_efficiency"])
    return out.select("episode_id", *r("path_efficiency"))


ITR = """CASE WHEN {d}>0 THEN greatest(CASE WHEN {r}<=1/8.0::DOUBLE THEN 0 WHEN {r}>=1 THEN log2(8.0::DOUBLE)
 ELSE log2(8.0::DOUBLE)+{r}*log2({r})+(1-{r})*log2((1-{r})/7) END,0)*(480.0::DOUBLE/{d}) END"""


@query(
    "information_rate",
    "WITH s AS (SELECT episode_id, least(count(*) FILTER (WHERE acquired)/8.0::DOUBLE,1) AS rate, sum(duration_s) AS dur FROM d_outcome GROUP BY episode_id) SELECT episode_id, round("
    + ITR.format(d="dur", r="rate") + ",6) AS effective_itr FROM s",
)
def information_rate(spark, d):
    per = tables.outcomes(spark, d).groupBy("episode_id").agg(
        F.least(F.count(F.when(F.col("acquired"), 1)) / 8.0, F.lit(1.0)).alias("rate"), F.sum("duration_s").alias("dur")
    )
    return per.select("episode_id", rounded(X.information_rate(F.col("rate"), 8, F.col("dur"))).alias("effective_itr"))


@query(
    "episode_summary",
    REVERSAL_CTE + f""", o AS (SELECT episode_id, count(*) FILTER (WHERE acquired) AS n_success, count(*) FILTER (WHERE NOT acquired) AS n_timeouts, CAST(sum(collisions) AS BIGINT) AS collisions,
  count(*) FILTER (WHERE acquired)/8.0::DOUBLE AS success_rate, {EFF} AS path_efficiency, median(duration_s) FILTER (WHERE acquired) AS time_to_target_median,
  count(*) FILTER (WHERE NOT acquired) AS time_to_target_excluded FROM d_outcome GROUP BY episode_id),
t AS (SELECT episode_id, count(*)*0.1::DOUBLE AS episode_duration_s, {UCI_SQL} FROM d_trace GROUP BY episode_id),
v AS (SELECT episode_id, avg(n_reversals) AS direction_reversals FROM c GROUP BY episode_id)
SELECT episode_id, n_success, n_timeouts, collisions, round(success_rate,6) AS success_rate, round(path_efficiency,6) AS path_efficiency, time_to_target_median, time_to_target_excluded,
 round(episode_duration_s,6) AS episode_duration_s, user_contribution_index, uci_excluded_frac, round(direction_reversals,6) AS direction_reversals,
 round({ITR.format(d="episode_duration_s", r="least(success_rate,1)")},6) AS effective_itr,
 o.episode_id IS NOT NULL AS has_outcomes, t.episode_id IS NOT NULL AS has_trace FROM o FULL JOIN t USING (episode_id) LEFT JOIN v USING (episode_id)""",
)
def episode_summary(spark, d):
    """All metrics of every episode that has outcomes or a trace."""
    out = TR.summarise(tables.outcomes(spark, d), tables.trace(spark, d), 8, DT)
    return out.select(
        "episode_id", "n_success", "n_timeouts", "collisions", "time_to_target_median", "time_to_target_excluded", "has_outcomes", "has_trace",
        *r("success_rate", "path_efficiency", "episode_duration_s", "user_contribution_index", "uci_excluded_frac",
           "direction_reversals", "effective_itr"),
    )


# --- standardisation ---

EWM_CTE = """
WITH RECURSIVE s AS (SELECT subject, channel, sample_idx, value FROM d_sample),
f AS (SELECT subject, channel, sample_idx, value AS num, 1.0::DOUBLE AS den FROM s WHERE sample_idx=0
  UNION ALL SELECT s.subject, s.channel, s.sample_idx, 0.98::DOUBLE*num+value, 0.98::DOUBLE*den+1 FROM f JOIN s ON s.subject=f.subject AND s.channel=f.channel AND s.sample_idx=f.sample_idx+1),
m AS (SELECT s.*, s.value-num/den AS dev, num/den AS mean FROM f JOIN s USING (subject, channel, sample_idx)),
g AS (SELECT subject, channel, sample_idx, dev*dev AS num, 1.0::DOUBLE AS den FROM m WHERE sample_idx=0
  UNION ALL SELECT m.subject, m.channel, m.sample_idx, 0.98::DOUBLE*num+dev*dev, 0.98::DOUBLE*den+1 FROM g JOIN m ON m.subject=g.subject AND m.channel=g.channel AND m.sample_idx=g.sample_idx+1),
h AS (SELECT subject, channel, avg(value) AS hm, stddev_pop(value) AS hs FROM s WHERE sample_idx<50 GROUP BY ALL)"""


@query("moving_mean", EWM_CTE + " SELECT subject, channel, sample_idx, round(mean,6) AS mean FROM m")
def moving_mean(spark, d):
    out = series.ewm_mean(tables.samples(spark, d), ["subject", "channel"], "sample_idx", F.col("value"), 0.02, "mean")
    return out.select("subject", "channel", "sample_idx", *r("mean"))


@query(
    "moving_standardise",
    EWM_CTE + """ SELECT m.subject, m.channel, m.sample_idx, round(CAST(CAST(CASE WHEN m.sample_idx<50 THEN (value-hm)/greatest(1e-4,hs) ELSE dev/greatest(1e-4,sqrt(num/den)) END AS FLOAT) AS DOUBLE),4)+0.0 AS z
FROM m JOIN g USING (subject, channel, sample_idx) JOIN h USING (subject, channel)""",
)
def moving_standardise(spark, d):
    """Causal standardisation of every series; rounded to 4 places because it is handed out as float32."""
    out = series.moving_standardise(
        tables.samples(spark, d), ["subject", "channel"], "sample_idx", "value", 0.02, 50, 1e-4, "z"
    )
    return out.select("subject", "channel", "sample_idx", rounded(F.col("z"), 4).alias("z"))
