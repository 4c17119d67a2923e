"""Streams run to completion, each against its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from kymora.functions import vectors as V
from kymora.functions.vectors import rounded
from kymora.plans.queries_contracts import scratch
from kymora.plans.registry import query
from kymora.streaming import online as O

LAST = "(SELECT epoch_us(max(ts))//1000*1000 FROM events)"


def _events(spark, d):
    e = O.read_stream(spark, d, "events")
    return e.withColumn("subject", (F.col("user_id") % 9 + 1).cast("int"))


@query(
    "stream_sliding_windows",
    f"""WITH w AS (SELECT event_type, value, epoch_us(ts) AS us, unnest(range(0,8)) AS i FROM events),
s AS (SELECT event_type, value, (us//900000000 - i)*900000000 AS start FROM w)
SELECT make_timestamp(start) AS window_start, make_timestamp(start+7200000000) AS window_end, event_type, count(*) AS n, round(sum(value),4) AS total
FROM s WHERE start+7200000000 <= {LAST}-600000000 GROUP BY ALL""",
)
def stream_sliding_windows(spark, d):
    """Two-hour windows every fifteen minutes, emitted once they are final."""
    out = O.sliding_windows(
        _events(spark, d), "ts", "10 minutes", "2 hours", "15 minutes", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
    )
    done = O.run_append(out, scratch(spark, "stream"))
    return done.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "event_type", "n", rounded(F.col("total"), 4).alias("total"),
    )


@query(
    "stream_bursts",
    f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g),
b AS (SELECT user_id, burst, min(ts) AS burst_start, max(ts)+INTERVAL 2 HOURS AS burst_end, count(*) AS n FROM i GROUP BY ALL)
SELECT user_id, burst_start, burst_end, n FROM b WHERE epoch_us(burst_end) <= {LAST}-600000000""",
)
def stream_bursts(spark, d):
    """Runs of a user's events with no gap of two hours."""
    out = O.segment_bursts(_events(spark, d), "ts", "10 minutes", "2 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    done = O.run_append(out, scratch(spark, "stream"))
    return done.select("user_id", F.col("burst_start").cast("timestamp_ntz").alias("burst_start"), F.col("burst_end").cast("timestamp_ntz").alias("burst_end"), "n")


@query(
    "stream_latest_available",
    f"""WITH v AS (SELECT user_id, epoch_us(ts)+21600000000 AS at, value FROM events WHERE event_type='click'),
q AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type<>'click'),
m AS (SELECT max(CASE WHEN event_type='click' THEN epoch_us(ts)+21600000000 ELSE epoch_us(ts) END)//1000*1000 AS last FROM events)
SELECT q.user_id, q.event_id, v.value AS latest FROM q ASOF LEFT JOIN v ON q.user_id=v.user_id AND q.at>=v.at WHERE q.at <= (SELECT last FROM m)""",
)
def stream_latest_available(spark, d):
    """Newest click value of the user that is at least six hours old."""
    e = _events(spark, d).withColumn("is_value", F.col("event_type") == "click")
    out = O.latest_available(e, ["user_id"], "ts", "event_id", "0 seconds", "is_value", "value", 21600.0)
    return O.run_append(out, scratch(spark, "stream"))


@query(
    "stream_moving_standardise",
    f"""WITH RECURSIVE s AS (SELECT event_id, CAST(user_id%9+1 AS INT) AS subject, event_type, ts, value, row_number() OVER (PARTITION BY user_id%9+1, event_type ORDER BY ts, event_id)-1 AS i FROM events),
f AS (SELECT subject, event_type, i, value AS num, 1.0::DOUBLE AS den, value-value AS dev, 0.0::DOUBLE AS vn, 1.0::DOUBLE AS vd FROM s WHERE i=0
 UNION ALL SELECT subject, event_type, i, num, den, dev, 0.98::DOUBLE*vn+dev*dev, 0.98::DOUBLE*vd+1 FROM
  (SELECT s.subject, s.event_type, s.i, 0.98::DOUBLE*num+value AS num, 0.98::DOUBLE*den+1 AS den, value-(0.98::DOUBLE*num+value)/(0.98::DOUBLE*den+1) AS dev, vn, vd
   FROM f JOIN s ON s.subject=f.subject AND s.event_type=f.event_type AND s.i=f.i+1) z)
SELECT subject, event_type, event_id, round(num/den,6) AS mean, round(dev/greatest(1e-4,sqrt(vn/vd)),6)+0.0 AS z FROM f JOIN s USING (subject, event_type, i) WHERE epoch_us(ts)<={LAST}""",
)
def stream_moving_standardise(spark, d):
    """Running mean and standardised value of every series, with carried state."""
    out = O.moving_standardise(_events(spark, d), ["subject", "event_type"], "ts", "event_id", "0 seconds", "value", 0.02, 1e-4)
    done = O.run_append(out, scratch(spark, "stream"))
    return done.select("subject", "event_type", "event_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("z")).alias("z"))


_z = "(exp(-4*ix)+exp(4*ix)+exp(-4*iy)+exp(4*iy))"


def _lean(e):
    """Four probabilities that lean toward a direction taken from the event number."""
    angle = F.radians(((F.col("event_id") * 37) % 360).cast("double"))
    ix, iy = F.cos(angle), F.sin(angle)
    parts = [F.exp(-4 * ix), F.exp(4 * ix), F.exp(-4 * iy), F.exp(4 * iy)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return e.select("*", *[(p / total).alias(f"p{i}") for i, p in enumerate(parts)])


@query(
    "stream_evidence",
    f"""WITH RECURSIVE c AS (SELECT event_id, user_id, ts, cos(radians((event_id*37)%360)) AS ix, sin(radians((event_id*37)%360)) AS iy FROM events),
n AS (SELECT *, exp(-4*ix)/{_z} AS p0, exp(4*ix)/{_z} AS p1, exp(-4*iy)/{_z} AS p2, exp(4*iy)/{_z} AS p3, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM c),
l AS (SELECT user_id, pos, ts, event_id, ln(p0+1e-6::DOUBLE) AS l0, ln(p1+1e-6::DOUBLE) AS l1, ln(p2+1e-6::DOUBLE) AS l2, ln(p3+1e-6::DOUBLE) AS l3 FROM n),
f AS (SELECT user_id, pos, l0 AS a0, l1 AS a1, l2 AS a2, l3 AS a3, greatest(l0,l1,l2,l3) > -0.5 AS fired FROM l WHERE pos=1
 UNION ALL SELECT user_id, pos, a0, a1, a2, a3, greatest(a0,a1,a2,a3) > -0.5 FROM (SELECT l.user_id, l.pos, CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a0 END+l0 AS a0, CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a1 END+l1 AS a1,
   CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a2 END+l2 AS a2, CASE WHEN fired THEN 0 ELSE 0.8::DOUBLE*a3 END+l3 AS a3 FROM f JOIN l ON l.user_id=f.user_id AND l.pos=f.pos+1) z),
g AS (SELECT f.*, ts, event_id, greatest(a0,a1,a2,a3) AS top, CASE WHEN NOT fired THEN -1 WHEN round(a0,9)>=round(greatest(a0,a1,a2,a3),9) THEN 0 WHEN round(a1,9)>=round(greatest(a0,a1,a2,a3),9) THEN 1 WHEN round(a2,9)>=round(greatest(a0,a1,a2,a3),9) THEN 2 ELSE 3 END AS emitted FROM f JOIN l USING (user_id, pos)),
h AS (SELECT *, max(CASE WHEN fired THEN epoch_us(ts) END) OVER w AS since, arg_max(emitted, CASE WHEN fired THEN pos END) OVER w AS held FROM g WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, event_id, emitted, CASE WHEN epoch_us(ts)-since < 3600000000 THEN held ELSE -1 END AS held, round(top,6) AS evidence_max FROM h WHERE epoch_us(ts)<={LAST}""",
)
def stream_evidence(spark, d):
    """Evidence per user with threshold, reset and a hold of one hour."""
    out = O.accumulate_evidence(
        _lean(_events(spark, d)), ["user_id"], "ts", "event_id", "0 seconds", ["p0", "p1", "p2", "p3"], theta=-0.5, hold_s=3600.0
    )
    done = O.run_append(out, scratch(spark, "stream"))
    return done.select("user_id", "event_id", "emitted", F.coalesce("held", F.lit(-1)).alias("held"), rounded(F.col("evidence_max")).alias("evidence_max"))


@query(
    "stream_late_rows",
    """WITH a AS (SELECT event_id, CAST(user_id%9+1 AS INT) AS subject, epoch_us(ts) AS us, event_id+(event_id*7919)%97 AS k FROM events),
o AS (SELECT *, max(us) OVER (PARTITION BY subject ORDER BY k*1000000+event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a)
SELECT subject, count(*) AS n, count(*) FILTER (WHERE us < newest-7200000000) AS n_late FROM o GROUP BY subject""",
)
def stream_late_rows(spark, d):
    """Rows more than two hours behind, counted instead of dropped; arrival order is shuffled."""
    e = _events(spark, d).withColumn("arrival", (F.col("event_id") + (F.col("event_id") * 7919) % 97) * 1000000 + F.col("event_id"))
    done = O.run_append(O.late_policy(e, ["subject"], "arrival", "ts", 7200.0), scratch(spark, "stream"))
    return done.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_late"), 1)).alias("n_late"))


@query(
    "stream_late_aside",
    """WITH a AS (SELECT event_id, CAST(user_id%9+1 AS INT) AS subject, epoch_us(ts) AS us, event_id+(event_id*7919)%97 AS k FROM events),
o AS (SELECT *, max(us) OVER (PARTITION BY subject ORDER BY k*1000000+event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a),
f AS (SELECT subject, coalesce(us < newest-7200000000, false) AS late FROM o)
SELECT 'kept' AS place, subject, count(*) AS n FROM f WHERE NOT late GROUP BY ALL UNION ALL SELECT 'aside', subject, count(*) FROM f WHERE late GROUP BY ALL
UNION ALL SELECT 'counted kept', 0, count(*) FROM f WHERE NOT late UNION ALL SELECT 'counted aside', 0, count(*) FROM f WHERE late UNION ALL SELECT 'dropped', 0, 0""",
)
def stream_late_aside(spark, d):
    """Rows more than two hours behind go to a table of their own; counts of rows kept, set aside and dropped by the engine."""
    e = _events(spark, d).withColumn("arrival", (F.col("event_id") + (F.col("event_id") * 7919) % 97) * 1000000 + F.col("event_id"))
    kept, aside, counts = O.run_aside(O.late_policy(e, ["subject"], "arrival", "ts", 7200.0), "is_late", scratch(spark, "stream"))
    tables = [t.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("place"), "subject", "n") for name, t in (("kept", kept), ("aside", aside))]
    sums = [counts.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).select(F.lit(name).alias("place"), F.lit(0).alias("subject"), "n") for name, c in (("counted kept", "n_kept"), ("counted aside", "n_aside"), ("dropped", "n_dropped"))]
    out = tables[0]
    for t in (tables[1], *sums):
        out = out.unionByName(t)
    return out


@query(
    "stream_tumbling_metrics",
    f"""WITH c AS (SELECT event_id, ts, event_type, cos(radians((event_id*37)%360)) AS ix, sin(radians((event_id*37)%360)) AS iy FROM events),
n AS (SELECT *, exp(-4*ix)/{_z} AS p0, exp(4*ix)/{_z} AS p1, exp(-4*iy)/{_z} AS p2, exp(4*iy)/{_z} AS p3 FROM c)
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(-(p0*ln(p0)+p1*ln(p1)+p2*ln(p2)+p3*ln(p3))/ln(4.0::DOUBLE)),6) AS entropy, round(avg(greatest(p0,p1,p2,p3)),6) AS confidence
FROM n GROUP BY ALL""",
)
def stream_tumbling_metrics(spark, d):
    """Daily decoder metrics in update mode; the last version of a day counts."""
    e = _lean(_events(spark, d)).withColumn("p", F.array("p0", "p1", "p2", "p3"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(V.normalised_entropy(F.col("p"))).alias("entropy"), F.avg(F.array_max("p")).alias("confidence")]
    out = O.tumbling_metrics(e, "ts", "10 minutes", "1 day", ["event_type"], aggs)
    done = O.run_update(out, scratch(spark, "stream"), ["window_start", "window_end", "event_type"])
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", rounded(F.col("entropy")).alias("entropy"), rounded(F.col("confidence")).alias("confidence"))


@query(
    "arrival_order_violations",
    """WITH a AS (SELECT event_id, CAST(user_id%9+1 AS INT) AS subject, ts, row_number() OVER (PARTITION BY user_id%9+1 ORDER BY (event_id+(event_id*7919)%97), event_id)-1 AS arrival FROM events),
o AS (SELECT *, lag(ts) OVER (PARTITION BY subject ORDER BY arrival) AS before FROM a) SELECT subject, event_id, arrival FROM o WHERE ts<before""",
)
def arrival_order_violations(spark, d):
    """Batch check: rows whose time runs backwards in arrival order."""
    from kymora.operators import asof, series
    from kymora.sources import tables

    e = tables.read(spark, d, "events").select("event_id", (F.col("user_id") % 9 + 1).cast("int").alias("subject"), "ts")
    k = e.withColumn("k", F.col("event_id") + (F.col("event_id") * 7919) % 97)
    placed = series.dense_index(k, ["subject"], ["k", "event_id"], F.floor(F.col("k") / 65536), "arrival")
    return asof.order_violations(placed, ["subject"], "arrival", "ts").select("subject", "event_id", "arrival")
