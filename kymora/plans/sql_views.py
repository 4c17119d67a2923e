"""The derived tables spelled as SQL, for the independent check."""

from __future__ import annotations

import re

VIEWS = {
    "d_posterior": """
SELECT window_id, subject, burst_id, t_rel, label,
       CAST(CAST(e0/(e0+e1+e2+e3) AS FLOAT) AS DOUBLE) AS p0, CAST(CAST(e1/(e0+e1+e2+e3) AS FLOAT) AS DOUBLE) AS p1,
       CAST(CAST(e2/(e0+e1+e2+e3) AS FLOAT) AS DOUBLE) AS p2, CAST(CAST(e3/(e0+e1+e2+e3) AS FLOAT) AS DOUBLE) AS p3
FROM (SELECT w.*, exp(6*x0 + CASE WHEN label=0 THEN 0.6 ELSE 0 END) AS e0, exp(6*x1 + CASE WHEN label=1 THEN 0.6 ELSE 0 END) AS e1,
             exp(6*x2 + CASE WHEN label=2 THEN 0.6 ELSE 0 END) AS e2, exp(6*x3 + CASE WHEN label=3 THEN 0.6 ELSE 0 END) AS e3
      FROM (SELECT vec_id AS window_id, CAST(floor(vec_id/7) AS BIGINT) AS burst_id,
                   CAST(CAST(floor(vec_id/7) AS BIGINT)%9+1 AS INT) AS subject,
                   CAST(2.0+0.25*(vec_id%7) AS DOUBLE) AS t_rel, CAST(CAST(floor(vec_id/7) AS BIGINT)%4 AS INT) AS label,
                   CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1,
                   CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS x3
            FROM embeddings) w) z""",
    "d_argmax": """
SELECT *, CASE WHEN p0>=p1 AND p0>=p2 AND p0>=p3 THEN 0 WHEN p1>=p2 AND p1>=p3 THEN 1 WHEN p2>=p3 THEN 2 ELSE 3 END AS pred
FROM d_posterior""",
    "d_burst": """
SELECT DISTINCT burst_id, subject, label, burst_id*8.0::DOUBLE+3.0::DOUBLE AS burst_onset, burst_id*8.0::DOUBLE+6.5::DOUBLE AS burst_offset
FROM d_posterior""",
    "d_trial": """
SELECT o_orderkey AS trial_id, CAST(o_custkey%9+1 AS INT) AS subject,
       CASE WHEN o_orderdate < TIMESTAMP '1998-04-01 00:00:00' THEN 'T' ELSE 'E' END AS session,
       CAST(o_orderkey%6 AS INT) AS run, CAST(substr(o_orderpriority,1,1) AS INT)-1 AS class,
       CAST(o_orderkey*8.0 AS DOUBLE) AS onset_s, o_orderstatus='P' AS artifact
FROM orders""",
    "d_outcome": """
SELECT l_orderkey AS episode_id, CAST(l_partkey%8 AS INT) AS target_idx, l_returnflag<>'R' AS acquired, l_quantity AS duration_s,
       l_extendedprice/10000.0 AS path_length, l_extendedprice/10000.0*(1-l_discount) AS straight_line,
       CAST(round(l_tax*100) AS INT) AS collisions
FROM lineitem""",
    "d_trace": """
SELECT user_id AS episode_id, event_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
       CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS target_idx,
       value/100.0*cos(radians(k*3.6)) AS vx, value/100.0*sin(radians(k*3.6)) AS vy,
       cos(radians((event_id*37)%360)) AS ix, sin(radians((event_id*37)%360)) AS iy,
       event_type<>'error' AS has_command, event_id%4=0 AS decoder_update
FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events) e""",
    "d_sample": """
SELECT CAST(user_id%9+1 AS INT) AS subject, event_type AS channel,
       row_number() OVER (PARTITION BY user_id%9+1, event_type ORDER BY ts, event_id)-1 AS sample_idx, ts, value
FROM events""",
    "d_episode": """
SELECT o.o_orderkey AS episode_id, CAST(o.o_custkey%9+1 AS INT) AS subject, o.o_orderpriority AS mapping, o.o_orderstatus AS decoder,
       CASE WHEN o.o_orderstatus='P' THEN NULL ELSE CAST(o.o_orderkey%5 AS DOUBLE)/4 END AS alpha,
       CAST(o.o_orderkey%6 AS DOUBLE)/5 AS quality_level, 0.4::DOUBLE+0.5::DOUBLE*(o.o_orderkey%6)/5.0::DOUBLE AS effective_acc,
       0.35::DOUBLE+0.04::DOUBLE*(o.o_custkey%9+1) AS kappa_offline,
       least(count(CASE WHEN l_returnflag<>'R' THEN 1 END),8)/8.0::DOUBLE AS success_rate,
       median(CASE WHEN l_returnflag<>'R' THEN l_quantity END) AS time_to_target_median
FROM orders o JOIN lineitem l ON l.l_orderkey=o.o_orderkey
GROUP BY o.o_orderkey, o.o_custkey, o.o_orderpriority, o.o_orderstatus""",
    "d_scored": """
SELECT *, CAST(episode_id%4*125 AS INT) AS latency_ms, 0.25::DOUBLE+0.5::DOUBLE*success_rate AS command_accuracy, CAST(episode_id%4 AS INT) AS bursts_without_command,
  CASE WHEN episode_id%2=0 THEN 'aware' ELSE 'blind' END AS intent_mode, 1-coalesce(alpha,0)*0.8::DOUBLE+0.01::DOUBLE*(episode_id%7) AS user_contribution_index,
  CAST(1+episode_id%3 AS DOUBLE) AS window_s, CASE WHEN episode_id%7=0 THEN 'stitched' ELSE 'burst' END AS protocol,
  CASE episode_id%3 WHEN 0 THEN 'smoothing' WHEN 1 THEN 'jitter' ELSE 'burst' END AS error_struct
FROM d_episode""",
}

NEEDS = {"d_scored": ("d_episode",), "d_argmax": ("d_posterior",), "d_burst": ("d_posterior",)}


def expand(sql: str) -> str:
    """Put the views a statement names in front of it as CTEs."""
    wanted: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for dep in (*NEEDS.get(name, ()), name):
                if dep not in wanted:
                    wanted.append(dep)
    wanted.sort(key=list(VIEWS).index)
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with\s+recursive\s", "", body)
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\s", "", body)
    return f"WITH {ctes}\n{body}"


def u01(*parts: str) -> str:
    """Uniform draw of the hashing module as SQL text."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}),1,8) AS BIGINT)/4294967296.0::DOUBLE)"
