"""Verdicts on urls: rules first, then trust and distrust spread over the links of hosts.

Hosts that rules allow are trusted seeds, hosts that rules block are blocked seeds, each
with the share of its pages.  Trust flows along links (personalised PageRank), distrust
against them: who links to a bad host is bad.  A host is blocked where its distrust
reaches ``least`` and exceeds its trust.

Mass is counted in whole units, UNIT for a host all of whose pages are seeds; divided by
the units of all seeds it is the personalised distribution.  64 bits hold the seeds of
nine billion hosts.  Mass is pushed: a step moves the mass that arrived in the
step before, cut by the damping factor and divided by the links of the host, rounded
down.  So every step shrinks it, the spread ends by itself when no unit moves, and the
result does not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import stored

#: Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UNIT, DAMPING, LEAST = 10**9, 85, 10**6
STEPS = 8  # of the spread in one job
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict); null if none does."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from host to other hosts; a page counts once for each host that it links to."""
    target = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda u: host_and_path(F.regexp_replace(u, r"(?i)\A(?:https?:)?//", "x://"))[0]))
    pairs = pages.filter("host != ''").select(F.col("host").alias("src"), F.explode(target).alias("dst"))
    return pairs.filter("dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: int = DAMPING) -> DataFrame:
    """(host, mass) from ``seeds`` (host, mass) along ``edges`` (src, dst, n).

    A row holds what a host has gathered and what arrived in the last step.  Each host
    also has a row to itself among the links, which keeps its sum, so a step is one join
    and one sum; STEPS of them make a job.
    """
    state = seeds.select("host", F.expr(f"mass div 100 * {100 - damping} + mass % 100 * {100 - damping} div 100").alias("mass")).withColumn("fresh", F.col("mass"))
    hosts = state.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    to = edges.join(out, "src").select("src", "dst", "n", "all")
    flow = stored(to.union(hosts.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))), "flow")
    moving = not edges.isEmpty()
    while moving:
        for _ in range(STEPS):
            kept = F.col("all") == 0
            damped = f"(fresh div 100 * {damping} + fresh % 100 * {damping} div 100)"  # no product of masses: units and links multiply to more than 64 bits
            moved = F.when(kept, 0).otherwise(F.expr(f"{damped} div all * n + {damped} % all * n div all"))
            each = state.join(flow, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), F.when(kept, F.col("mass")).otherwise(moved).alias("mass"), moved.alias("fresh"))
            state = each.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("fresh").alias("fresh"))
        state = stored(state, "mass")
        moving = not state.filter("fresh > 0").isEmpty()
    return state.select("host", "mass").filter("mass > 0")


def judge(pages: DataFrame, rules=RULES, damping: int = DAMPING, least: int = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    A rule that fits decides; the longest wins, of equal ones the last in order of text.
    Else the host decides: block where distrust >= ``least`` (units of 10**-9) and above
    trust, allow otherwise, also for hosts that nothing is known of.  Null urls and urls
    without ``://`` have empty host and path and are allowed.  Null html has no links.
    Repeated rows count as pages of their own and each gets its row; other columns are
    ignored; an empty table gives no rows.  Rules are configuration: a short list.
    """
    have = set(pages.columns)
    cols = [(pages[f"`{c}`"] if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("page_id", "bigint"), ("url", "string"), ("html", "string"))]
    pages = pages.select(*cols)
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    judged = pages.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("page_id", "html", "host", "path", "m.rule", F.col("m.verdict").alias("ruled"))
    edges = stored(links(judged), "edges")
    seeds = judged.filter("host != ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    seeds = stored(seeds.select("host", F.expr(f"{UNIT} * good div pages").alias("good"), F.expr(f"{UNIT} * bad div pages").alias("bad")), "seeds")
    trust = spread(seeds.select("host", F.col("good").alias("mass")), edges, damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(seeds.select("host", F.col("bad").alias("mass")), back, damping)
    known = trust.select("host", F.col("mass").alias("trust")).join(distrust.select("host", F.col("mass").alias("distrust")), "host", "full")
    known = known.select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    full = judged.drop("html").join(known, "host", "left").na.fill(0, ["trust", "distrust"])
    own = F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return full.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
