import pytest

from kymora.llm import url_graph as u

COLUMNS = "page_id bigint, url string, html string"


def link(*hosts):
    return "".join(f"<p><a class=x HREF='https://{h}/a?b#c'>t</a>" for h in hosts)


@pytest.fixture()
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, COLUMNS)

    return make


def verdicts(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_rules_hosts_and_paths(pages):
    rows = [
        (1, "http://A.Example.ORG/es/1?q", None),
        (2, "http://example.org/en/12", None),
        (3, "http://badexample.org/es/1", None),
        (4, "https://x.com/fr/1#t", None),
        (5, "https://x.com/de/", None),
        (6, "https://org", None),
        (7, "no scheme", None),
        (8, None, None),
        (9, "ftp://ÄÉ.net?x://y", None),
        (10, "x://y://org/z", None),
    ]
    got = verdicts(u.judge(pages(rows)))
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("badexample.org", "/es/1", "org/", "allow")
    assert got[4] == ("x.com", "/fr/1", "com/fr/", "allow")
    assert got[5] == ("x.com", "/de/", "com/de/", "block")
    assert got[6] == ("org", "", None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9][:2] == ("ÄÉ.net", "")
    assert got[10][:2] == ("y:", "//org/z")


def test_distrust_flows_against_links_and_trust_along_them(pages):
    rows = [
        (1, "http://bad.com/de/1", link("friend.net")),
        (2, "http://good.org/x", link("praised.net", "both.net")),
        (3, "http://shill.net/a", link("bad.com")),
        (4, "http://farm.net/a", link("shill.net")),
        (5, "http://friend.net/a", link()),
        (6, "http://praised.net/a", link("praised.net")),
        (7, "http://both.net/a", link("bad.com", "good.org")),
        (8, "http://far.net/a", "<a href='/local'>x</a> bad.com"),
    ]
    got = verdicts(u.judge(pages(rows)))
    assert [got[i][3] for i in (1, 2)] == ["block", "allow"]
    assert got[3][3] == got[4][3] == "block" and got[5][3] == got[6][3] == got[8][3] == "allow"


def push(seeds, edges, damping=85):
    """Mass by plain Python."""
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    now = {h: m * (100 - damping) // 100 for h, m in seeds.items()}
    total = dict(now)
    while any(now.values()):
        after = {}
        for s, d, n in edges:
            if now.get(s, 0) > 0:
                after[d] = after.get(d, 0) + (now[s] * damping // 100) * n // out[s]
        for h, m in after.items():
            total[h] = total.get(h, 0) + m
        now = after
    return {h: m for h, m in total.items() if m}


def test_spread_same_as_brute_force_and_ends(spark):
    import random

    rng = random.Random(2)
    edges = {(f"h{rng.randint(0, 20)}", f"h{rng.randint(0, 20)}") for _ in range(60)}
    edges = [(a, b, rng.randint(1, 4)) for a, b in edges if a != b]
    seeds = {f"h{i}": 10**6 * (i + 1) for i in range(4)}
    got = u.spread(spark.createDataFrame(list(seeds.items()), "host string, mass bigint"), spark.createDataFrame(edges, "src string, dst string, n bigint"))
    assert {r["host"]: r["mass"] for r in got.collect()} == push(seeds, edges)


def test_sql_states_the_same_on_linked_pages(spark, pages):
    import duckdb

    from kymora.llm.queries import sql_url_graph

    rows = [(i, f"http://h{i % 9}.{'com' if i % 2 else 'net'}/{'de' if i % 5 == 1 else 'fr' if i % 5 == 2 else 'x'}/{i}", link(*(f"h{(i * k) % 9}.{'com' if k % 2 else 'net'}" for k in range(1, 1 + i % 4)))) for i in range(60)]
    con = duckdb.connect()
    frame = pages(rows).toPandas()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT * FROM frame")
    want = sorted(map(repr, con.execute(f"SELECT page_id, host, path, rule, verdict, trust, distrust FROM ({sql_url_graph(140)})").fetchall()))
    got = sorted(repr(tuple(r)) for r in u.judge(pages(rows)).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect())
    assert got == want


def test_odd_rows(spark, pages):
    from pyspark.sql import functions as F

    rows = [(None, "http://a.org/x", None), (1, "http://a.org/x", ""), (1, "http://a.org/x", ""), (2, "", "<a href=//>"), (3, None, link("a.org"))]
    df = pages(rows).withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "trust", "m", "mass", "src")})
    assert u.judge(df).count() == 5
    assert u.judge(pages(rows).limit(0)).count() == 0
    assert u.judge(pages(rows).drop("html")).count() == 5


def test_a_hub_with_more_mass_than_products_hold(spark):
    edges = [("hub", f"t{i}", 100_000 + i) for i in range(5)] + [("fan", "hub", 3_000_000_000)]
    seeds = {"hub": 10**15, "fan": 8 * 10**18}
    got = u.spread(spark.createDataFrame(list(seeds.items()), "host string, mass bigint"), spark.createDataFrame(edges, "src string, dst string, n bigint"))
    assert {r["host"]: r["mass"] for r in got.collect()} == push(seeds, edges)
