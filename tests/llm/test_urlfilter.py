import duckdb
import numpy as np
import pytest

from protelith.llm import urlfilter

from .conftest import MEDIUM, SMALL


@pytest.mark.parametrize("data", [SMALL, MEDIUM])
def test_matches_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{data}/pages.parquet'")
    rel = con.execute(urlfilter.SQL)
    names = [c[0] for c in rel.description]
    want = sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: r["page_id"])
    assert [r.asDict() for r in urlfilter.query(spark, data).orderBy("page_id").collect()] == want


URLS = [
    ("http://a.example.com/en/1?x=/fr/", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://x.com", "x.com", "", None, "allow"), ("http://y.com/", "y.com", "/", "com/", "allow"), ("http://xcom/", "xcom", "/", None, "allow"),
    ("http://q.net/es/#f", "q.net", "/es/", "net/es/", "block"), ("ftp://r.net?es/", "r.net", "", None, "allow"), ("no url", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("a://b://c/", "b:", "//c/", None, "allow"), ("http://É.COM/é", "É.com", "/é", "com/", "allow"), ("http://long.org/" + "p" * 100_000, "long.org", "/" + "p" * 100_000, None, "allow"),
    ("http://tie.net/es/1", "tie.net", "/es/1", "net/es/", "block"), ("http://tie.net/es/1", "tie.net", "/es/1", "net/es/", "block")]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages).collect()}
    assert [got[i] for i in range(len(URLS))] == [u[1:] for u in URLS]


def test_distrust_flows_back_along_links(spark):
    link = '<a href="http://{}/x">'.format
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://friend.org/a", link("bad.net")), (3, "http://good.com/a", link("fine.org")), (4, "http://fine.org/a", ""),
            (5, "http://alone.org/", link("nowhere.org")), (6, "http://pal.org/", '<a href=//BAD.net?x>')]
    got = {r.host: r for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {h: r.verdict for h, r in got.items()} == {
        "bad.net": "block", "friend.org": "block", "good.com": "allow", "fine.org": "allow", "alone.org": "allow", "pal.org": "block"}
    assert got["fine.org"].trust > 0 and got["friend.org"].distrust > 0


def test_hosts_of_a_domain_reach_each_other(spark):
    rows = [(1, "http://a.x.net/es/1", None), (2, "http://b.x.net/fr/1", None), (3, "http://c.x.net/en/1", None), (4, "http://c.y.net/en/1", None), (5, "http://x.y.z.org/", None),
            (6, "http://10.0.0.1/en", None), (7, "http://10.0.0.2/en", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judged(df).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    assert got[3].distrust > 0 == got[4].distrust
    edges = {(r.src, r.dst) for r in urlfilter.host_edges(spark.createDataFrame([], "src string, dst string"), df.selectExpr("'x.y.z.org' AS host")).collect()}
    assert edges == {("x.y.z.org", "y.z.org"), ("y.z.org", "x.y.z.org"), ("y.z.org", "z.org"), ("z.org", "y.z.org")}


def test_graph_decides_pages_without_a_rule(spark):
    free = urlfilter.query(spark, MEDIUM).where("rule is null")
    assert {r.verdict for r in free.collect()} == {"allow", "block"} and free.where("distrust > 0").count() > 20


def test_scores_match_power_iteration(spark):
    rng = np.random.default_rng(4)
    n, d = 12, urlfilter.DAMPING
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b})
    hosts = spark.createDataFrame([(f"h{i}", float(i < 2), float(i > 9)) for i in range(n)], "host string, trust_seed double, distrust_seed double")
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.host_scores(
        hosts, spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in edges], "src string, dst string"), tolerance=1e-9).collect()}
    for k, (seed, links) in enumerate([([i < 2 for i in range(n)], edges), ([i > 9 for i in range(n)], [(b, a) for a, b in edges])]):
        s = (1 - d) * np.array(seed, float)
        m = np.zeros((n, n))
        for a, b in links:
            m[b, a] = d / sum(x == a for x, _ in links)
        p = np.linalg.solve(np.eye(n) - m, s)
        assert all(abs(got.get(f"h{i}", (0, 0))[k] - p[i]) < 1e-7 for i in range(n))


def test_distrust_reaches_far_hosts(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}") for i in range(25)], "src string, dst string")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trust_seed double, distrust_seed double")
    got = {r.host: r.trust for r in urlfilter.host_scores(seeds, edges, tolerance=1e-12).collect()}
    assert all(abs(got[f"h{i}"] - 0.5 ** (i + 1)) < 1e-15 for i in range(26))


def test_empty(spark):
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(1, "http://a.org/x", None), (1, "http://a.org/x", None), (None, None, None)]
    assert urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule")).count() == 3
