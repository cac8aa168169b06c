"""URL filter: rules first, then trust and distrust over the host graph, with DataFrame functions only.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with its path; the longest
rule wins (of equal length the one with the longer host). Urls without a rule get their host's verdict:
trust is personalised PageRank from the hosts with more allowed than blocked pages, along the host edges;
distrust is the same from the hosts with more blocked than allowed pages, along the reversed edges. A seed
starts with the share of its pages that such a rule covers. A host whose distrust reaches ``THRESHOLD`` and
exceeds its trust is blocked; values aren't scaled by the size of the graph, so the limit means the same for any.

Edges are the absolute and protocol-relative links between hosts, and those between a host and its parent
domain, in both ways, up to the domain of two labels, whether that has pages or not: so hosts of one domain
reach each other. What flows on shrinks by the damping in each round; a flow under ``TOLERANCE`` ends, and the
rounds with the last flow. All flows of a round together are at most ``DAMPING`` times those before, which bounds the
rounds by log(seeds / TOLERANCE) / log(1 / DAMPING).

Pages are read once, and summed to hosts before anything is joined. Rows: a null url or one without ``://`` has an empty
host and path and no rule; hosts nobody judged are allowed; equal shares of allowed and blocked pages make no seed; repeated
pages count as often as they occur; urls of any length are read whole; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, TOLERANCE, THRESHOLD, CUT_EVERY = 0.5, 1e-6, 0.05, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.col("_rest"), r"^[^/?#]*", 0)
    return (pages.withColumn("_rest", rest).withColumn("host", F.translate(host, UPPER, LOWER))
            .withColumn("path", F.regexp_extract(F.col("_rest").substr(F.length("host") + 1, F.length("_rest")), r"^[^?#]*", 0)).drop("_rest"))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict; null where none fits."""
    split = sorted(((r.partition("/")[0], "/" + r.partition("/")[2], v, r) for v, r in rules), key=lambda x: (-len(x[3]), -len(x[0]), x[2]))
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, v, r in reversed(split):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct src, dst: ``links`` (src, dst), and each of their hosts and ``hosts`` (host) with its parent domains, both ways."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(hosts.select("host")).distinct()
    labels = nodes.where(~F.col("host").rlike(r"^[0-9.:]*$")).select(F.split("host", r"\.").alias("l")).where(F.size("l") > 2)
    suffix = lambda at: F.array_join(F.slice("l", at, F.size("l")), ".")
    kin = labels.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("at")).select(suffix(F.col("at")).alias("src"), suffix(F.col("at") + 1).alias("dst"))
    return links.unionByName(kin).unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst and dst <> ''").distinct()


def host_scores(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust of ``hosts`` (host, trust_seed, distrust_seed) over ``edges`` (src, dst)."""
    ways = edges.select(F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("src"), F.col("dst")),
        F.struct(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    out = ways.groupBy("kind", "src").agg(F.count("*").alias("n"))
    ways = cut(ways.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping / F.col("n")).alias("w")))
    flow = cut(hosts.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust_seed").alias("s")),
                                                        F.struct(F.lit(1).alias("kind"), F.col("distrust_seed").alias("s")))).alias("x"))
               .select("x.kind", "host", ((1 - damping) * F.col("x.s")).alias("p")).where("p > 0"))
    rank, rounds = flow, 0
    while not flow.isEmpty():
        flow = (flow.where(F.col("p") >= tolerance).join(ways, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("p") * F.col("w")).alias("p"))
                .groupBy("kind", "host").agg(F.sum("p").alias("p")))
        rounds += 1
        flow = cut(flow)
        rank = rank.unionByName(flow)
        if rounds % CUT_EVERY == 0:
            rank = cut(rank.groupBy("kind", "host").agg(F.sum("p").alias("p")))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("p"))), F.lit(0.0))
    return rank.groupBy("host").agg(part(0).alias("trust"), part(1).alias("distrust"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of pages (page_id, url, html)."""
    placed = with_host_and_path(pages.select("page_id", "url", "html"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    linked = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    placed = cut(placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), linked.alias("links")))
    named = placed.where("host <> ''")
    share = lambda a, b: F.when(F.col(a) > F.col(b), F.col(a) / F.col("n")).otherwise(0.0)
    hosts = cut(named.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b"))
        .select("host", share("a", "b").alias("trust_seed"), share("b", "a").alias("distrust_seed")))
    links = named.select(F.col("host").alias("src"), F.explode("links").alias("dst")).distinct()
    scores = cut(host_scores(hosts, cut(host_edges(links, hosts))))
    scores = scores.select("host", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
    blocked = (F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return placed.select("page_id", "host", "path", "rule", "by_rule").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    """The same in SQL, the flows of each round by recursion."""
    split = sorted(((r.partition("/")[0], "/" + r.partition("/")[2], v, r) for v, r in RULES), key=lambda x: (-len(x[3]), -len(x[0]), x[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, r)}'" for h, p, v, r in split) + " END"
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    link = r"""(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)"""
    return rf"""
WITH RECURSIVE rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT page_id, html, {low % "regexp_extract(rest, '^[^/?#]*')"} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
placed AS MATERIALIZED (SELECT *, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS by_rule FROM hosted),
counted AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM placed WHERE host <> '' GROUP BY host),
hosts AS MATERIALIZED (SELECT host, CASE WHEN a > b THEN a / n ELSE 0 END AS ts, CASE WHEN b > a THEN b / n ELSE 0 END AS ds FROM counted),
links AS MATERIALIZED (SELECT host AS src, {low % f"unnest(regexp_extract_all(html, '{link}', 1))"} AS dst FROM placed WHERE host <> ''),
labels AS (SELECT string_split(host, '.') AS l FROM (SELECT host FROM hosts UNION SELECT src FROM links UNION SELECT dst FROM links) WHERE NOT regexp_matches(host, '^[0-9.:]*$')),
kin AS (SELECT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels)),
edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT * FROM links UNION ALL SELECT src, dst FROM kin UNION ALL SELECT dst, src FROM kin) WHERE src <> dst AND dst <> ''),
both_ways AS (SELECT 0 AS kind, src, dst FROM edges UNION ALL SELECT 1, dst, src FROM edges),
ways AS MATERIALIZED (SELECT kind, src, dst, {DAMPING}::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS w FROM both_ways),
seeds AS (SELECT 0 AS kind, host, (1 - {DAMPING}::DOUBLE) * ts AS p FROM hosts UNION ALL SELECT 1, host, (1 - {DAMPING}::DOUBLE) * ds FROM hosts),
flow AS (SELECT kind, host, p FROM seeds WHERE p > 0
  UNION ALL SELECT w.kind, w.dst, sum(f.p * w.w) FROM flow f JOIN ways w ON f.kind = w.kind AND f.host = w.src WHERE f.p >= {TOLERANCE}::DOUBLE GROUP BY w.kind, w.dst),
scores AS (SELECT host, round(coalesce(sum(p) FILTER (kind = 0), 0), 6) AS trust, round(coalesce(sum(p) FILTER (kind = 1), 0), 6) AS distrust FROM flow GROUP BY host)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM placed LEFT JOIN scores USING (host)"""


SQL = _sql()
