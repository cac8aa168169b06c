"""Source divergence audit: how far the term distribution of each (lang, source) group lies from those of the other sources of its lang, and by which terms.

Terms are maximal runs of letters (anything beyond ASCII counts as one), A-Z lower-cased; a lang keeps the V terms that stand in ``MIN_DOCS`` of its documents or more.
A group of N kept occurrences gives a term that it holds ``count`` times the probability ``1 + floor(10**9 * (count + 2) / (N + 2 * V))``, and so does the lang as a whole;
two probabilities differ by ``floor((p - q)**2 / (p + q))``. All arithmetic is in whole numbers.

* Counting: each task counts terms by group and flushes its counts when they are many, so words that every document holds travel once a flush; postings (a row for each group
  and term) are what is left.
* Pairs of sources come from postings: two groups that both hold a term meet under it, once for both directions. What a term adds that only one of them holds follows from the
  number of its terms of each count, and what one adds that neither holds from V.
* Terms of a group are searched by upper bounds. Its postings lie in buckets by count, ``PER_OCTAVE`` for each doubling; as the difference grows with p and falls with q, the largest count and the least
  probability in the lang bound a whole bucket. Buckets are evaluated best first, ``FIRST`` of them, then four times as many, and so on, until the bounds of the unseen ones are strictly below the
  k-th value found, so ties stay.

Rows: null text, lang and source count as empty; a group without terms takes part in all pairs of its lang; a lang that keeps no term has pairs of value 0; a lang of one source has no pair; each row is a document,
so repeated rows and equal or null doc_ids count each; equal values are ranked by item; texts of any length are counted by segments; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small_batches

MIN_DOCS, TOP, PER_OCTAVE, FIRST = 10, 10, 4, 4
SEGMENT_BYTES, FLUSH_TERMS = 4 << 20, 200_000
_term = re.compile(rb"[A-Za-z\x80-\xFF]+")
_gap = re.compile(rb"[^A-Za-z\x80-\xFF]")
COUNTS = "lang string, source string, term binary, n long, docs long"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, by segments that end outside a term."""
    at = 0
    while at < len(raw):
        end = _gap.search(raw, at + SEGMENT_BYTES)
        end = end.start() if end else len(raw)
        yield _term.findall(raw[at:end].lower())
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, of as many documents as fit into a flush."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*group, term, n, docs[term]) for group, (total, docs) in held.items() for term, n in total.items()]
        held.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], [c.split()[0] for c in COUNTS.split(", ")])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            total, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(text):
                total.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(t) for t, _ in held.values()) >= FLUSH_TERMS:
            yield flush()
            release()
    yield flush()
    release()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(count: Column, size: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / size), three digits at a time so that nothing overflows; null for a size of 0."""
    size = F.when(size > 0, size)
    rest, out = count + 2, F.lit(1).cast("long")
    for scale in (1_000_000, 1_000, 1):
        out = out + _div(rest * 1000, size) * scale
        rest = (rest * 1000) % size
    return out


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, term, n: occurrences in the group, total: in the lang) of kept terms, and groups (lang, source, size, lang_size, v, zero: p of a term it doesn't hold)."""
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"),
                       F.coalesce(F.col(text).cast("string"), empty).cast("binary").alias("text"))
    # Dealt by lang and term, the counts of a group and of the lang need no further shuffle.
    counts = rows.mapInArrow(_counted, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"total": F.sum("n").over(of_lang), "docs": F.sum("docs").over(of_lang), "once": (F.min("source").over(of_lang) == F.col("source")).cast("long")})
    postings = cut(kept.where(F.col("docs") >= min_docs).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "once"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("once").alias("v"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "v"])
    groups = groups.select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("size"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_size"), "v")
    return postings.drop("once"), cut(groups.withColumn("zero", probability(F.lit(0).cast("long"), F.col("size"))))


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value for all pairs of sources of a lang."""
    held = postings.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("size")))
    side = lambda df, x, *cols: df.select("lang", F.col("source").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cols])
    a, b, pa_, pb, za, zb = "a", "b", F.col("a_p"), F.col("b_p"), F.col("a_zero"), F.col("b_zero")
    met = side(held, a, "term", "p", "zero").withColumnRenamed("a_term", "term").join(side(held, b, "term", "p", "zero").withColumnRenamed("b_term", "term"), ["lang", "term"]).where("a < b")
    both = met.select("lang", "a", "b", (difference(pa_, pb) - difference(pa_, zb) - difference(za, pb) + difference(za, zb)).alias("value"))
    spread = held.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    one = side(spread, a, "p", "zero", "terms").join(side(groups, b, "zero"), "lang").where("a <> b")
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a_terms") * (difference(pa_, zb) - difference(za, zb))).alias("value"))
    none = side(groups, a, "zero", "v").join(side(groups, b, "zero"), "lang").where("a < b")
    none = none.select("lang", "a", "b", F.coalesce(F.col("a_v") * difference(za, zb), F.lit(0)).alias("value"))
    total = both.unionByName(one).unionByName(none).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return total.select("lang", F.inline(ways), "value")


def top_terms(postings: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (a term that the group holds more often than its lang), value, rank: the ``top`` of each group."""
    bucket = F.floor(F.log2(F.col("n")) * PER_OCTAVE).cast("int")
    postings, sizes = postings.withColumn("bucket", bucket), groups.select("lang", "source", "size", "lang_size")
    p, q = probability(F.col("n"), F.col("size")), probability(F.col("total"), F.col("lang_size"))
    group = ["lang", "source"]
    buckets = postings.groupBy(*group, "bucket").agg(F.max("n").alias("n"), F.min("total").alias("total")).join(sizes, group).withColumns({"p": p, "q": q})
    buckets = buckets.where("p > q").withColumn("bound", difference(F.col("p"), F.col("q")))
    best_first = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    buckets = cut(buckets.select(*group, "bucket", "bound", F.row_number().over(best_first).alias("at")))
    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    found = postings.sparkSession.createDataFrame([], "lang string, source string, item string, value long, rank int")
    seen, step, last = 0, FIRST, buckets.agg(F.max("at")).first()[0] or 0
    while seen < last:
        kth = found.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        unseen = buckets.where((F.col("at") > seen) & (F.col("at") <= seen + step)).join(kth, group, "left").where("kth is null or bound >= kth").select(*group, "bucket")
        unseen = cut(unseen)
        if unseen.isEmpty():
            break
        scored = postings.join(unseen, [*group, "bucket"]).join(sizes, group).withColumns({"p": p, "q": q}).where("p > q")
        scored = scored.select(*group, F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
        found = cut(found.drop("rank").unionByName(scored).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
        seen, step = seen + step, 4 * step
    return found


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    postings, groups = counted(docs, text, lang, source, min_docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = pairs(postings, groups).withColumn("rank", F.row_number().over(ranked))
    parts = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", of_pairs), ("term", top_terms(postings, groups, top)))]
    return parts[0].unionByName(parts[1])


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_n FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT lang, source, coalesce(n, 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS n FROM c GROUP BY lang, source) USING (lang, source)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (group_n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (lang_n + 2 * v) AS q
  FROM (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, group_n, v, total, lang_n
    FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM term) WHERE part = 'pair' OR rank <= {TOP}"""
