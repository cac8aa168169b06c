import re
from collections import Counter, defaultdict

import duckdb
import pytest

from protelith.llm import divergence

from .conftest import MEDIUM, SCHEMA, SMALL


def brute(rows, min_docs=10, top=10):
    """The contract with Python's whole numbers; rows of (text, lang, source)."""
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    counts, totals, in_docs, groups = Counter(), Counter(), Counter(), defaultdict(set)
    for l, s, w in docs:
        groups[l].add(s)
        for t in w:
            counts[l, s, t] += 1
            totals[l, t] += 1
        for t in set(w):
            in_docs[l, t] += 1
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for l, sources in groups.items():
        kept = [t for (x, t), n in in_docs.items() if x == l and n >= min_docs]
        v, lang_n = len(kept), sum(totals[l, t] for t in kept)
        q = {t: 1 + 10**9 * (totals[l, t] + 2) // (lang_n + 2 * v) for t in kept}
        p = {}
        for s in sources:
            n = sum(counts[l, s, t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[l, s, t] + 2) // (n + 2 * v) for t in kept}
        for s in sources:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[l, s, t] and p[s][t] > q[t])[:top]
            out += [(l, s, part, item, -value, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (value, _, item) in enumerate(found)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("where", [SMALL, MEDIUM])
def test_query_equals_sql(spark, where):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{where}/documents.parquet'")
    df = divergence.query(spark, where)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(divergence.SQL).fetchall())


def test_query_equals_brute_force(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in divergence.query(spark, SMALL).collect()) == brute(rows)


def test_edges(edge, empty):
    rows = [(r.text, r.lang, r.source) for r in edge.collect()]
    assert found(edge) == brute(rows)
    assert found(edge, min_docs=1) == brute(rows, 1)
    assert found(empty) == []


def test_ties_empty_groups_and_other_alphabets(spark):
    """Equal values at the k-th place, a group without terms, a lang that keeps none, one source, letters of other scripts and upper case beyond ASCII."""
    rows = [(f"alpha beta{i % 3} Über ÜBER ταυ", "en", f"s{i % 4}") for i in range(40)] + [("1 2 3", "en", "none"), (None, "en", None), ("rare", "xx", "a"), ("rare", "xx", "b"), ("alone", "yy", "a")]
    rows += [(" ".join(f"t{chr(97 + k)}" for k in range(25)), "tie", "left")] * 10 + [("other word", "tie", "right")] * 10
    df = spark.createDataFrame([(i, t, l, s, None) for i, (t, l, s) in enumerate(rows)], SCHEMA)
    for top in (1, 10, 30):
        assert found(df, top=top) == brute(rows, top=top)


def test_buckets_are_searched_until_bounds_fall_below_the_kth(spark, monkeypatch):
    """Steep counts: one bucket at a time gives the same as all at once."""
    words = [(f"w{chr(97 + k)}{chr(97 + j)}", k, j) for k in range(12) for j in range(5)]
    rows = [(" ".join(w for w, k, j in words for _ in range((2 ** k if s == "a" else 1 + j) // 4 + (d < 2))), "en", s) for s in "ab" for d in range(10)]
    df = spark.createDataFrame([(i, t, l, s, None) for i, (t, l, s) in enumerate(rows)], SCHEMA)
    want = brute(rows)
    assert found(df) == want
    monkeypatch.setattr(divergence, "FIRST", 1)
    assert found(df) == want


def test_probability_does_not_overflow(spark):
    big = 10**13
    df = spark.range(1).select(divergence.probability(divergence.F.lit(big), divergence.F.lit(3 * big + 7)).alias("p"), divergence.probability(divergence.F.lit(0).cast("long"), divergence.F.lit(0)).alias("none"))
    assert tuple(df.first()) == (1 + 10**9 * (big + 2) // (3 * big + 7), None)


def test_flushes_and_segments(spark, monkeypatch, documents):
    import pyarrow as pa

    text = ("Alpha beta " * 50).encode()
    monkeypatch.setattr(divergence, "SEGMENT_BYTES", 13)
    assert [t for part in divergence.terms_of(text) for t in part] == text.lower().split()
    monkeypatch.setattr(divergence, "FLUSH_TERMS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array([text, b"beta", b""])], ["lang", "source", "text"])
    total = Counter()
    for out in divergence._counted(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["term"]] += r["n"]
            total["docs", r["term"]] += r["docs"]
    assert total == {b"alpha": 100, b"beta": 102, ("docs", b"alpha"): 2, ("docs", b"beta"): 4}
