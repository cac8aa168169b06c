import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from protelith.llm import rules

from .conftest import MEDIUM, SMALL


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts(spark, plain):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.query(spark, SMALL).collect()}
    for i, t in plain:
        b = brute(t)
        assert got[i] == (*b, b[0] < 50 or 100 * b[4] > 50 * b[0])


@pytest.mark.parametrize("text", ["a b c a b c", "x x x x", "x\n\nx\n \n \nx y", "é ü\u00a0z\x0bq", "a|b <c> #", "\x85 a\x85b"])
def test_counts_of_odd_texts(text):
    assert rules.counted(text)[:5] == brute(text)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{MEDIUM}/documents.parquet'")
    rel = con.execute(rules.SQL)
    names = [c[0] for c in rel.description]
    want = sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: r["doc_id"])
    assert [r.asDict() for r in rules.query(spark, MEDIUM).orderBy("doc_id").collect()] == want


def test_distance():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([[0.0, 1.0], [0.5, 0.5]])
    assert rules.distances(p, q).tolist() == [1.0, 0.0]


def test_keeps_good_and_drops_junk(spark):
    judged = rules.query(spark, MEDIUM).where("not base_failed").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in judged.selectExpr("quality", "cast(kept as double) as kept").groupBy("quality").avg("kept").withColumnRenamed("avg(kept)", "kept").collect()}
    assert share[1] > 0.97 and share[0] < 0.15


def test_references_change_smoothly_with_size(spark):
    """A language of 19, 20 or 21 documents has nearly the same reference; brute force in numpy."""
    texts = {"xx": " ".join(f"alpha{i % 40} the of" for i in range(40)), "en": " ".join(f"Beta{i}, zu{i} der und" for i in range(40))}
    seen = []
    for n in (19, 20, 21):
        rows = [(i, texts["xx"], "xx") for i in range(n)] + [(100 + i, texts["en"], "en") for i in range(80)] + [(999, texts["en"], "xx"), (1000, texts["en"], None)]
        got = {r.doc_id: r.word_distance for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        p = {k: rules._proportions(np.frombuffer(rules.counted(t)[5], "<i4")[None])[0] for k, t in texts.items()}
        pooled = (n * p["xx"] + 82 * p["en"]) / (n + 82)
        own = (n * p["xx"] + p["en"] + rules.PRIOR * pooled) / (n + 1 + rules.PRIOR)
        k = len(rules.CLASSES)
        assert abs(got[999] - rules.distances(p["en"][None, k:], own[None, k:])[0]) < 1e-12
        assert abs(got[1000] - rules.distances(p["en"][None, k:], pooled[None, k:])[0]) < 1e-12
        seen.append(got[999])
    assert max(seen) - min(seen) < 0.02


def test_edge_cases(spark, edge, empty):
    got = rules.judged(edge).collect()
    assert len(got) == 12 and not any(r.kept for r in got if r.n_words < 50)
    long = {r.doc_id: r.n_words for r in got if r.doc_id in (6, 7)}
    assert long == {6: 120_000, 7: 120_001} and len({(r.n_words, r.char_distance, r.kept) for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert rules.judged(empty).count() == 0
