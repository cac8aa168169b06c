import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from protelith.llm import passages

from .conftest import MEDIUM, SCHEMA, SMALL


def brute(rows):
    """The contract, window by window."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - 49) if d is not None else ():
            k = tuple(w[i:i + 50])
            least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49) if d is not None else ():
            if least[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = [True] * 50
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in passages.remove_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("where", [SMALL, MEDIUM])
def test_query_equals_brute_force(spark, where):
    got = sorted((tuple(r) for r in passages.query(spark, where).collect()), key=repr)
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()])
    assert got == want and sum(0 < r[2] < r[1] for r in want) > 5 and sum(0 < r[2] == r[1] for r in want) > 5


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == brute(rows)
    assert passages.remove_passages(empty).collect() == []


def test_overlaps_repeats_within_and_ids_beyond_doubles(spark):
    """A document that repeats itself, windows that differ in one word, ties of doc_id, ids that a double can't hold beside a null."""
    w = [f"w{i}" for i in range(400)]
    j = " ".join
    big = (1 << 53) + 1
    rows = [(big, j(w[:120])), (big + 2, j(w[:120])), (None, j(w[:120])), (3, j(w[50:150] + w[50:150])), (3, j(w[60:130])), (4, j(w[:49])), (5, j(w[100:149] + ["x"] + w[150:260])),
            (6, j(w[140:330])), (7, j(["a"] * 300)), (8, j(["a"] * 60)), (9, j(w[200:249])), (10, "\n".join(w[200:250])), (2, j(w[149:200] + ["y"] + w[210:270]))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert found(df) == brute(rows)


def test_spans_and_texts(spark):
    w = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(w[:100])), (2, " ".join(w[20:150])), (3, " ".join(w[100:]))], "doc_id long, text string")
    rows = {r.doc_id: r for r in passages.remove_passages(df).collect()}
    assert rows[1].spans is None and rows[1].kept is None
    assert rows[2].spans == [80] and rows[2].kept == " ".join(w[100:150])
    assert rows[3].n_removed == 50 and rows[3].kept == " ".join(w[150:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=50, max_size=300), st.integers(50, 120))
def test_equal_windows_have_equal_anchors(letters, match):
    """Each window lies in one stretch; the anchor and its place depend on the window alone."""
    h = passages._hashed([b"%d" % x for x in letters])
    if len(h) < match:
        return
    seen = {}
    starts = []
    for anchor, _, first, last, windows, base in passages.stretches(h, match):
        for a, f, l in zip(anchor, first, last):
            starts += range(f, l + 1)
            for s in range(f, l + 1):
                assert seen.setdefault(tuple(letters[s:s + match]), (a, windows[s - base])) == (a, windows[s - base])
    assert starts == list(range(len(h) - match + 1))


def test_segments_do_not_change_the_result(spark, monkeypatch, plain):
    raw = " ".join(f"x{i % 611}" for i in range(5000)).encode()
    whole = [w for part in passages.words_of(raw) for w in part]
    monkeypatch.setattr(passages, "SEGMENT_BYTES", 97)
    assert [w for part in passages.words_of(raw) for w in part] == whole == raw.split()
    h = passages._hashed(whole)
    full = np.concatenate([x[4] for x in passages.stretches(h)])
    monkeypatch.setattr(passages, "SEGMENT_WORDS", 64)
    assert np.array_equal(np.concatenate([x[4][:64] for x in passages.stretches(h)]), full)
