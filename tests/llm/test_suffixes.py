import hashlib
import random

import numpy as np
import pytest

from protelith.llm import suffixes

from .conftest import SMALL


def brute(docs):
    """doc -> (n_bytes, n_removed, n_spans, sha) by looking at every string."""
    first, out = {}, {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            first[s] = min(first.get(s, i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()
    return out


def found(spark, docs):
    df = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, hashlib.sha256(bytes(r._kept)).hexdigest()) for r in df.collect()}


def test_query_matches_brute_force(spark, plain):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.query(spark, SMALL).collect()}
    assert got == brute(plain)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    pool = "".join(rng.choices("ab é", k=900))
    docs = []
    for i in range(40):
        parts = ["".join(rng.choices("abcdé ", k=rng.randrange(120)))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(850)
            parts += [pool[a:a + rng.randrange(20, 300)], "".join(rng.choices("xyz", k=rng.randrange(4)))]
        docs.append((rng.randrange(1000) * 50 + i, "".join(parts)))
    docs += [(90_001, "a" * 200), (90_002, "a" * 120), (90_003, "b" + "a" * 49), (90_004, "a" * 49), (90_005, docs[3][1]), (90_006, docs[3][1])]
    assert found(spark, docs) == brute(docs)


def test_many_ranges(spark, plain, monkeypatch):
    monkeypatch.setattr(suffixes, "NAMES_PER_RANGE", 500)
    monkeypatch.setattr(suffixes, "STRINGS_PER_RANGE", 300)
    assert found(spark, plain) == brute(plain)


def test_cover_is_decided_by_the_string():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    name, _, first, last = suffixes.cover(data, np.array([0]), np.array([3000]))
    assert first[0] == 0 and last[-1] == 2950 and (first[1:] == last[:-1] + 1).all()
    for at in (0, 17, 500, 2950):
        alone, *_ = suffixes.cover(data[at:at + 50].copy(), np.array([0]), np.array([50]))
        assert alone[0] == name[np.searchsorted(last, at)]


def test_edge_cases(spark, edge, empty):
    got = suffixes.remove_repeats(edge)
    rows = got.collect()
    assert set(got.columns) == (set(edge.columns) - {"text"}) | {"_n_bytes", "_n_removed", "_n_spans", "_kept"}
    assert got.select("_version", "_text", "version", "bucket", "home").distinct().collect() == [("_version", "_text", "version", "bucket", "home")]
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 12 and by[1]._n_removed == 0 and by[2]._n_removed == by[2]._n_bytes == 87
    assert sum(r._n_removed for r in rows if r.doc_id is None) == 0 and by[7]._n_bytes - by[7]._n_removed <= len(" tail")
    assert suffixes.remove_repeats(empty).count() == 0


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffle files so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once_and_compressed(spark, monkeypatch):
    # a fifth of each text recurs; words drawn from many, so that texts shrink by little
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(5000)]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=240)) + rng.choice(shared)) for i in range(1500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    packed = sum(len(x) for x in suffixes._pack([t.encode() for _, t in docs]))
    before = shuffled(spark)
    rows = suffixes.remove_repeats(frame).select("doc_id", "_n_removed").collect()
    assert sum(r._n_removed > 0 for r in rows) == 1460
    assert shuffled(spark) - before < 2.5 * packed


def test_names_lose_only_their_lower_bytes():
    names = np.random.default_rng(2).integers(1 << 63, size=50, dtype=np.uint64)
    got = suffixes._received([suffixes._sent(names[:20]), suffixes._sent(names[20:20]), suffixes._sent(names[20:])])
    assert (got == names & suffixes.SENT).all() and suffixes.SEVERAL & suffixes.SENT == suffixes.SEVERAL


def test_repeated_rows_and_ids_with_several_texts(spark):
    long = "a stretch of text that is longer than fifty bytes and stands in more than one row; "
    docs = [(1, long), (2, "first " + long), (2, "first " + long), (2, "second, " + long + "tail"), (3, "short"), (None, long), (None, long), (4, long)]
    rows = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r._n_bytes, r._n_removed, bytes(r._kept).decode()) for r in rows)
    n = len(long)
    assert got == sorted([(1, n, 0, long), (2, n + 6, n, "first "), (2, n + 6, n, "first "), (2, n + 12, n, "second, tail"), (3, 5, 0, "short"), (0, n, 0, long),
                          (0, n, 0, long), (4, n, n, "")])
