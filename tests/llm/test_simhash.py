import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from protelith.llm import common, simhash, similar

from .conftest import MEDIUM, SMALL


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, bits):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, plain):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SMALL).collect()}
    prints = {i: brute_fingerprint(t) for i, t in plain}
    component = brute_components(prints, 4)
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in prints}


def roots(spark, prints, bits, lanes=1):
    signed = [[int(np.uint64(p >> 64 * i & (1 << 64) - 1).view(np.int64)) for i in range(lanes)] for p in prints]
    found = {r.node: r.root for r in simhash.linked(spark.createDataFrame(list(enumerate(signed)), "node long, fp array<long>"), bits, lanes).collect()}
    return {i: found.get(i, i) for i in range(len(prints))}


def test_every_pair_within_reach_is_linked(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    flips = ([0], [1, 2], [3, 40], [0, 1, 33], [5, 6, 37, 63], [31, 32, 0, 63], [1, 2, 3, 4, 5], [60, 61, 62, 63, 0, 1], range(20))
    apart = [int(x) for x in rng.integers(1 << 62, size=12)]
    prints = [base, *(p ^ sum(1 << b for b in f) for p, f in zip(apart, flips)), *apart, *(int(x) for x in rng.integers(1 << 62, size=30))]
    assert roots(spark, prints, 4) == brute_components(dict(enumerate(prints)), 4)


def test_groups_whose_least_member_is_far_from_some(spark):
    """Members of a point that only meet others than its smallest one."""
    rng = np.random.default_rng(5)
    bases, prints = [int(x) for x in rng.integers(1 << 62, size=4)], []
    for _ in range(160):
        p = bases[int(rng.integers(4))]
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            p ^= 1 << int(b)
        prints.append(p)
    prints = list(dict.fromkeys(prints))
    assert roots(spark, prints, 4) == brute_components(dict(enumerate(prints)), 4)


def test_two_lanes_reach_eleven_bits(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.integers(0, 2, 128)
    for n in [0, 3, 7, 10, 11, 12, 30]:
        bits = base.copy()
        bits[rng.choice(128, n, replace=False)] ^= 1
        rows.append(int("".join(map(str, bits)), 2))
    want = brute_components(dict(enumerate(rows)), 11)
    assert roots(spark, rows, 11, 2) == want and [want[i] for i in (1, 2, 3, 4)] == [0] * 4


def test_bitmap_keeps_all_keys(spark):
    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    got = {r.id for r in common.possibly_among(spark.range(1000), "id", keys).collect()}
    assert set(range(0, 1000, 7)) <= got and len(got) < 200


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3)]
    got = defaultdict(set)
    for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.root].add(r.node)
    assert got == {0: set(range(41)), 100: set(range(100, 140))}


def test_edge_cases(spark, edge, empty):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(edge).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 1), (None, 3), (6, 6), (7, 6), (8, 8), (9, 9)], key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 8, 9]
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_one_row_of_a_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(1, one), (1, one), (2, one), (3, other), (3, one), (None, one), (None, one), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _k1", "2 AS root", "3 AS key")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text == one) for r in kept.collect()) == [(0, True), (0, True), (1, True), (3, False)]


def test_stage_leaves_unlike_documents(spark):
    words = [f"w{i}" for i in range(400)]
    near = words.copy()
    near[200] = "changed"
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [3, 4]
    assert docs.select(F.count("*")).first()[0] == 4


def brute_similar(docs, k=5):
    """The kept ids by comparing every pair of shingle sets that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for i, t in docs:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        for g in sets[i]:
            holders[g].append(i)
    shared, pairs = defaultdict(int), set()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1:]:
                shared[min(a, b), max(a, b)] += 1
    for (a, b), o in shared.items():
        if 5 * o >= 4 * (len(sets[a]) + len(sets[b]) - o):
            pairs.add((a, b))
    blank = sorted(i for i in sets if not sets[i])
    return sets, pairs | set(zip(blank, blank[1:]))


def closed(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


def test_stage_reaches_all_pairs_of_four_fifths(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    sets, pairs = brute_similar([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs.select("doc_id", "text")).collect()}
    assert {(1, 255), (255, 278), (255, 615), (643, 770), (709, 944), (582, 875)} <= pairs
    assert got == closed(sets, pairs)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()} == {i for i, c in got.items() if i == c}


def test_one_word_in_fifty(spark):
    words = [f"w{i}" for i in range(50)]
    one, two = words.copy(), words.copy()
    one[25], two[20], two[30] = "x", "y", "z"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(one)), (3, " ".join(two))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3]


def test_chains_over_groups_are_closed(spark):
    """Members that only meet a later one of a group, and groups that only their members link."""
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in rng.permutation(40).tolist():
        rows.append((i, " ".join(words)))
        words = words.copy()
        words[int(rng.integers(60))] = f"v{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, pairs = brute_similar(rows)
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs).collect()}
    assert got == closed(sets, pairs) and len(set(got.values())) < 40


def test_unlike_near_copies_make_few_rows(spark, monkeypatch):
    """Of 500 members that lie at 0.5 to 0.8 of each other, pairs are not made into rows."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for d in range(500):
        words = list(base)
        for p in r.sample(range(160), r.randint(3, 5)):
            words[p] = f"x{d}y{p}"
        rows.append((d, " ".join(words)))
    docs, made, real = spark.createDataFrame(rows, "doc_id long, text string"), [], similar.met_apart

    def counted(*given):
        pairs = real(*given).cache()
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(similar, "met_apart", counted)
    got = {x.doc_id: x.component_id for x in similar.similar_components(docs).collect()}
    sets, pairs = brute_similar(rows)
    assert got == closed(sets, pairs) and made[0] < 2 * 500 < 500 * 499 / 200
