import struct
import zlib

import xxhash

from protelith.llm import sharding

from .conftest import SMALL


def test_law_and_slots(spark, plain):
    rows = sharding.query(spark, SMALL).collect()
    text = dict(plain)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots = {}
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
        assert r.grown_shard in (r["shard"], 16) and r.law == "key"
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash of those before as its seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if v >= 1 << 31 or isinstance(v, Id) else "<i", v), h)
    return h - (1 << 64) if h >> 63 else h


class Id(int):
    """A 64-bit number."""


def test_places_match_brute_force(spark, plain, documents):
    got = {r.doc_id: r for r in sharding.external_shuffle(documents, 5, bucket_bytes=20_000).collect()}
    total = sum(len(t.encode()) + 1 for _, t in plain)
    each, sizes, text = max(1, -(-total // (5 * 20_000))), {}, dict(plain)
    for i, t in plain:
        law = lambda n: max(range(n), key=lambda s: spark_hash(sharding.SEED, s, Id(i)))  # noqa: B023, E731
        shard = law(5)
        bucket = shard * each + spark_hash(sharding.SEED + 1, Id(i), t) % each
        assert (got[i]["shard"], got[i].bucket, got[i].grown_shard) == (shard, bucket, law(6))
        sizes[bucket] = sizes.get(bucket, 0) + 1
    assert len(sizes) > 10 and len(text) == len(got)
    for bucket, n in sizes.items():
        first = sum(k for b, k in sizes.items() if b // each == bucket // each and b < bucket)
        assert sorted(r.slot for r in got.values() if r.bucket == bucket) == list(range(first, first + n))


def test_many_buckets_and_repeatability(spark, documents):
    place = lambda: {r.doc_id: (r["shard"], r.slot) for r in sharding.external_shuffle(documents, 3, bucket_bytes=20_000).collect()}
    first = place()
    assert first == place()
    assert sharding.external_shuffle(documents, 3, bucket_bytes=20_000).select("bucket").distinct().count() > 9
    by_slot = sorted(first, key=lambda i: first[i])
    assert by_slot != sorted(by_slot)
    again = {r.doc_id: r["shard"] for r in sharding.external_shuffle(documents.limit(50), 3).collect()}
    assert all(first[i][0] == s for i, s in again.items())


def test_written_shards(spark, documents, tmp_path):
    shuffled = sharding.external_shuffle(documents, 2, bucket_bytes=50_000)
    sharding.write_shards(shuffled, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == documents.count()


def test_edge_cases(spark, edge, empty):
    rows = sharding.external_shuffle(edge, 4, carry=("lang", "fp")).collect()
    assert len(rows) == 12
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.external_shuffle(empty).count() == 0
