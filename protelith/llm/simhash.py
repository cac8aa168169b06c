"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are cut into 32-bit segments. Two fingerprints that differ in at most
``3 * segments - 1`` bits agree in some segment up to two bits, and two segment values that differ in
at most two bits share a point that is at most one bit from either. So every fingerprint enters the
table under the 33 points of the radius-one ball around each of its segments, fetches what else is
stored there, and the complete distance is verified. Equal fingerprints are collapsed
before, so groups of copies, however large, enter once.

Groups of near-equal fingerprints aren't enumerated: first each fingerprint is compared with the one of the smallest
doc_id at each of its points; then only fingerprints at one point that are still in different components are compared with each other.

Rows: a null or word-less text has fingerprint zero. A null ``doc_id`` keeps its row; its component is
that of its fingerprint, if any row with an id has it, else null. Repeated rows stay repeated, ties go to the smallest doc_id. Texts
of any length are read whole; an empty table gives an empty result; extra columns are left out of ``near_duplicates`` and stay in
``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, possibly_among, release

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK = 1 << 15  # shingles counted at a time
SEGMENT_BITS = 32


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second, independent-looking hash of each 64-bit hash (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 4, lanes: int = 1) -> list[int]:
    """``lanes`` signed 64-bit fingerprints of a text's word shingles; bit i is set if it is in over half the hashes."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return [0] * lanes
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1:]) if len(words) >= shingle else [(0, len(line) + 1)]
    n, counts = 0, np.zeros((lanes, 64), np.int64)
    hashes = np.fromiter((digest(line[a:b - 1], 42) for a, b in spans), np.uint64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at:at + BLOCK]
        n += len(h)
        for lane in range(lanes):
            counts[lane] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            h = _mixed(h) if lane + 1 < lanes else h
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def with_fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, text: str = "text", out: str = "fp") -> DataFrame:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        found = pd.Series([fingerprint(t, shingle, lanes) for t in texts], dtype=object)
        release()
        return found

    return docs.withColumn(out, of(text))


def _points(classes: DataFrame, lanes: int) -> DataFrame:
    """point (with its segment's number), node and the lanes f0, f1, ... of every fingerprint of ``classes`` (node, fp)."""
    segments = lanes * 64 // SEGMENT_BITS
    part = lambda s: F.shiftrightunsigned(F.col("fp")[s // 2], 32 * (s % 2)).bitwiseAND(0xFFFFFFFF).bitwiseOR(s << 32)
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])
    each = classes.select("node", *[F.col("fp")[i].alias(f"f{i}") for i in range(lanes)], F.explode(F.array(*[part(s) for s in range(segments)])).alias("own"))
    return each.withColumn("mask", F.explode(masks)).withColumn("point", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")


def met_at_points(classes: DataFrame, max_bits: int, lanes: int) -> DataFrame:
    """point, node, lanes and low, the smallest node there, for every point that several fingerprints store."""
    segments = lanes * 64 // SEGMENT_BITS
    if max_bits > 3 * segments - 1:
        raise ValueError(f"{segments} segments find at most {3 * segments - 1} differing bits")
    points = _points(classes, lanes)
    shared = cut(points.groupBy("point").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("point", "low"))
    return cut(possibly_among(points, "point", shared.select("point")).join(shared, "point"))


def _near(left: str, right: str, max_bits: int, lanes: int) -> Column:
    bits = [F.bit_count(F.col(f"{left}.f{i}").bitwiseXOR(F.col(f"{right}.f{i}"))) for i in range(lanes)]
    return sum(bits[1:], bits[0]) <= max_bits


def links_to_least(met: DataFrame, classes: DataFrame, max_bits: int, lanes: int) -> DataFrame:
    """Pairs (a, b) of the smallest node of a point and another one there, at most ``max_bits`` apart."""
    low = classes.select(F.col("node").alias("least"), *[F.col("fp")[i].alias(f"f{i}") for i in range(lanes)]).alias("l")
    pairs = met.where("node <> low").alias("m").join(low, F.col("m.low") == F.col("l.least"))
    return cut(pairs.where(_near("m", "l", max_bits, lanes)).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())


def linked(classes: DataFrame, max_bits: int, lanes: int = 1) -> DataFrame:
    """(node, root) of every node of ``classes`` (node, fp) that is at most ``max_bits`` from another; root is the smallest node reachable."""
    met = met_at_points(classes, max_bits, lanes)
    first = links_to_least(met, classes, max_bits, lanes)
    roots = components(first)
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("point").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("point")
    left = cut(rooted.join(apart, "point", "left_semi"))
    a, b = left.alias("a"), left.alias("b")
    on = (F.col("a.point") == F.col("b.point")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    more = cut(a.join(b, on & _near("a", "b", max_bits, lanes)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    return roots if more.isEmpty() else components(first.unionByName(more))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, lanes: int = 1,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (array of signed 64-bit lanes), component_id (the smallest doc_id reachable over links) for every row."""
    prints = cut(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle, lanes).drop("text"))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = linked(cut(classes.where("node is not null")), max_bits, lanes)
    roots = classes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, one with the smallest doc_id; rows without an id stay.

    Groups are the components of all pairs of at least the similarity over word shingles. Fingerprints of those shingles bring the nearest
    pairs together first; pairs that 64 bits can't tell from others are found by an exact join over shingles (see ``similar``).
    Rows are judged by their own text, whatever other rows have the same doc_id; which of several rows of equal doc_id and text stays is
    left open.
    """
    from .similar import similar_components

    body = F.coalesce(F.col(text), F.lit(""))
    keys = [F.xxhash64(body).alias("_k1"), F.xxhash64(F.lit(1), body).alias("_k2")]
    known = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stay = (similar_components(known, shingle, similarity).groupBy("component_id").agg(F.min(F.struct("doc_id", "_k1", "_k2")).alias("s"))
            .select(F.col("s.doc_id").alias("_stays"), F.col("s._k1").alias("_s1"), F.col("s._k2").alias("_s2")))
    keyed = docs.where(F.col(doc_id).isNotNull()).select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), *keys)
    kept = keyed.join(stay, (keyed["doc_id"] == stay["_stays"]) & (keyed["_k1"] == stay["_s1"]) & (keyed["_k2"] == stay["_s2"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_k1", "_k2"]).select("row.*").unionByName(docs.where(F.col(doc_id).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
