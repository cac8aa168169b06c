"""Components of similar documents: SimHash first, then an exact prefix-filter join over word shingles.

The similarity of two documents is the Jaccard similarity of their sets of word shingles, and every link is verified over
whole sets. Equal sets are collapsed. Then

1. fingerprints of the shingles are met by multi-index hashing (``simhash``), and each document is compared with the smallest within
   ``MAX_BITS`` bits, and with the smallest that it meets in the second step: that joins the nearest copies with one comparison for each;
2. all sets are put in one order of shingles, common ones last. Two sets of a similarity of at least s share a shingle
   among the first ``n - ceil(s * n) + 1`` of either, and the first shingle that they share leaves enough behind it on both
   sides; so documents meet under the shingles of their prefixes. Each is compared with the smallest that it meets, unless
   both are in one component already;
3. all pairs that meet and are still in different components are compared.

Before sets are compared, bitmaps of ``SKETCH`` bits are: each bit that only one of them has stands for a shingle that only one set has, so pairs with more
such bits than similar sets allow are dropped without loss; in the last step the join itself does so.

The second and third step are exact for every pair, so groups of near copies are found whole without being enumerated.
Which shingles count as common is found in a sample. It changes the cost only: any order finds every pair.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, possibly_among, release
from .simhash import links_to_least, met_at_points

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MAX_BITS = 5
BLOCK = 1 << 15  # shingles counted at a time
SKETCH = 1024
SAMPLE, OFTEN, COMMON = 16, 3, 200_000  # one document in SAMPLE; a shingle in OFTEN of them is common; at most COMMON are kept


def shingles(text: str | None, length: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, a word-less one has none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    spans = zip([0, *ends], ends[length - 1:]) if len(words) >= length else [(0, len(line) + 1)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b - 1], 42) for a, b in spans), np.uint64).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, s: Fraction) -> np.ndarray:
    """The first shingles of a set, the common ones (sorted) last, as many as the join needs."""
    n = len(found)
    if len(common) and n:
        often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~often], found[often]])
    return found[:n - -(-n * s.numerator // s.denominator) + 1] if n else found


def _common(docs: DataFrame, length: int) -> np.ndarray:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, length) for t in texts], dtype=object)

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode(of("text")).alias("token"))
    often = some.groupBy("token").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(COMMON)
    return np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64))


def _bits(found: np.ndarray) -> int:
    """The signed 64-bit fingerprint of a set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), BLOCK):
        counts += np.unpackbits(found[i:i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view(np.int64)[0])


def _sketch(found: np.ndarray) -> np.ndarray:
    """The bits that the shingles of a set have, as 64-bit integers."""
    bits = np.zeros(SKETCH, np.uint8)
    bits[(found.view(np.uint64) >> np.uint64(17)).astype(np.int64) % SKETCH] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _allowed(a: str, b: str, n: Column, s: Fraction) -> Column:
    """Whether two sketches allow the similarity of sets of ``n`` shingles together."""
    apart = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return (s.numerator + s.denominator) * apart <= (s.denominator - s.numerator) * n


def _possible(pairs: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches allow the similarity; ``sets`` has node, n and sketch."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return cut(both.where(_allowed("sa", "sb", F.col("na") + F.col("nb"), s)).select("a", "b"))


def met_apart(postings: DataFrame, sets: DataFrame, s: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that meet under a token of ``postings`` (token, node, at, root) and may be similar.

    The sketches stand in the join's own condition: of a large group of near copies that are not similar enough, pairs that can't be are never made into rows.
    """
    known = postings.join(sets.select("node", "sketch"), "node")
    a, b = (known.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "at", "root", "sketch")]) for x in "ab")
    size = _place("a_at")[0] + _place("b_at")[0]
    on = ((a["token"] == b["token"]) & (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & _enough(_place("a_at"), _place("b_at"), s)
          & _allowed("a_sketch", "b_sketch", size, s))
    return a.join(b, on).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _enough(a: tuple[Column, Column], b: tuple[Column, Column], s: Fraction) -> Column:
    """Whether what is left in both sets (size, place) from the shingle on where they meet can make them similar."""
    left = F.least(a[0] - a[1], b[0] - b[1])
    return (s.numerator + s.denominator) * left >= s.numerator * (a[0] + b[0])


def _place(packed: str) -> tuple[Column, Column]:
    return F.shiftright(packed, 32), F.col(packed).bitwiseAND(0xFFFFFFFF)


def _verified(pairs: DataFrame, docs: DataFrame, length: int, s: Fraction) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole sets are similar."""
    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, x = [], None, None
        for a, b in zip(left, right):
            x, last = (x if a == last else shingles(a, length)), a
            y = shingles(b, length)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append((s.numerator + s.denominator) * both >= s.numerator * (len(x) + len(y)))
        release()
        return pd.Series(out, dtype=bool)

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = possibly_among(docs, "node", nodes)
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return cut(pairs.join(right, "b").join(left, "a").where(similar("ta", "tb")).select("a", "b"))


def _joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b) of nodes: only the roots that they join are met again, however many links there are."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    between = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    above = components(between)
    fresh = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    top = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(roots.unionByName(fresh).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, _k1, _k2 (hashes of the text), component_id (the smallest doc_id reachable over similar pairs) for every row of ``docs`` (doc_id, text).

    No doc_id is null. Texts without a word are copies of each other.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", "text", F.xxhash64(body).alias("_k1"), F.xxhash64(F.lit(1), body).alias("_k2"))
    s = Fraction(str(similarity))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    @F.pandas_udf("key binary, n long, bits long, sketch array<long>, prefix array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, shingle) for t in texts]
        found = pd.DataFrame({"key": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "n": [len(x) for x in sets], "bits": [_bits(x) for x in sets],
                              "sketch": [_sketch(x) for x in sets], "prefix": [prefix(x, common.value, s) for x in sets]})
        release()
        return found

    prints = cut(docs.select("doc_id", "_k1", "_k2", of("text").alias("p")).select("doc_id", "_k1", "_k2", "p.*"))
    # A set's node is a number of its own, not a doc_id, as rows of one doc_id may have several texts.
    classes = cut(prints.groupBy("key").agg(F.min(F.struct("doc_id", "_k1", "_k2")).alias("r")).select("key", "r.*")
                  .withColumn("node", F.xxhash64("doc_id", "_k1", "_k2")))
    row = ["doc_id", "_k1", "_k2"]
    texts = docs.withColumn("node", F.xxhash64(*row)).select("node", "text")
    first = prints.join(classes.select(*row, "node"), row)  # repeated rows give a node twice, which adds no link

    sets = cut(first.select("node", "n", "sketch").distinct())
    nodes = cut(first.select("node", F.array("bits").alias("fp")))
    near = links_to_least(met_at_points(nodes, MAX_BITS, 1), nodes, MAX_BITS, 1)

    postings = first.select("node", F.shiftleft("n", 32).alias("n"), F.posexplode("prefix").alias("pos", "token")).select("token", "node", F.col("n").bitwiseOR(F.col("pos").cast("long")).alias("at"))
    shared = cut(postings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "low"))
    met = cut(possibly_among(postings, "token", shared.select("token")).join(shared, "token"))
    of_low = met.where("node = low").select("token", F.col("at").alias("low_at"))
    ahead = met.where("node <> low").join(of_low, "token").where(_enough(_place("at"), _place("low_at"), s))
    ahead = cut(ahead.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    one_each = lambda pairs: pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(_possible(one_each(near).unionByName(one_each(ahead)).distinct(), sets, s), texts, shingle, s)
    roots = components(links)

    rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    others = ahead.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    roots = _joined(roots, _verified(_possible(others, sets, s), texts, shingle, s))

    placed = rooted(met.select("token", "node", "at"))
    apart = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("token")
    apart = cut(placed.join(apart, "token", "left_semi"))
    rest = cut(met_apart(apart, sets, s).join(ahead, ["a", "b"], "left_anti"))
    found = _joined(roots, _verified(rest, texts, shingle, s))
    top = classes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = top.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return prints.select(*row, "key").join(top.select("key", "root").join(least, "root"), "key").select(*row, "component_id")
