"""Two-pass external shuffle into a fixed number of shards, with DataFrame functions only.

Pass one scatters the records into memory-sized buckets by seeded hashes; pass two puts each bucket
into a canonical order, applies Fisher-Yates (Spark's seeded ``shuffle`` of an array) and lays the
buckets of a shard end to end. The shard obeys the law ``key``: the highest of one seeded hash per
shard number wins, so doc_id and the shard count alone decide, and a further shard takes rows only
into itself.

Rows: null texts count as empty; a null doc_id is hashed as such; repeated rows and equal ids stay
and get slots of their own. Rows equal in doc_id and text share a bucket; all others spread. A text of any length is one row of its bucket.
An empty table gives an empty result. Columns beyond id and text are left out unless carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20240229


def key_shard(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard, from 0, whose seeded hash of ``doc_id`` is highest."""
    scores = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), doc_id) for s in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def external_shuffle(docs: DataFrame, shards: int = 16, bucket_bytes: int = 4 << 20, seed: int = SEED,
                     doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and ``carry`` with shard int, grown_shard int, bucket long and slot long (gapless from 0 in a shard).

    ``bucket_bytes`` is what a bucket holds on average; the number of buckets grows with the input.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carry)
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    each = max(1, math.ceil(total / shards / bucket_bytes))
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(each))
    placed = (rows.withColumn("shard", key_shard(F.col("doc_id"), shards, seed))
              .withColumn("bucket", F.col("shard").cast("long") * each + spread))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    held = F.struct(F.xxhash64(F.lit(seed + 2), "doc_id", "text").alias("h"), "doc_id", "text", *carry)
    gathered = (placed.repartition(min(shards * each, 100_000), "bucket")
                .groupBy("bucket").agg(F.sort_array(F.collect_list(held)).alias("held"))
                .sortWithinPartitions("bucket"))
    mixed = gathered.select("bucket", F.posexplode(F.shuffle("held", F.lit(seed))).alias("at", "row"))
    return (mixed.join(offsets.hint("shuffle_hash"), "bucket")
            .select("row.doc_id", "row.text", *[F.col(f"row.{c}") for c in carry],
                    F.floor(F.col("bucket") / each).cast("int").alias("shard"), "bucket",
                    (F.col("first") + F.col("at")).alias("slot"))
            .withColumn("grown_shard", key_shard(F.col("doc_id"), shards + 1, seed)))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; within it a file per bucket, in slot order. Buckets in name order give the shard's order."""
    (shuffled.withColumn("part", F.format_string("%012d", "bucket"))
     .repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "slot")
     .write.partitionBy("shard", "part").parquet(path))


def query(spark, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return external_shuffle(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard")
