"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; where that is unset, a temporary one on a
    single machine, and an error on a cluster, whose machines would not see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="protelith-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def possibly_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``keys``, and a few more: those that share a bit of its bitmap.

    The bitmap, of 2 ** ``BITMAP_BITS`` bits whatever the number of keys, is broadcast; it spares the shuffle of most rows that a join by
    the key would drop anyway.
    """
    last = (1 << BITMAP_BITS) - 1
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    at = F.xxhash64(F.col(keys.columns[0])).bitwiseAND(last)
    bitmap = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_slot")).agg(F.bit_or(bit(F.col("_at"))).alias("_mask"))
    here = F.xxhash64(F.col(key)).bitwiseAND(last)
    return (rows.withColumn("_at", here).join(F.broadcast(bitmap), F.shiftright("_at", 6) == F.col("_slot"))
            .where(F.col("_mask").bitwiseAND(bit(F.col("_at"))) != 0).drop("_at", "_slot", "_mask"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets the session's Arrow batches to ``rows``: whole texts in batches of the default size take much memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def release() -> None:
    """Gives memory that a Python worker no longer needs back to the system; idle workers count against the executor, too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternates large-star and small-star steps, whose edge count never grows, until the edge set
    stops changing. Hubs are met by aggregation and shuffled joins only, so a node with very many
    links costs partial sums and a splittable join. Raises if ``max_rounds`` do not suffice.
    """
    def halves(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")

    cur = cut(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
              .where("a < b").distinct())
    last = None
    for _ in range(max_rounds):
        both = halves(cur)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = (large.join(low, large.b == low.u)
                 .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")),
                                           F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
                 .select("e.*").where("a < b").distinct())
        cur = cut(small)
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == state:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return cur.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
