"""Validation: each check returns the rows that violate it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sequence_hash
from ..functions.sequences import set_name


class Violation(ValueError):
    """Input that a check rejects."""


def raise_on_violation(found: DataFrame, what: str, show: int = 5) -> None:
    rows = found.limit(show).collect()
    if rows:
        raise Violation(f"{what}: {[r.asDict() for r in rows]}")


def duplicate_hashes(records: DataFrame) -> DataFrame:
    return records.groupBy(sequence_hash(F.col("seq"), F.col("seq_id")).alias("seq_hash")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_sequences(records: DataFrame) -> DataFrame:
    return records.where("seq is not null and seq <> ''").groupBy("seq").agg(F.count("*").alias("n")).where("n > 1")


def bad_letters(records: DataFrame, seq: str = "seq", allowed: str = "a-zA-Z") -> DataFrame:
    """The records with a letter that isn't allowed, and the first such letter."""
    return records.withColumn("bad_letter", F.regexp_extract(seq, f"[^{allowed}]", 0)).where("bad_letter <> ''")


def bad_targets(records: DataFrame, numeric: bool, per_residue: bool) -> DataFrame:
    """Records without a target (but for pred), or with one that can't be read or has another length than its sequence."""
    parts = F.split("target", ";" if numeric else "") if per_residue else F.array("target")
    unread = F.exists(parts, lambda x: x.try_cast("double").isNull()) if numeric else F.lit(False)
    length = F.size(parts) != F.length("seq") if per_residue else F.lit(False)
    problem = (F.when(F.col("set").isNull(), "missing set").when(set_name(F.col("set")) == "pred", None).when(F.col("target").isNull(), "missing target")
               .when(unread, "not a number").when(length, "length differs"))
    return records.withColumn("problem", problem).where("problem is not null")


def embeddings_all_or_none(records: DataFrame) -> DataFrame:
    return records.agg(F.count("embedding").alias("with_embedding"), F.count("*").alias("n")).where("with_embedding not in (0, n)")


def embedding_widths(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """One row per width; more than one is a violation."""
    return embeddings.groupBy(F.size(column).alias("width")).agg(F.count("*").alias("n"))


def other_lengths(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two arrays, such as residues' vectors and labels, differ in length."""
    return rows.where(F.size(left) != F.size(right))


def ids_by_hash(records: DataFrame) -> DataFrame:
    """seq_hash and the sorted ids of the records that have it."""
    key = sequence_hash(F.col("seq"), F.col("seq_id")).alias("seq_hash")
    return records.groupBy(key).agg(F.array_sort(F.collect_list("seq_id")).alias("ids"))


def masks_without_residues(records: DataFrame) -> DataFrame:
    return records.where(F.col("mask").isNotNull() & ~F.col("mask").contains("1"))


def route_sets(records: DataFrame, column: str = "set") -> DataFrame:
    """Adds role: train, val, pred or test, and set_name: the test set's name."""
    name = set_name(F.col(column))
    return records.withColumn("set_name", name).withColumn("role", F.when(name.isin("train", "val", "pred"), name).when(name.isNotNull(), "test"))


def missing_roles(records: DataFrame, needed: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """The needed roles that no record has."""
    counts = route_sets(records).agg(*[F.count_if(F.col("role") == r).alias(r) for r in needed])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("n")) for r in needed])).alias("x")).select("x.*").where("n = 0")


def length_between(low: int, high: int, seq: str = "seq") -> Column:
    return F.length(seq).between(low, high)


def drop_all_duplicates(records: DataFrame, key: str = "seq") -> DataFrame:
    """Only records whose key occurs once: every copy of a repeated one goes."""
    once = records.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return records.join(once, key, "left_semi")


def duplicate_report(records: DataFrame, key: str = "seq", row_id: str = "seq_id", target: str = "target") -> DataFrame:
    """Per repeated key: count, its ids joined by ``;``, its distinct targets or N/A."""
    return (records.groupBy(key).agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(row_id)), lambda x: x.cast("string")), ";").alias("ids"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(F.col(target).cast("string"))), ";"), F.lit("")), F.lit("N/A")).alias("targets"))
        .where("n > 1"))


def unique_by_hash(records: DataFrame, order: str) -> DataFrame:
    """One record per sequence hash, the last by ``order``."""
    key = sequence_hash(F.col("seq"), F.col("seq_id"))
    columns = records.columns
    return (records.withColumn("seq_hash", key).groupBy("seq_hash")
            .agg(F.max_by(F.struct(*columns), F.col(order)).alias("r")).select("seq_hash", "r.*"))


def ranked_once(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
