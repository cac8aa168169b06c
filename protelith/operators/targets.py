"""Targets: class indexes and weights, masks, sample joins, interactions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import INTERACTIONS


def class_index(labels: DataFrame, column: str = "label") -> DataFrame:
    """label, index from 0 in sorted order, over all rows."""
    distinct = labels.where(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return distinct.withColumn("index", F.row_number().over(Window.orderBy("label")) - 1)


def class_weights(train: DataFrame, classes: DataFrame, column: str = "label") -> DataFrame:
    """label, n and weight n_all / (classes present * n); weight 1 for classes absent from ``train``."""
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    return (classes.select("label").join(counts, "label", "left").join(F.broadcast(totals))  # one row
            .select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("all") / (F.col("k") * F.col("n")), F.lit(1.0)).alias("weight")))


def exploded_residues(records: DataFrame, labels: str = "labels", mask: str | None = "mask_bits") -> DataFrame:
    """A row per residue: its position and label; masked residues have a null label."""
    value = F.col("_label")
    if mask:
        value = F.when(F.col(mask).isNull() | (F.get(F.col(mask), F.col("position")) == 1), value)
    return records.select("*", F.posexplode(labels).alias("position", "_label")).withColumn("label", value).drop("_label")


def labelled(rows: DataFrame, column: str = "label") -> DataFrame:
    """The rows with a target; raises if there is none."""
    found = rows.where(F.col(column).isNotNull())
    if found.isEmpty():
        raise ValueError("no row has a target")
    return found


def samples(split: DataFrame, embeddings: DataFrame, targets: DataFrame, key: str = "seq_hash") -> DataFrame:
    return split.join(embeddings, key).join(targets, key)


def without_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def with_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def canonical_edges(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Undirected pairs (a, b), a <= b, with the number of rows and of distinct targets; more than one target is a violation."""
    return (edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), "target")
            .groupBy("a", "b").agg(F.count("*").alias("n_rows"), F.countDistinct("target").alias("n_targets"), F.min("target").alias("target")))


def interaction_embeddings(edges: DataFrame, embeddings: DataFrame, how: str, key: str, vector: str = "embedding") -> DataFrame:
    """Edges (a, b, ...) with both ends' vectors combined."""
    of = lambda side: embeddings.select(F.col(key).alias(side), F.col(vector).alias(f"_{side}"))
    return edges.join(of("a"), "a").join(of("b"), "b").withColumn(vector, INTERACTIONS[how](F.col("_a"), F.col("_b"))).drop("_a", "_b")


def collapse_residues(predictions: DataFrame, key: str, position: str, value: str, delimiter: str = "") -> DataFrame:
    """Per sequence its residues' predictions in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("string").alias("v"))))
    return predictions.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), delimiter).alias("prediction"))


def back_to_ids(predictions: DataFrame, ids: DataFrame) -> DataFrame:
    """Predictions by hash with the original id, or the hash where there is none."""
    return predictions.join(ids, "seq_hash", "left").withColumn("seq_id", F.coalesce("seq_id", "seq_hash"))
