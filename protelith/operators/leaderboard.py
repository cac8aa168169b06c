"""Rankings: category ranks, group averages, weighted places, report pivots."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ASCENDING


def missing_categories(scores: DataFrame) -> DataFrame:
    """(entry, category) pairs without a score, though another entry has the category: every entry explodes the set of all categories."""
    every = scores.agg(F.collect_set("category").alias("_c"))  # names of benchmarks: one small row
    pairs = scores.select("entry").distinct().join(F.broadcast(every)).select("entry", F.explode("_c").alias("category"))
    return pairs.join(scores.select("entry", "category"), ["entry", "category"], "left_anti")


def category_ranks(scores: DataFrame, ascending: list[str] = ()) -> DataFrame:
    """Adds rank within each category: the worst gets 1, equal ones the same; for ``ascending`` categories small values are good."""
    small_is_good = F.col("category").isin(*ascending, *ASCENDING) if ascending or ASCENDING else F.lit(False)
    good = F.when(small_is_good, -F.col("metric")).otherwise(F.col("metric"))
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("category").orderBy(good)))


def interval_ranks(scores: DataFrame) -> DataFrame:
    """Ranks of interval-valued metrics (mean, lower, upper): in order of mean, an entry ties with its predecessor if the intervals overlap."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mean", "entry"], kind="stable").reset_index(drop=True)
        ranks = []
        for i, (low, high) in enumerate(zip(rows["lower"], rows["upper"])):
            tie = i and low <= rows["upper"][i - 1] and rows["lower"][i - 1] <= high
            ranks.append(ranks[-1] if tie else i + 1)
        return rows.assign(rank=ranks)[["entry", "category", "mean", "lower", "upper", "rank"]]

    return scores.select("entry", "category", "mean", "lower", "upper").groupBy("category").applyInPandas(
        fold, "entry string, category string, mean double, lower double, upper double, rank int")


def group_averages(ranks: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean rank per entry and group; ``groups`` maps category to grp, other categories stand for themselves."""
    return (ranks.join(groups, "category", "left").groupBy("entry", F.coalesce("grp", "category").alias("category")).agg(F.avg("rank").alias("rank")))


def weighted(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """entry, score: sum of rank * (1 + weight / 10)."""
    return (ranks.join(weights, "category", "left").groupBy("entry")
            .agg(F.sum(F.col("rank") * (1 + F.coalesce("weight", F.lit(0)) / 10.0)).alias("score")))


def places(scores: DataFrame) -> DataFrame:
    """Adds place, the highest score first; scores are a row per entry."""
    return scores.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))))


def report_pivot(results: DataFrame, index: list[str], models: list[str]) -> DataFrame:
    return results.groupBy(*index).pivot("model", models).agg(F.first("mean"))


def unpivot_losses(curves: DataFrame, series: list[str]) -> DataFrame:
    return curves.unpivot(["epoch"], series, "series", "loss")


def absolute_interval(mean, lower, upper):
    """|mean| with its bounds, for correlations whose sign doesn't matter."""
    return F.abs(mean), F.least(F.abs(lower), F.abs(upper)), F.greatest(F.abs(lower), F.abs(upper))


def task_label(task, test_set, metric):
    return F.concat(task, F.lit("\n("), F.when(test_set.isNull() | (test_set == "test"), "").otherwise(F.concat(test_set, F.lit(" - "))), metric, F.lit(")"))


def report_uid(name, date, n_supervised, n_zero_shot):
    return F.sha1(F.concat_ws("_", name, date, n_supervised.cast("string"), n_zero_shot.cast("string")).cast("binary"))
