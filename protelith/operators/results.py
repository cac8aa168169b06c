"""Results: losses, averages over splits, curves, task names, reports, and sinks that watch a run."""

import datetime
import hashlib
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import ASCENDING
from .validate import ranked_once


def mean_loss(batches: DataFrame, keys: list[str] = (), loss: str = "loss") -> DataFrame:
    """epoch and the mean of its batches' losses, each batch alike."""
    return batches.groupBy(*keys, "epoch").agg(F.avg(loss).alias("loss"))


def average_over_splits(metrics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """metric and its mean over splits, of rows (split_name, metric, value)."""
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("value"), F.countDistinct("split_name").alias("n_splits"))


def best_of(metrics: DataFrame, choose_by: str = "loss", keys: list[str] = (), name: str = "split_name") -> DataFrame:
    """The row with the best value of ``choose_by``: the least of losses and errors, else the largest; ties go to the smaller name."""
    value = F.col("value") if choose_by in ASCENDING else -F.col("value")
    return ranked_once(metrics.where(F.col("metric") == choose_by), list(keys), [value, F.col(name)])


def set_sizes(records: DataFrame, role: str = "role", name: str = "set_name") -> DataFrame:
    """n of each test set, and of all together as ``total``."""
    return records.where(F.col(role) == "test").groupingSets([[F.col(name)], []], F.col(name)).agg(
        F.grouping(name).alias("_g"), F.count("*").alias("n")).select(F.when(F.col("_g") == 1, "total").otherwise(F.col(name)).alias(name), "n")


def curve(results: DataFrame, keys: list[str], losses: str) -> DataFrame:
    """keys, epoch int, loss of a column that maps epochs as text to losses, one row per epoch."""
    return results.select(*keys, F.explode(losses).alias("_e", "loss")).select(*keys, F.col("_e").try_cast("int").alias("epoch"), "loss").where("epoch is not null")


def stacked(frames: list[DataFrame]) -> DataFrame | None:
    """All frames below each other, null where one lacks a column; None without a frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def task_name(framework: Column, dataset: Column, split: Column | None = None) -> Column:
    return F.concat_ws("-", framework, dataset, *([split] if split is not None else []))


def task_parts(name: Column) -> Column:
    """framework, dataset and split (null if there is none) of a combined name."""
    parts = F.split(name, "-")
    return F.struct(F.get(parts, F.lit(0)).alias("framework"), F.get(parts, F.lit(1)).alias("dataset"), F.get(parts, F.lit(2)).alias("split"))


def with_configuration(tasks: DataFrame, bank: DataFrame, key: str = "dataset") -> DataFrame:
    """Tasks with the configuration that the bank has for their dataset; those without one keep null."""
    return tasks.join(bank, key, "left")


def virus_first(rows: DataFrame, task: str = "task") -> DataFrame:
    """Rows whose task names viruses before the others, as ``virus`` also occurs in ``nonvirus``; then by name."""
    return rows.orderBy(F.desc(F.contains(F.lower(task), F.lit("virus"))), task)


def by_input_id(predictions: DataFrame, ids: DataFrame, key: str = "seq_hash") -> DataFrame:
    """Predictions under the ids of the input, a row per id of a repeated sequence, sorted by id."""
    return ids.select(key, "seq_id").join(predictions, key).orderBy("seq_id")


def labels_of(predictions: DataFrame, classes: DataFrame, index: str = "pred") -> DataFrame:
    """Class indexes back to labels."""
    return predictions.join(classes.select(F.col("label").alias("_label"), F.col("index").alias(index)), index, "left").withColumn(index, F.col("_label")).drop("_label")


def with_taxon(assays: DataFrame, reference: DataFrame, key: str = "assay") -> DataFrame:
    """Assays with ``taxon`` and ``grp``: virus or nonvirus."""
    grp = F.when(F.lower("taxon") == "virus", "virus").otherwise("nonvirus")
    return assays.join(reference.select(key, "taxon"), key).withColumn("grp", grp)


def unmatched(assays: DataFrame, reference: DataFrame, key: str = "assay") -> DataFrame:
    """key and side: assays without a taxon, and references without an assay. Any row is a violation."""
    a, r = assays.select(key).distinct(), reference.select(key).distinct()
    return a.join(r, key, "left_anti").withColumn("side", F.lit("no taxon")).unionByName(r.join(a, key, "left_anti").withColumn("side", F.lit("no assay")))


def by_taxon_group(rows: DataFrame, value: str) -> DataFrame:
    """grp (virus, nonvirus, total), n and the mean of ``value``."""
    return rows.groupingSets([[F.col("grp")], []], F.col("grp")).agg(F.grouping("grp").alias("_g"), F.count("*").alias("n"), F.avg(value).alias("mean")).select(
        F.when(F.col("_g") == 1, "total").otherwise(F.col("grp")).alias("grp"), "n", "mean")


def model_hash(files: list[tuple[str, DataFrame]], options: dict[str, Any], custom: bool = False) -> str:
    """Sixteen hex digits for data and options: files as (name, DataFrame) are summed up by an order-free digest of their rows."""
    parts = []
    for name, df in sorted(files, key=lambda x: x[0]):
        row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
        found = df.agg(F.count("*").alias("n"), F.sum(row).alias("a"), F.sum(F.xxhash64(F.lit(7), *sorted(df.columns)).cast("decimal(38,0)")).alias("b")).first()
        parts.append((name, found["n"], str(found["a"]), str(found["b"])))
    text = json.dumps({"files": parts, "options": {str(k): str(v) for k, v in options.items()}, "custom": custom}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def elapsed(start: datetime.datetime, end: datetime.datetime) -> dict[str, str | float]:
    """Both times in ISO form, and the seconds between them."""
    return {"start_time": start.isoformat(), "end_time": end.isoformat(), "elapsed_time": (end - start).total_seconds()}


Observer = Callable[[str, dict[str, Any]], None]


class Observed:
    """What a run reports: kept, and pushed to every observer at once. ``configuration`` is restored by ``loaded``."""

    def __init__(self, configuration: dict[str, Any], observers: tuple[Observer, ...] = ()):
        self.configuration, self.derived, self.observers = dict(configuration), {}, list(observers)

    def add(self, name: str, **values: Any) -> None:
        self.derived.setdefault(name, {}).update(values)
        for push in self.observers:
            push(name, values)

    def save(self, path: str) -> None:
        """Sorted by key, as YAML."""
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump({"config": self.configuration, "derived_values": self.derived}, f, sort_keys=True)

    @classmethod
    def loaded(cls, path: str, observers: tuple[Observer, ...] = ()) -> "Observed":
        import yaml

        with open(path) as f:
            found = yaml.safe_load(f) or {}
        out = cls(found.get("config") or {}, observers)
        out.derived = found.get("derived_values") or {}
        return out


def table_observer(spark: SparkSession, path: str) -> Observer:
    """An observer that appends (name, key, value) rows to a table."""
    def push(name: str, values: dict[str, Any]) -> None:
        rows = [(name, str(k), json.dumps(v, default=str)) for k, v in values.items()]
        spark.createDataFrame(rows, "name string, key string, value string").write.mode("append").parquet(path)

    return push


#: Public benchmarks by kind; others are given by the caller.
SUPERVISED, ZERO_SHOT = ("flip",), ("proteingym",)


def check_benchmark(framework: str, zero_shot_method: str | None = None, min_length: int | None = None, max_length: int | None = None,
                    supervised: tuple[str, ...] = SUPERVISED, zero_shot: tuple[str, ...] = ZERO_SHOT) -> None:
    """Raises if a benchmark's arguments don't fit its kind."""
    if framework.lower() not in supervised + zero_shot:
        raise ValueError(f"no such benchmark: {framework}")
    if framework.lower() in zero_shot:
        if zero_shot_method is None:
            raise ValueError("a zero-shot benchmark needs a method")
        return
    if zero_shot_method is not None:
        raise ValueError("a zero-shot method is for zero-shot benchmarks")
    if min_length is None or max_length is None:
        raise ValueError("a supervised benchmark needs min_length and max_length")
    if not min_length < max_length or max_length <= 0:
        raise ValueError("min_length must be less than max_length, which must be above 0")
