"""Hold-out, k-fold, leave-p-out splits and hyper-parameter grids, as long tables (split_name, id, role)."""

import ast
import itertools
import random
import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int


def running_before(rows: DataFrame, order: list[Column | str], groups: list[str] = (), amount: Column | None = None, out: str = "before") -> DataFrame:
    """Adds the sum of ``amount`` (1 by default) over the rows of the same group that stand before in ``order``.

    Rows are sorted in ranges of (groups, order), so neither a large group nor the whole table meets in one task; each range adds what the ranges
    before it hold of its first group. The sorted ranges are kept on disk, as both uses of them must see the same ranges (another sample of the rows, as
    another plan would take, gives others).
    """
    keys, amount = [*groups, *order], F.lit(1) if amount is None else amount
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = rows.withColumn("_a", amount).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumns(
        {"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}).persist(StorageLevel.DISK_ONLY)
    inside = Window.partitionBy("_p", *groups).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    parted = parted.withColumn("_in", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    sums = parted.groupBy("_p", *groups).agg(F.sum("_a").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = parted.join(offsets if groups else F.broadcast(offsets), same)  # without groups a row per range
    return joined.withColumn(out, F.col("_before") + F.col("_in")).drop("_a", "_p", "_m", "_in", "_q", "_before", *[f"_g{i}" for i in range(len(groups))])


def _numbered(rows: DataFrame, order: list[Column | str], groups: list[str] = ()) -> DataFrame:
    """Adds ordinal, from 0 within the groups."""
    return running_before(rows, order, list(groups), out="ordinal")


def k_fold(rows: DataFrame, k: int, key: str, order: list | None = None, stratify: str | None = None) -> DataFrame:
    """Adds fold (from 0). Unstratified: contiguous blocks, the first n % k of them one longer; stratified: dealt in turn within each class."""
    if k < 2:
        raise ValueError("k must be at least 2")
    order = order or [key]
    if stratify:
        return _numbered(rows, order, [stratify]).withColumn("fold", (F.col("ordinal") % k).cast("int"))
    n = rows.agg(F.count("*").alias("_all"))
    small, extra = F.floor(F.col("_all") / k), F.col("_all") % k
    edge = extra * (small + 1)
    fold = F.when(F.col("ordinal") < edge, F.floor(F.col("ordinal") / (small + 1))).otherwise(extra + F.floor((F.col("ordinal") - edge) / F.greatest(small, F.lit(1))))
    return _numbered(rows, order).join(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_all")


def repeated_k_fold(rows: DataFrame, k: int, repeats: int, key: str, seed: int = 42) -> DataFrame:
    """Adds repeat and fold; each repeat deals the rows in the order of a seeded hash."""
    each = rows.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    return _numbered(each, [hash_int(str(seed), F.col("repeat"), F.col(key)), F.col(key)], ["repeat"]).withColumn("fold", (F.col("ordinal") % k).cast("int"))


def split_name(fold: Column, stratified: bool = False, repeat: Column | None = None, outer: bool = False, hp: int | None = None, nested: bool = False) -> Column:
    parts = ["k_fold"] + ["strat"] * stratified + ["rep"] * (repeat is not None) + ["outer"] * outer + ([f"hp-{hp}"] if hp is not None else []) + ["nested"] * nested
    return F.concat_ws("-", F.lit("-".join(parts)), fold + 1, *([repeat + 1] if repeat is not None else []))


def as_splits(folds: DataFrame, key: str, k: int, name: Column | None = None) -> DataFrame:
    """(split_name, key, role): each fold once for validation, else for training."""
    each = folds.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return each.select((name if name is not None else split_name(F.col("_v"))).alias("split_name"), key, F.when(F.col("fold") == F.col("_v"), "val").otherwise("train").alias("role"))


def nested_k_fold(rows: DataFrame, outer: int, inner: int, key: str) -> DataFrame:
    """(outer, inner, key, role): the outer fold tests; the rest is dealt into inner folds."""
    base = k_fold(rows, outer, key).withColumnRenamed("fold", "_fold").drop("ordinal")
    each = base.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    test = each.where("_fold = outer").select("outer", F.lit(None).cast("int").alias("inner"), key, F.lit("test").alias("role"))
    rest = _numbered(each.where("_fold <> outer"), [key], ["outer"]).withColumn("fold", F.col("ordinal") % inner)
    rest = rest.withColumn("inner", F.explode(F.sequence(F.lit(0), F.lit(inner - 1)))).select(
        "outer", "inner", key, F.when(F.col("fold") == F.col("inner"), "val").otherwise("train").alias("role"))
    return rest.unionByName(test)


def leave_p_out(ids: DataFrame, p: int, key: str) -> DataFrame:
    """split_name and the p ids left out, ascending: one row for each of the n over p splits, by p - 1 joins on order."""
    if p < 1:
        raise ValueError("p must be at least 1")
    out = ids.select(F.col(key).alias("id_1"))
    for i in range(2, p + 1):
        out = out.join(ids.select(F.col(key).alias(f"id_{i}")), F.col(f"id_{i - 1}") < F.col(f"id_{i}"))
    return out.withColumn("split_name", F.concat(F.lit("leave_"), F.concat_ws("_", *[F.col(f"id_{i}") for i in range(1, p + 1)])))


def continuous_bins(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Adds bin (from 0): equal-width bins over the column's range; a constant column is one bin."""
    ends = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = F.least(F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
    return rows.join(F.broadcast(ends)).withColumn("bin", F.when(F.col("_high") == F.col("_low"), 0).otherwise(at).cast("int")).drop("_low", "_high")


def parameter_values(value) -> list:
    """The values of one hyper-parameter: a list, ``range(a, b, c)``, a list in text, or a single value."""
    if isinstance(value, str):
        if found := re.fullmatch(r"\s*range\(\s*(-?\d+)\s*(?:,\s*(-?\d+)\s*)?(?:,\s*(-?\d+)\s*)?\)\s*", value):
            return list(range(*[int(x) for x in found.groups() if x is not None]))
        if value.strip().startswith("["):
            value = ast.literal_eval(value)
    return list(dict.fromkeys(value)) if isinstance(value, (list, tuple)) else [value]


def parameter_grid(parameters: dict) -> list[dict]:
    names, values = list(parameters), [parameter_values(v) for v in parameters.values()]
    return [dict(zip(names, combination)) for combination in itertools.product(*values)]


def random_subset(grid: list[dict], n: int, seed: int = 42) -> list[dict]:
    """``n`` different combinations in a seeded order; all of them if there are fewer."""
    return random.Random(seed).sample(grid, min(n, len(grid)))


def grid_table(spark: SparkSession, parameters: dict) -> DataFrame:
    """A row per combination, numbered in the order of the product."""
    grid = parameter_grid(parameters)
    return spark.createDataFrame([(i, {k: str(v) for k, v in g.items()}) for i, g in enumerate(grid)], "hp_id int, parameters map<string,string>")


def random_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a seeded hash of the key; all rows if there are fewer."""
    return rows.orderBy(hash_int(str(seed), F.col(key)), F.col(key)).limit(n)


def early_stop(losses: DataFrame, keys: list[str], patience: int, epsilon: float = 0.001) -> DataFrame:
    """best_epoch, best_loss and stop_epoch per key of (epoch, loss): training stops when ``patience`` + 1 epochs in a row bring nothing."""
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "loss")))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("best_epoch"), F.lit(patience).alias("left"), F.lit(-1).alias("stop"))

    def step(s, x):
        better = (x["loss"] < s["best"] - epsilon * F.abs(s["best"])) | (s["best_epoch"] < 0)
        over = s["stop"] >= 0
        return F.struct(F.when(~over & better, x["loss"]).otherwise(s["best"]).alias("best"), F.when(~over & better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
                        F.when(~over & better, F.lit(patience)).otherwise(s["left"] - 1).alias("left"),
                        F.when(~over & ~better & (s["left"] == 0), x["epoch"]).otherwise(s["stop"]).alias("stop"))

    folded = losses.select(*keys, F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss")).groupBy(*keys).agg(F.aggregate(ordered, start, step).alias("s"))
    return folded.select(*keys, F.col("s.best_epoch").alias("best_epoch"), F.col("s.best").alias("best_loss"), F.nullif(F.col("s.stop"), F.lit(-1)).alias("stop_epoch"))
