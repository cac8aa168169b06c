"""Metrics over columns label and pred; every function takes the grouping keys (none: one row)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import running_before

ASCENDING = frozenset(("loss", "mse", "rmse"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """n per (label, pred); rows without a label are masked."""
    return rows.where("label is not null").groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per class that occurs as label or prediction."""
    each = matrix.select(*keys, "n", F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.lit(True).alias("is_label")), F.struct(F.col("pred").alias("class"), F.lit(False).alias("is_label")))).alias("x"),
        (F.col("label") == F.col("pred")).alias("hit"))
    out = each.groupBy(*keys, F.col("x.class").alias("class")).agg(
        F.sum(F.when(F.col("x.is_label") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("x.is_label") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("x.is_label") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def classification(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """accuracy (also micro precision, recall, f1), balanced_accuracy and macro values over active classes, matthews correlation."""
    classes = per_class(matrix, keys)
    sums = classes.groupBy(*keys).agg(
        F.sum("tp").alias("c"), F.sum(F.col("tp") + F.col("fn")).alias("s"),
        F.sum((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn"))).alias("pt"), F.sum(F.pow(F.col("tp") + F.col("fp"), 2)).alias("pp"),
        F.sum(F.pow(F.col("tp") + F.col("fn"), 2)).alias("tt"),
        F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    s2 = F.pow(F.col("s"), 2)
    matthews = ratio(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt"))))
    return sums.select(*keys, ratio(F.col("c"), F.col("s")).alias("accuracy"), "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", matthews.alias("matthews"))


def binary(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 with 1 as the positive class."""
    hit = lambda label, pred: F.count_if((F.col("label") == label) & (F.col("pred") == pred))
    c = rows.where("label is not null").groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*keys, ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def regression(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    mse = F.avg(F.pow(F.col("pred") - F.col("label"), 2))
    return rows.where("label is not null").groupBy(*keys).agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def average_ranks(rows: DataFrame, column: str, keys: list[str], out: str) -> DataFrame:
    """Adds the rank of ``column`` within ``keys``, from 1, the mean rank for ties: counted by value, summed over ranges of values."""
    counted = rows.groupBy(*keys, column).agg(F.count("*").alias("_c"))
    ranked = running_before(counted, [column], keys, F.col("_c"), "_b").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(column).alias("_v"), (F.col("_b") + (F.col("_c") + 1) / 2.0).alias(out))
    same = F.col(column).eqNullSafe(F.col("_v"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ranked, same).drop("_v", *[f"_k{i}" for i in range(len(keys))])


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; 0 where one side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def spearman(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks."""
    keys, pairs = list(keys), rows.where("label is not null").select(*keys, "label", "pred")
    ranked = average_ranks(average_ranks(pairs, "label", keys, "_l"), "pred", keys, "_p")
    return ranked.groupBy(*keys).agg(correlation("_l", "_p").alias("spearman"))


def ndcg(rows: DataFrame, keys: list[str], key: str, share: float = 0.1) -> DataFrame:
    """Of the top ``share`` by prediction, gains scaled to [0, 1]; ties by ``key``; 0 where fewer than one row is in that share."""
    keys = list(keys)
    ends = rows.groupBy(*keys).agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_n"))
    each = rows.join(ends, keys) if keys else rows.join(F.broadcast(ends))  # one row
    each = each.withColumn("_gain", F.coalesce(F.try_divide(F.col("label") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))).select(*keys, key, "pred", "_gain", "_n")
    by_pred = running_before(each, [F.desc("pred"), F.col(key)], keys, out="_r").select(*keys, "_gain", "_n", "_r", F.lit(True).alias("_said"))
    by_gain = running_before(each, [F.desc("_gain"), F.col(key)], keys, out="_r").select(*keys, "_gain", "_n", "_r", F.lit(False).alias("_said"))
    top = by_pred.unionByName(by_gain).where(F.col("_r") < F.floor(F.lit(share) * F.col("_n")))
    part = lambda said: F.sum(F.when(F.col("_said") == said, F.col("_gain") / F.log2(F.col("_r") + 2.0)).otherwise(0.0))
    found = top.groupBy(*keys).agg(ratio(part(True), part(False)).alias("ndcg"))
    every = ends.select(*keys)
    return every.join(found, keys, "left").select(*keys, F.coalesce("ndcg", F.lit(0.0)).alias("ndcg")) if keys else found.select(F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"))


def smooth_l1(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    d = F.abs(F.col("pred") - F.col("label"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("label").isNotNull(), F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5))), F.lit(0.0)).alias("smooth_l1"))


def cross_entropy(rows: DataFrame, keys: list[str] = (), probability: str = "p", weight: str = "weight") -> DataFrame:
    """Weighted mean of -ln of the label's probability; masked labels don't count."""
    used = rows.where("label is not null")
    return used.groupBy(*keys).agg((F.sum(-F.col(weight) * F.log(probability)) / F.sum(weight)).alias("cross_entropy"))


#: Metrics by protocol, the suites that ``evaluated`` computes.
SUITES = {
    "residue_to_class": ("classification",), "residues_to_class": ("classification",), "sequence_to_class": ("classification",),
    "residue_to_value": ("regression", "spearman"), "residues_to_value": ("regression", "spearman", "ndcg"), "sequence_to_value": ("regression", "spearman", "ndcg"),
}


def _long(found: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in found.columns if c not in keys]
    return found.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select(*keys, "m.*")


def class_suite(matrix: DataFrame, keys: list[str] = (), only: str | None = None) -> DataFrame:
    """keys, metric, value of a confusion matrix: what ``classification`` gives, micro averages, accuracy, precision, recall and f1 of each class, the rank correlation of the classes in
    order of name, and where at most two classes occur precision, recall and f1_score with the later one as positive. All come from the counts by pair of classes."""
    keys = list(keys)
    overall = classification(matrix, keys)
    if only in overall.columns and only not in keys:
        return _long(overall.select(*keys, only), keys)
    micro = overall.select(*keys, *[F.col("accuracy").alias(f"micro_{c}") for c in ("precision", "recall", "f1")])
    classes = per_class(matrix, keys)
    names = {"accuracy": "recall", "precision": "precision", "recall": "recall", "f1": "f1"}
    each = classes.select(*keys, F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m} class "), F.col("class").cast("string")).alias("metric"), F.col(c).alias("value")) for m, c in names.items()])).alias("m")).select(*keys, "m.*")
    two = classes.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max_by(c, "class").alias(out) for c, out in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))]).where("_n <= 2").drop("_n")
    ranks = matrix
    for side in ("label", "pred"):
        counted = matrix.groupBy(*keys, side).agg(F.sum("n").alias("_c"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each class
        counted = counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(side).alias("_v"), (before + (F.col("_c") + 1) / 2.0).alias(f"_{side}"))
        same = F.col(side).eqNullSafe(F.col("_v"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        ranks = ranks.join(counted, same).drop("_v", *[f"_k{i}" for i in range(len(keys))])
    a, b, n = F.col("_label"), F.col("_pred"), F.col("n")
    sums = ranks.groupBy(*keys).agg(F.sum(n).alias("n"), *[F.sum(n * x).alias(out) for x, out in ((a, "a"), (b, "b"), (a * b, "ab"), (a * a, "aa"), (b * b, "bb"))])
    spread = lambda x: F.col(f"{x}{x}") * F.col("n") - F.col(x) * F.col(x)
    rank = sums.select(*keys, F.coalesce(F.try_divide(F.col("ab") * F.col("n") - F.col("a") * F.col("b"), F.sqrt(spread("a")) * F.sqrt(spread("b"))), F.lit(0.0)).alias("spearman"))
    return reduce(DataFrame.unionByName, [*(_long(x, keys) for x in (overall, micro, two, rank)), each])


def evaluated(rows: DataFrame, protocol: str, keys: list[str] = (), key: str = "seq_hash", only: str | None = None) -> DataFrame:
    """keys, metric, value: the suite of the protocol over label and pred, a row per metric. With ``only`` that metric at least, from its part of the suite where there is one: each part
    reads the rows again."""
    keys, parts = list(keys), []
    used = rows.where("label is not null")
    for kind in SUITES[protocol]:
        if kind == "classification":
            parts.append(class_suite(confusion(used, keys), keys, only))
            continue
        found = {"regression": lambda: regression(used, keys), "spearman": lambda: spearman(used, keys), "ndcg": lambda: ndcg(used, keys, key)}[kind]()
        if only in found.columns and only not in keys:
            return _long(found.select(*keys, only), keys)
        parts.append(_long(found, keys))
    return reduce(DataFrame.unionByName, parts)
