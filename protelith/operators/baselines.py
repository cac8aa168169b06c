"""Naive baselines, checks for degenerate predictions, and the bias of interaction data."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .metrics import correlation
from .uncertainty import two_sided_p


def constant(test: DataFrame, value) -> DataFrame:
    return test.withColumn("pred", F.lit(value))


def mean_of_train(train: DataFrame, test: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Predicts the training mean (per key)."""
    means = train.groupBy(*keys).agg(F.avg("label").alias("pred"))
    return test.join(means, list(keys), "left") if keys else test.join(F.broadcast(means))


def random_sampling(train: DataFrame, test: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Draws labels by their share in training; the cumulative shares are a row per class."""
    shares = train.groupBy("label").agg(F.count("*").alias("n"))
    w = Window.orderBy("label")
    cumulative = shares.withColumn("upper", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    one = cumulative.agg(F.array_sort(F.collect_list(F.struct("upper", "label"))).alias("_c"))
    u = uniform(str(seed), F.col(key))
    return test.join(F.broadcast(one)).withColumn("_u", u).withColumn("pred", F.filter("_c", lambda x: x["upper"] > F.col("_u"))[0]["label"]).drop("_c", "_u")


def uniform_between(train: DataFrame, test: DataFrame, key: str, seed: int = 42) -> DataFrame:
    ends = train.agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
    return test.join(F.broadcast(ends)).withColumn("pred", F.col("_a") + uniform(str(seed), F.col(key)) * (F.col("_b") - F.col("_a"))).drop("_a", "_b")


def warnings(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """all_equal: one prediction for all rows; acc_prec_rec_equal: the binary metrics coincide."""
    hit = lambda label, pred: F.count_if((F.col("label") == label) & (F.col("pred") == pred))
    c = rows.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"), F.countDistinct("pred").alias("k"))
    acc, prec, rec = (F.try_divide(a, b) for a, b in ((F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
                                                     (F.col("tp"), F.col("tp") + F.col("fp")), (F.col("tp"), F.col("tp") + F.col("fn"))))
    return c.select(*keys, (F.col("k") == 1).alias("all_equal"), F.coalesce((acc == prec) & (prec == rec), F.lit(False)).alias("acc_prec_rec_equal"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, positive and negative edge counts of edges (a, b, target 0 or 1)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "target")
    return ends.groupBy("node").agg(F.count_if(F.col("target") == 1).alias("positive"), F.count_if(F.col("target") == 0).alias("negative"))


def random_model(test: DataFrame, key: str, classes: list | None = None, seed: int = 42) -> DataFrame:
    """What a model that has learned nothing says: a class, or a number in [0, 1), by a hash of the seed and the key."""
    u = uniform(f"{seed}m", F.col(key))
    return test.withColumn("pred", u if classes is None else F.element_at(F.array(*map(F.lit, classes)), (F.floor(u * len(classes)) + 1).cast("int")))


def bias_test(node_degrees: DataFrame) -> tuple[float, float, int]:
    """The correlation of positive and negative degrees, its two-sided p, and the number of nodes."""
    row = dataset_bias(node_degrees).first()
    r, n = row["bias"], row["n_nodes"]
    return r, 0.0 if abs(r) >= 1 else two_sided_p(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2) if n > 2 else float("nan"), n


def dataset_bias(node_degrees: DataFrame) -> DataFrame:
    return node_degrees.agg(correlation("positive", "negative").alias("bias"), F.count("*").alias("n_nodes"))


def bias_predictions(edges: DataFrame, node_degrees: DataFrame) -> DataFrame:
    """Predicts 0 where both ends' negative edges together are at least as many as their positive ones."""
    of = lambda side: node_degrees.select(F.col("node").alias(side), F.col("positive").alias(f"_p{side}"), F.col("negative").alias(f"_n{side}"))
    joined = edges.join(of("a"), "a").join(of("b"), "b")
    return joined.withColumn("pred", F.when(F.col("_na") + F.col("_nb") >= F.col("_pa") + F.col("_pb"), 0).otherwise(1)).drop("_pa", "_pb", "_na", "_nb")
