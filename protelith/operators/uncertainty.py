"""Bootstrap intervals, forward-pass summaries, interval comparisons."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int

ITERATIONS = 30


def resampled(rows: DataFrame, keys: list[str], iterations: int = ITERATIONS, seed: int = 42, size: int | None = None) -> DataFrame:
    """Rows (keys, row_ix from 0 in each group, ...) drawn with replacement, ``iterations`` times each group's size (or ``size``).

    A draw's index is a hash of the seed, iteration and draw, so results repeat. Row i of a group makes the draws i, i + n, ... of each iteration, so
    draws are spread as the rows are, and are numbers only until they meet the rows.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    mine = rows.select(*keys, "row_ix").join(n, list(keys)) if keys else rows.select("row_ix").join(F.broadcast(n))  # one row
    draw = F.explode(F.sequence("row_ix", F.lit(size - 1), F.col("_n"))) if size else F.col("row_ix")
    mine = mine.where(F.col("row_ix") < size) if size else mine
    draws = (mine.withColumn("draw", draw).withColumn("iteration", F.explode(F.array(*[F.lit(i) for i in range(iterations)])))
             .select(*keys, "iteration", "draw", (hash_int(str(seed), F.col("iteration"), F.col("draw")) % F.col("_n")).alias("row_ix")))
    return draws.join(rows, [*keys, "row_ix"])


def interval(metrics: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, lower, upper (2.5 and 97.5 per cent, interpolated) over iterations."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), q.alias("_q")).select(*keys, "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def overlap(lower_a, upper_a, lower_b, upper_b) -> Column:
    return (F.col(lower_a) <= F.col(upper_b)) & (F.col(lower_b) <= F.col(upper_a))


def greater(lower_a, upper_b) -> Column:
    """The first interval lies above the second."""
    return F.col(lower_a) > F.col(upper_b)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function by the Abramowitz-Stegun polynomial (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def two_sided_p(t: float, df: float) -> float:
    """The two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    mirrored = x > (a + 1) / (a + b + 2)
    if mirrored:
        a, b, x = b, a, 1 - x
    tail = 1.0
    for i in range(400, 0, -1):  # from the inside out
        m, odd = divmod(i, 2)
        d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        tail = 1 + d / tail
    value = front / (a * tail)
    return 1 - value if mirrored else value


def z_test(mean_a: Column, width_a: Column, mean_b: Column, width_b: Column) -> tuple[Column, Column]:
    """z and two-sided p of two means with half-widths of 95 per cent intervals."""
    z = (mean_a - mean_b) / F.sqrt(F.pow(width_a / 1.96, 2) + F.pow(width_b / 1.96, 2))
    return z, 2 * (1 - normal_cdf(F.abs(z)))


def pass_summary(passes: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """mean, std and 95 per cent bounds over forward passes."""
    return passes.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
                                     F.percentile(value, F.lit(0.025)).alias("lower"), F.percentile(value, F.lit(0.975)).alias("upper"))


def bald_scores(passes: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Mutual information per key from rows (keys, pass, class, p)."""
    by_class = passes.groupBy(*keys, "class").agg(F.avg("p").alias("m"), F.avg(-F.col("p") * F.log(F.col("p") + eps)).alias("h"))
    return by_class.groupBy(*keys).agg((F.sum(-F.col("m") * F.log(F.col("m") + eps)) - F.sum("h")).alias("bald"))


def gaussian_interval(mean: Column, std: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    return mean - z * std, mean + z * std
