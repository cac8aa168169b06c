"""Functions of array columns."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / total(e))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.transform(logits, lambda x: x - top - F.log(total(F.transform(logits, lambda y: F.exp(y - top)))))


def argmax(v: Column) -> Column:
    """The first position, from 0, of the largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


#: How two embeddings of an interaction are combined.
INTERACTIONS: dict[str, Callable[[Column, Column], Column]] = {"multiply": multiply, "concat": concat}


def pad(v: Column, n: int, value: float = 0.0) -> Column:
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(v))))


def unpad(v: Column, n: Column) -> Column:
    return F.slice(v, F.lit(1), n)


def mean_of(rows: Column) -> Column:
    """The mean of equally long arrays (an array of arrays)."""
    summed = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), rows[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.size(rows))


def square_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def entropy(p: Column, eps: float = 1e-10) -> Column:
    return total(F.transform(p, lambda x: -x * F.log(x + eps)))


def bald(passes: Column) -> Column:
    """Mutual information of class probabilities over forward passes (an array of arrays)."""
    return entropy(mean_of(passes)) - total(F.transform(passes, lambda p: entropy(p))) / F.size(passes)
