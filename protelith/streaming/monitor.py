"""Continuous metrics over event streams; each function also takes a batch DataFrame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late) if events.isStreaming else events


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def tumbling(events: DataFrame, length: str = "1 hour", keys: tuple[str, ...] = ("event_type",), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """start, end, keys, n and total of value per window."""
    found = _timed(events, ts, late).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _flat(found, list(keys))


def sliding(events: DataFrame, length: str = "1 hour", slide: str = "30 minutes", keys: tuple[str, ...] = ("event_type",), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    found = _timed(events, ts, late).groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _flat(found, list(keys))


def sessions(events: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("user_id",), ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    found = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _flat(found, list(keys))


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    timed = _timed(events, ts, late)
    return timed.dropDuplicatesWithinWatermark([key]) if timed.isStreaming else timed.dropDuplicates([key])
