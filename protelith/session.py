"""Session settings that the library expects."""

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "protelith", **conf) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; ``conf`` overrides (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
