"""Saved runs: a folder from which a run is resumed, and from which predictions are made without it.

A folder holds parts, each a Parquet folder that counts only once its ``_SUCCESS`` is there: ``config``, ``scaler``, ``projection``, ``searched`` (the choice of a nested search), ``states/<epoch>`` (where all networks
of a joint training stand), ``measured/<split>`` and last ``models/<split>`` for each finished split, and ``best``. A run that starts again with ``auto_resume`` reads what is there: finished splits are not fitted again,
and a joint training goes on after the last committed epoch. All access is through Spark and its file systems, so any shared storage will do.
"""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, splits, uncertainty, vectors
from . import trainer
from .config import Config, ConfigError, is_classification
from .models import Fitted, Trained

FORMAT, EVERY = 1, 5
MODEL = ("choice string, features int, options string, names array<string>, parameters array<double>, searched string, best_epoch int, "
         "epochs array<struct<epoch:int,training:double,validation:double>>")
STATE = ("fit int, now array<double>, best array<double>, steps double, epoch int, best_epoch int, best_loss double, left int, stopped boolean, "
         "seen array<struct<epoch:int,training:double,validation:double>>")


class Folder:
    """The parts of a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _on(self, part: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def has(self, part: str) -> bool:
        fs, at = self._on(f"{part}/_SUCCESS")
        return fs.exists(at)

    def write(self, part: str, df: DataFrame) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{part}")

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def drop(self, part: str) -> None:
        fs, at = self._on(part)
        fs.delete(at, True)

    def parts(self, of: str) -> list[str]:
        """The committed parts below ``of``, in order of name."""
        fs, at = self._on(of)
        if not fs.exists(at):
            return []
        return sorted(f"{of}/{s.getPath().getName()}" for s in fs.listStatus(at) if self.has(f"{of}/{s.getPath().getName()}"))

    # what a run writes

    def begin(self, config: Config) -> None:
        """Starts or resumes; a folder of another configuration is an error when resuming, and is emptied otherwise."""
        said = json.dumps({"format": FORMAT, "given": config.given, "cross_validation": config.cross_validation}, default=lambda o: type(o).__name__, sort_keys=True)
        same = json.loads(said)
        for side in ("auto_resume", "output_dir"):
            same["given"].pop(side, None)
        if config.values.get("auto_resume") and self.has("config"):
            there = json.loads(self.read("config").first()["config"])
            for side in ("auto_resume", "output_dir"):
                there["given"].pop(side, None)
            if there != same:
                raise ConfigError(f"{self.path} holds a run with other options")
            return
        for part in ("config", "scaler", "projection", "searched", "states", "measured", "models", "best"):
            self.drop(part)
        self.write("config", self.spark.createDataFrame([(said,)], "config string"))

    def keep_model(self, name: str, parameters: dict[str, Any], fitted: Fitted, found: DataFrame) -> DataFrame:
        """The metrics as written; the model is committed after them."""
        m = fitted.model
        self.write(f"measured/{name}", found)
        row = (m.choice, m.features, json.dumps(m.options), list(m.names), m.parameters.tolist(), json.dumps(parameters), fitted.best_epoch, [tuple(map(_finite, e)) for e in fitted.epochs])
        self.write(f"models/{name}", self.spark.createDataFrame([row], MODEL))
        return self.read(f"measured/{name}")

    def model(self, name: str) -> tuple[dict[str, Any], Fitted, DataFrame]:
        r = self.read(f"models/{name}").first()
        m = Trained(r["choice"], r["features"], json.loads(r["options"]), tuple(r["names"]), np.array(r["parameters"]))
        return json.loads(r["searched"]), Fitted(m.predict, tuple(map(tuple, r["epochs"])), r["best_epoch"], m), self.read(f"measured/{name}")

    def keep_states(self, epoch: int, states: list[trainer.State]) -> None:
        """All states after an epoch; the ones before go once these are committed."""
        rows = [(i, s.now.ravel().tolist(), s.best.tolist(), float(s.steps), s.epoch, s.best_epoch, _finite(s.best_loss), s.left, s.stopped, [tuple(map(_finite, e)) for e in s.seen]) for i, s in enumerate(states)]
        here = f"states/{epoch:06}"
        self.write(here, self.spark.createDataFrame(rows, STATE))
        for part in self.parts("states"):
            if part != here:
                self.drop(part)

    def states(self) -> list[trainer.State] | None:
        there = self.parts("states")
        if not there:
            return None
        back = lambda v: math.inf if v is None else v
        return [trainer.State(np.array(r["now"]).reshape(-1, len(r["best"])), np.array(r["best"]), r["steps"], r["epoch"], r["best_epoch"], back(r["best_loss"]), r["left"], r["stopped"],
                              [(e["epoch"], e["training"], math.nan if e["validation"] is None else e["validation"]) for e in r["seen"]]) for r in self.read(there[-1]).orderBy("fit").collect()]


def _finite(v):
    return v if not isinstance(v, float) else float(v) if math.isfinite(v) else None


class Run:
    """Predictions from a folder alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)
        if not self.folder.has("best"):
            raise ConfigError(f"{path} holds no finished run")
        said = json.loads(self.folder.read("config").first()["config"])
        if said["format"] != FORMAT:
            raise ConfigError(f"{path} has format {said['format']}, not {FORMAT}")
        self.given, self.protocol = said["given"], said["given"]["protocol"]
        self.splits = [p.split("/", 1)[1] for p in self.folder.parts("models")]
        self.best = self.folder.read("best").first()["split_name"]

    def trained(self, split: str | None = None) -> Trained:
        name = split or self.best
        if name not in self.splits:
            raise ValueError(f"no split {name}; there are {self.splits}")
        return self.folder.model(name)[1].model

    def prepared(self, rows: DataFrame, scale: bool = True) -> DataFrame:
        """``rows`` (embedding) with features: scaled and projected as in training. Vectors as short as the projection's are taken as projected."""
        sequences = dict(rows.dtypes)["embedding"].startswith("array<array")
        if scale:
            rows = (vectors.scale_sequences if sequences else vectors.scale)(rows, self.folder.read("scaler"), out="features")
        else:
            rows = rows.withColumn("features", F.col("embedding"))
        if self.folder.has("projection"):
            projection = self.folder.read("projection")
            n = projection.count()
            projected = vectors.project(rows, projection, "features", "_projected")
            rows = projected.withColumn("features", F.when(F.size("embedding") <= n, F.col("embedding").cast("array<double>")).otherwise(F.col("_projected"))).drop("_projected")
        return rows

    def predict(self, rows: DataFrame, split: str | None = None, scale: bool = True, probabilities: bool = False, key: str = "seq_hash") -> DataFrame:
        """``rows`` (key, embedding) with pred, and outputs where asked for."""
        return self.trained(split).predict(self.prepared(rows, scale), "features", probabilities, key).drop("features")

    def evaluate(self, rows: DataFrame, split: str | None = None, scale: bool = True) -> DataFrame:
        """metric, value of rows with a label."""
        from .training import measured

        return metrics.evaluated(measured(self.predict(rows, split, scale), self.trained(split).network.per_position), self.protocol)

    def bootstrapped(self, rows: DataFrame, split: str | None = None, iterations: int = 30, sample_size: int = -1, confidence_level: float = 0.05, seed: int = 42, scale: bool = True) -> DataFrame:
        """metric, mean, lower, upper over resamples of the rows (their number, or ``sample_size``)."""
        if not 0 < confidence_level < 1:
            raise ValueError(f"the confidence level lies between 0 and 1, not at {confidence_level}")
        from .training import measured

        said = measured(self.predict(rows, split, scale), self.trained(split).network.per_position).select("seq_hash", "label", "pred").where("label is not null")
        numbered = splits._numbered(said, ["seq_hash"], []).withColumnRenamed("ordinal", "row_ix")
        drawn = uncertainty.resampled(numbered, [], iterations, seed, sample_size if sample_size > 0 else None)
        found = metrics.classification(metrics.confusion(drawn, ["iteration"]), ["iteration"]) if is_classification(self.protocol) else metrics.regression(drawn, ["iteration"])
        values = [c for c in found.columns if c != "iteration"]
        long = found.select("iteration", F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("m")).select("iteration", "m.*")
        q = F.percentile("value", F.array(F.lit(confidence_level / 2), F.lit(1 - confidence_level / 2)))
        return long.groupBy("metric").agg(F.avg("value").alias("mean"), q.alias("q")).select("metric", "mean", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))

    def forward_passes(self, rows: DataFrame, split: str | None = None, n: int = 30, confidence_level: float = 0.05, seed: int = 42, scale: bool = True, key: str = "seq_hash") -> DataFrame:
        """``rows`` with the summary of ``n`` forward passes with dropout."""
        return self.trained(split).passes(self.prepared(rows, scale), n, "features", confidence_level, seed, key).drop("features")


def open_run(spark: SparkSession, path: str) -> Run:
    return Run(spark, path)
