"""Models over feature arrays: networks on the library's own trainer, MLlib estimators, Gaussian processes, nearest centroids, and a hook for external ones.

A model is registered for the protocols that it can serve; what it can't act on is refused, not ignored.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.networks import Network, convolutional, feed_forward, light_attention
from ..operators import vectors
from . import gaussian, trainer
from .config import PROTOCOLS, ConfigError, is_classification


def _prepared(df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))


@dataclass(frozen=True)
class Fitted:
    """``predict`` adds pred; ``epochs`` has (epoch, training loss, validation loss) of what was iterated; ``model`` is what MLlib made, or a ``Trained`` network."""

    predict: Callable[[DataFrame], DataFrame]
    epochs: tuple[tuple[int, float, float], ...] = ()
    best_epoch: int | None = None
    model: Any = None
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Trained:
    """A fitted network: all that a prediction needs, and all that is saved of it."""

    choice: str
    features: int
    options: dict[str, Any]  # what shapes the network
    names: tuple[str, ...]  # classes in order; none for values
    parameters: np.ndarray

    @property
    def network(self) -> Network:
        return built(self.choice, self.features, len(self.names) or 1, self.options)

    def predict(self, rows: DataFrame, features: str = "features", probabilities: bool = False, key: str = "seq_hash") -> DataFrame:
        """``rows`` with pred, and with ``probabilities`` the outputs."""
        network = self.network
        out = trainer.outputs(_flat(rows, network, features), network, self.parameters, bool(self.names), "_x", key=key)
        names = F.array(*[F.lit(n) for n in self.names]) if self.names else None
        one = lambda o: names[F.array_position(o, F.array_max(o)).cast("int") - 1] if self.names else o[0]
        pred = F.transform("outputs", one) if network.per_position else F.when(F.col("outputs").isNotNull(), one(F.col("outputs")))
        return out.withColumn("pred", pred).drop("_x", "_seed", *([] if probabilities else ["outputs"]))

    def passes(self, rows: DataFrame, n: int = 30, features: str = "features", confidence_level: float = 0.05, seed: int = 42, key: str = "seq_hash") -> DataFrame:
        """``rows`` with pred by the mean of ``n`` forward passes with dropout, mcd_predictions (of each pass), mcd_mean, mcd_std, mcd_lower, mcd_upper and for classes bald_score."""
        network, classes = self.network, bool(self.names)
        out = trainer.outputs(_flat(rows, network, features), network, self.parameters, classes, "_x", n, key, seed)
        s = out.withColumn("_s", F.when(F.col("outputs").isNotNull(), trainer.summaries(F.col("outputs"), classes, confidence_level)))
        names = F.array(*[F.lit(x) for x in self.names]) if classes else None
        one = lambda o: names[F.array_position(o, F.array_max(o)).cast("int") - 1] if classes else o[0]
        columns = {"pred": F.when(F.col("_s").isNotNull(), one(F.col("_s.mean"))), "mcd_predictions": F.transform("outputs", one), **{f"mcd_{c}": F.col(f"_s.{c}") for c in ("mean", "std", "lower", "upper")}}
        return s.withColumns(columns | ({"bald_score": F.col("_s.bald")} if classes else {})).drop("_s", "_x", "_seed", "outputs")


#: Networks by name: what builds them, and their hidden shape or width unless ``bottleneck_dim`` says otherwise.
_SHAPING = ("bottleneck_dim", "dropout_rate")


def built(choice: str, features: int, outputs: int, options: dict[str, Any]) -> Network:
    width, rate = options.get("bottleneck_dim"), options.get("dropout_rate")
    given = {} if rate is None else {"dropout": rate}
    if choice == "FNN":
        return feed_forward(features, outputs, (width or 32,), **given)
    if choice == "DeeperFNN":
        w = width or 128
        return feed_forward(features, outputs, (w, w // 2, w // 4), **given)
    if choice == "CNN":
        return convolutional(features, outputs, width or 32, **given)
    if choice == "Linear":
        return feed_forward(features, outputs, ())
    if choice == "LightAttention":
        return light_attention(features, outputs, **given)
    raise ConfigError(f"{choice} is no network")


NETWORKS = ("FNN", "DeeperFNN", "CNN", "LightAttention")
#: Networks that read a sequence of vectors; their rows have an array of arrays.
SEQUENCES = ("CNN", "LightAttention")


def _flat(rows: DataFrame, network: Network, features: str) -> DataFrame:
    x = F.col(features).cast("array<array<double>>" if network.positions else "array<double>")
    return rows.withColumn("_x", F.flatten(x) if network.positions else x)


def class_names(rows: DataFrame, per_position: bool = False) -> tuple[str, ...]:
    """The classes that occur, in order."""
    labels = rows.select(F.explode("label").alias("label")) if per_position else rows.select("label")
    return tuple(r[0] for r in labels.where("label is not null").distinct().orderBy("label").collect())


def prepared(rows: DataFrame, choice: str, names: tuple[str, ...], features: str = "features", key: str = "seq_hash") -> tuple[DataFrame, int]:
    """key, _x, _y of the trainer, with the columns of ``rows`` beside them, and the number of features."""
    positions = choice in SEQUENCES
    width = rows.where(F.size(features) > 0).select(F.size(F.col(features)[0]) if positions else F.size(features)).first()
    if width is None:
        raise ValueError("there is no row with features to train on")
    network = built(choice, width[0], len(names) or 1, {})
    labels = F.col("label") if network.per_position else F.array("label")
    return _flat(rows, network, features).withColumn("_y", trainer.coded(labels, list(names), bool(names))), width[0]


def network_fit(choice: str, name: str, width: int, names: tuple[str, ...], o: dict[str, Any], train: DataFrame | None = None) -> trainer.Fit:
    """What the trainer is to fit by the options; ``train`` gives the class weights where they are asked for."""
    weights = None
    if o.get("use_class_weights") and names:
        counted = {r["label"]: r["count"] for r in (train.select(F.explode("label").alias("label")) if choice == "CNN" else train).where("label is not null").groupBy("label").count().collect()}
        total = sum(counted.values())
        weights = tuple(total / (len(names) * counted[n]) if counted.get(n) else 0.0 for n in names)
    network = built(choice, width, len(names) or 1, o)
    return trainer.Fit(name, network, len(names), o.get("optimizer_choice") or "adam", float(o.get("learning_rate") or 1e-3), o["batch_size"], o["num_epochs"], o["patience"], float(o["epsilon"]),
                       o["seed"], o.get("model_weights_init") or "default", weights)


def network_fitted(choice: str, width: int, names: tuple[str, ...], o: dict[str, Any], state: trainer.State, features: str = "features") -> Fitted:
    model = Trained(choice, width, {k: o.get(k) for k in _SHAPING}, names, state.best)
    return Fitted(lambda rows: model.predict(rows, features), tuple(state.seen), state.best_epoch, model)


def network(choice: str) -> Callable:
    """A network of that name, fitted by the trainer with a stop by validation loss."""
    def fit(train: DataFrame, val: DataFrame | None, o: dict, classes: bool, features: str = "features") -> Fitted:
        names = class_names(train, choice == "CNN") if classes else ()
        rows = train.withColumn("_uses", F.array(F.lit(trainer.TRAIN)))
        if val is not None:
            rows = rows.unionByName(val.withColumn("_uses", F.array(F.lit(trainer.CHECK))))
        ready, width = prepared(rows, choice, names, features)
        state = trainer.train(ready, [network_fit(choice, choice, width, names, o, train)], features="_x")[0]
        return network_fitted(choice, width, names, o, state, features)

    return fit


def gaussian_process(train: DataFrame, val: DataFrame | None, o: dict, classes: bool, features: str = "features") -> Fitted:
    """An exact Gaussian process for values; ``num_epochs`` steps of its hyper-parameters, ``learning_rate`` their rate."""
    model = gaussian.fit(train, features=features, steps=o["num_epochs"], learning_rate=float(o.get("learning_rate") or 0.1), seed=o["seed"])
    return Fitted(lambda rows: model.predict(rows), model=model)


def _weights(train: DataFrame) -> DataFrame:
    """train with _w: n / (classes * n of the class)."""
    counts = train.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return train.join(counts, F.col("label") == F.col("_label")).join(F.broadcast(totals)).withColumn("_w", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_label", "_n", "_all", "_k")


def _log_loss(predicted: DataFrame) -> float:
    from pyspark.ml.functions import vector_to_array

    p = F.get(vector_to_array(F.col("probability")), F.col("_y").cast("int"))
    return predicted.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("l")).first()["l"]


def linear(train: DataFrame, val: DataFrame | None, o: dict, classes: bool, features: str = "features") -> Fitted:
    """Logistic or linear regression; ``num_epochs`` and ``epsilon`` bound the iterations, ``use_class_weights`` weighs classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import LinearRegression

    ready = _prepared(train, features)
    if not classes:
        model = LinearRegression(featuresCol="_x", labelCol="label", predictionCol="pred", maxIter=o["num_epochs"], tol=o["epsilon"]).fit(ready)
        return Fitted(lambda rows: model.transform(_prepared(rows, features)).drop("_x"), model=model)
    index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(ready)
    weighed = _weights(ready) if o.get("use_class_weights") else ready
    extra = {"weightCol": "_w"} if o.get("use_class_weights") else {}
    model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=o["num_epochs"], tol=o["epsilon"], **extra).fit(index.transform(weighed))
    return Fitted(lambda rows: _named(model.transform(_prepared(rows, features)), index.labels), model=model, names=tuple(index.labels))


def _named(predicted: DataFrame, labels: list[str]) -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    return predicted.withColumn("pred", names[F.col("_p").cast("int")]).drop("_x", "_p", "_y", "probability", "rawPrediction")


def perceptron(hidden: tuple[int, ...]) -> Callable:
    """A multilayer perceptron of that hidden shape, trained in steps of ``STEP`` iterations from where the last step ended.

    After each step the validation loss is measured; training ends when ``patience`` + 1 steps in a row don't improve it by the share ``epsilon``, and the
    best step's model is kept. With ``learning_rate`` given the solver is gradient descent, else limited-memory BFGS.
    """
    STEP = 10

    def fit(train: DataFrame, val: DataFrame | None, o: dict, classes: bool, features: str = "features") -> Fitted:
        from pyspark.ml.classification import MultilayerPerceptronClassifier
        from pyspark.ml.feature import StringIndexer

        ready = _prepared(train, features)
        index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(ready)
        ready = index.transform(ready).cache()
        check = index.transform(_prepared(val, features)).cache() if val is not None else None
        width = train.select(F.size(features)).first()[0]
        solver = {"solver": "gd", "stepSize": float(o["learning_rate"])} if o.get("learning_rate") is not None else {"solver": "l-bfgs"}
        best, best_loss, best_epoch, left, weights, seen, done = None, float("inf"), None, o["patience"], None, [], 0
        try:
            while done < o["num_epochs"]:
                n = min(STEP, o["num_epochs"] - done)
                estimator = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", layers=[width, *hidden, len(index.labels)],
                                                           seed=o["seed"], maxIter=n, tol=1e-9, blockSize=o["batch_size"], **solver)
                model = (estimator.setInitialWeights(weights) if weights is not None else estimator).fit(ready)
                weights, done = model.weights, done + n
                training = _log_loss(model.transform(ready))
                loss = _log_loss(model.transform(check)) if check is not None else training
                seen.append((done, training, loss))
                if best is None or loss < best_loss - o["epsilon"] * abs(best_loss):
                    best, best_loss, best_epoch, left = model, loss, done, o["patience"]
                elif left == 0:
                    break
                else:
                    left -= 1
        finally:
            ready.unpersist()
            if check is not None:
                check.unpersist()
        return Fitted(lambda rows: _named(best.transform(_prepared(rows, features)), index.labels), tuple(seen), best_epoch, best)

    return fit


def centroid(train: DataFrame, val: DataFrame | None, o: dict, classes: bool, features: str = "features") -> Fitted:
    """The class whose mean vector is nearest."""
    means = vectors.mean_by(train, ["label"], features)
    return Fitted(lambda rows: vectors.nearest_centroid(rows, means, features, "pred"), model=means)


def savable(fitted: Fitted) -> Fitted:
    """The same with a ``Trained`` in place of what only this session knows, where there is one: linear models and centroids are linear networks."""
    m, known = fitted.model, type(fitted.model).__name__
    if known == "LogisticRegressionModel":
        w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
        w, b = (np.vstack([-w, w]) / 2, np.r_[-b, b] / 2) if len(w) == 1 and m.numClasses == 2 else (w, b)
        names = fitted.names
    elif known == "LinearRegressionModel":
        w, b, names = m.coefficients.toArray()[None], np.array([m.intercept]), ()
    elif isinstance(m, DataFrame):  # centroids: the nearest has the largest 2 x c - c c
        rows = m.orderBy("label").collect()
        w = 2 * np.array([r["centroid"] for r in rows])
        b, names = -(w**2).sum(1) / 4, tuple(r["label"] for r in rows)
    else:
        return fitted
    return replace(fitted, model=Trained("Linear", w.shape[1], {}, tuple(names), np.r_[w.T.ravel(), b]))


@dataclass(frozen=True)
class Kind:
    fit: Callable
    protocols: tuple[str, ...]
    options: tuple[str, ...]  # options that it acts on, beside those of all models


_CLASSES = tuple(p for p in PROTOCOLS if is_classification(p) and not p.startswith("residues"))
_VALUES = tuple(p for p in PROTOCOLS if not is_classification(p) and not p.startswith("residues"))
_RESIDUES = tuple(p for p in PROTOCOLS if p.startswith("residues"))
_ITERATED = ("num_epochs", "epsilon", "patience", "learning_rate", "batch_size")
_NETWORK = (*_ITERATED, "use_class_weights", "optimizer_choice", "dropout_rate", "model_weights_init")
MODELS: dict[str, Kind] = {
    "LogReg": Kind(linear, _CLASSES + _VALUES, ("num_epochs", "epsilon", "use_class_weights")),
    "FNN": Kind(network("FNN"), _CLASSES + _VALUES, (*_NETWORK, "bottleneck_dim")),
    "DeeperFNN": Kind(network("DeeperFNN"), _CLASSES + _VALUES, (*_NETWORK, "bottleneck_dim")),
    "CNN": Kind(network("CNN"), tuple(p for p in PROTOCOLS if p.startswith("residue_")), (*_NETWORK, "bottleneck_dim")),
    "LightAttention": Kind(network("LightAttention"), _RESIDUES, _NETWORK),
    "GP": Kind(gaussian_process, ("sequence_to_value",), ("num_epochs", "learning_rate")),
    "Centroid": Kind(centroid, _CLASSES, ()),
}
#: Options that only some models act on.
PARTIAL = tuple(dict.fromkeys((*_NETWORK, "bottleneck_dim")))


def register(name: str, fit: Callable, protocols: tuple[str, ...] = PROTOCOLS, options: tuple[str, ...] = ()) -> None:
    """Adds a model: ``fit(train, val, options, classes) -> Fitted``."""
    MODELS[name] = Kind(fit, protocols, options)


def chosen(name: str, protocol: str, given: dict[str, Any]) -> Kind:
    """The model; raises if there is none of that name for the protocol, or if an option was given that it can't act on."""
    if name not in MODELS or protocol not in MODELS[name].protocols:
        raise ConfigError(f"{name} is no model for {protocol}; there are {sorted(k for k, m in MODELS.items() if protocol in m.protocols)}")
    if useless := [o for o in PARTIAL if given.get(o) not in (None, False) and o not in MODELS[name].options]:
        raise ConfigError(f"{name} can't act on {', '.join(useless)}")
    return MODELS[name]


def fit_predict(train: DataFrame, rows: DataFrame, classes: bool, seed: int = 42, features: str = "features", layers: tuple[int, ...] = ()) -> DataFrame:
    """``rows`` with pred: logistic or linear regression, or with ``layers`` a multilayer perceptron of that hidden shape."""
    options = {"num_epochs": 100, "epsilon": 1e-6, "patience": 10, "batch_size": 128, "seed": seed}
    return (perceptron(layers) if layers else linear)(train.where("label is not null"), None, options, classes, features).predict(rows)


def passes(fitted: list[Fitted], rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pass, pred of several fits of one model (of other seeds or samples): what a network with dropout gives in several forward passes."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [f.predict(rows).select(*keys, F.lit(i).alias("pass"), "pred") for i, f in enumerate(fitted)])


def external(rows: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any model over Arrow batches: ``predict`` gets a batch and returns one with ``schema``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return rows.mapInPandas(run, schema)
