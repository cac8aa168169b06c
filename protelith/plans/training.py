"""Training over splits: hold-out, k-fold, leave-p-out and nested search.

Networks are fitted together: all splits, and in a nested search all parameters of all inner folds, are fits over the same rows and take one scan an epoch (``together``).
Other models are fitted in a loop over plans of the splits, a Spark job each. Rows are never collected. Metrics of all splits are rows (split_name, metric, value).
"""

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..operators import metrics, results, splits
from . import models, runs, trainer
from .config import Config, ConfigError, is_classification, search_space
from .models import Fitted, chosen


@dataclass(frozen=True)
class Split:
    name: str
    train: DataFrame
    val: DataFrame | None


@dataclass(frozen=True)
class SplitResult:
    name: str
    parameters: dict[str, Any]
    metrics: DataFrame  # metric, value of the validation set
    fitted: Fitted


@dataclass(frozen=True)
class Trained:
    """The results of all outer splits, the best of them, and the metrics of all (split_name, metric, value)."""

    splits: list[SplitResult]
    best: SplitResult
    metrics: DataFrame
    average: DataFrame
    searched: list[tuple[str, dict[str, Any], float]] = field(default_factory=list)  # outer split, parameters, mean metric


def held_out(samples: DataFrame, key: str = "seq_hash") -> Iterator[Split]:
    yield Split("hold_out", samples.where("role = 'train'"), samples.where("role = 'val'"))


def folds(samples: DataFrame, k: int, repeat: int = 1, stratified: bool = False, key: str = "seq_hash", seed: int = 42) -> Iterator[Split]:
    """Train and validation rows together, dealt into k folds, ``repeat`` times."""
    inside = samples.where("role in ('train', 'val')")
    for r in range(repeat):
        keys = inside.select(key, *(["label"] if stratified else [])).distinct()
        order = [hash_int(str(seed), F.lit(r), F.col(key)), F.col(key)] if repeat > 1 else None
        dealt = splits.k_fold(keys, k, key, order, "label" if stratified else None).select(key, F.col("fold").alias("_fold")).cache()
        each = inside.join(dealt, key)
        for f in range(k):
            name = "-".join(["k_fold"] + ["strat"] * stratified + ["rep"] * (repeat > 1) + [str(f + 1)] + [str(r + 1)] * (repeat > 1))
            yield Split(name, each.where(F.col("_fold") != f).drop("_fold"), each.where(F.col("_fold") == f).drop("_fold"))
        dealt.unpersist()


def left_out(samples: DataFrame, p: int, key: str = "seq_hash") -> Iterator[Split]:
    """Every choice of p keys is the validation set once; the plan is a table, read one split at a time."""
    inside = samples.where("role in ('train', 'val')")
    plan = splits.leave_p_out(inside.select(key).distinct(), p, key).orderBy("split_name")
    for row in plan.toLocalIterator():
        out = [row[f"id_{i}"] for i in range(1, p + 1)]
        yield Split(row["split_name"], inside.where(~F.col(key).isin(out)), inside.where(F.col(key).isin(out)))


def planned(config: Config, samples: DataFrame) -> Iterator[Split]:
    cv = config.cross_validation
    if cv["method"] == "hold_out":
        return held_out(samples)
    if cv["method"] == "leave_p_out":
        return left_out(samples, cv["p"])
    return folds(samples, cv["k"], cv.get("repeat") or 1, bool(cv.get("stratified")), seed=config["seed"])


def fitted(config: Config, parameters: dict[str, Any], split: Split) -> SplitResult:
    """A model with ``parameters`` in place of the configuration's, fitted on the split's train rows, measured on its validation rows."""
    o = config.values | parameters
    given = {k: v for k, v in config.given.items()} | parameters
    protocol = o["protocol"]
    kind = chosen(o["model_choice"], protocol, given)
    train = split.train.where("label is not null")
    if (n := o["limited_sample_size"]) > 0:
        train = splits.random_rows(train, n, "seq_hash", o["seed"])
    options = o | {"learning_rate": given.get("learning_rate")}
    model = kind.fit(train, split.val, options, is_classification(protocol))
    return SplitResult(split.name, parameters, metrics.evaluated(model.predict(split.val), protocol), model)


def _value(result: SplitResult, choose_by: str) -> float:
    found = result.metrics.where(F.col("metric") == choose_by).first()
    if found is None:
        raise ConfigError(f"choose_by: {choose_by} is no metric of this protocol")
    return found["value"]


def _values(predicted: list[DataFrame], protocol: str, choose_by: str) -> list[float]:
    """The metric to choose by of each table of predictions, all measured together."""
    rows = [p.select(F.lit(i).alias("_fit"), "seq_hash", "label", "pred") for i, p in enumerate(predicted)]
    every = reduce(DataFrame.unionByName, rows).persist()
    found = {r["_fit"]: r["value"] for r in metrics.evaluated(every, protocol, ["_fit"], only=choose_by).where(F.col("metric") == choose_by).collect()}
    every.unpersist()
    if len(found) < len(predicted):
        raise ConfigError(f"choose_by: {choose_by} is no metric of this protocol")
    return [found[i] for i in range(len(predicted))]


def _better(choose_by: str, a: float, b: float) -> bool:
    return a < b if choose_by in metrics.ASCENDING else a > b


def searched(config: Config, outer: Split, number: int) -> tuple[dict[str, Any], list[tuple[str, dict[str, Any], float]]]:
    """The parameters with the best mean metric over inner folds of an outer split's train rows, and all means."""
    cv, choose_by = config.cross_validation, choose(config)
    grid = splits.parameter_grid(search_space(config))
    if cv["search_method"] == "random_search":
        grid = splits.random_subset(grid, cv["n_max_evaluations_random"], config["seed"])
    best, best_value, seen = None, None, []
    for parameters in grid:
        inner = folds(outer.train.withColumn("role", F.lit("train")), cv["nested_k"], 1, bool(cv.get("stratified")), seed=config["seed"])
        values = [_value(fitted(config, parameters, s), choose_by) for s in inner]
        mean = sum(values) / len(values)
        seen.append((outer.name, parameters, mean))
        if best is None or _better(choose_by, mean, best_value):
            best, best_value = parameters, mean
    return best, seen


def choose(config: Config) -> str:
    """The metric to choose by: that of the configuration; where that is the loss, which not every model has, accuracy or the squared error."""
    name = config.cross_validation.get("choose_by") or "loss"
    return name if name != "loss" else "accuracy" if is_classification(config["protocol"]) else "mse"


def _dealing(config: Config) -> dict[str, Any]:
    cv = config.cross_validation
    return {"k": cv["k"], "repeat": cv.get("repeat") or 1, "stratified": bool(cv.get("stratified")), "seed": config["seed"]}


def _fold_column(rows: DataFrame, inside, k: int, repeat: int, r: int, stratified: bool, seed: int, out: str, key: str = "seq_hash") -> DataFrame:
    """``rows`` with the fold of those that are ``inside``, dealt as ``folds`` deals them; null for the others."""
    keys = rows.where(inside).select(key, *(["label"] if stratified else [])).distinct()
    order = [hash_int(str(seed), F.lit(r), F.col(key)), F.col(key)] if repeat > 1 else None
    return rows.join(splits.k_fold(keys, k, key, order, "label" if stratified else None).select(key, F.col("fold").alias(out)), key, "left")


def _codes(config: Config, samples: DataFrame) -> tuple[DataFrame, list[tuple[str, Any]]]:
    """``samples`` with what tells the outer splits apart, and (name, code column) of each: 1 for training, 2 for validation, 0 for neither."""
    code = lambda check, learn: F.when(check, trainer.CHECK).when(learn, trainer.TRAIN).otherwise(0)
    inside = F.col("role").isin("train", "val")
    if config.cross_validation["method"] == "hold_out":
        return samples, [("hold_out", code(F.col("role") == "val", F.col("role") == "train"))]
    d, found = _dealing(config), []
    for r in range(d["repeat"]):
        samples = _fold_column(samples, inside, d["k"], d["repeat"], r, d["stratified"], d["seed"], f"_outer{r}")
        for f in range(d["k"]):
            name = "-".join(["k_fold"] + ["strat"] * d["stratified"] + ["rep"] * (d["repeat"] > 1) + [str(f + 1)] + [str(r + 1)] * (d["repeat"] > 1))
            found.append((name, code(F.col(f"_outer{r}") == f, F.col(f"_outer{r}") != f)))
    return samples, found


def can_train_together(config: Config) -> bool:
    from ..operators.splits import parameter_values

    choices = set(parameter_values(config["model_choice"]))
    return (config.cross_validation["method"] != "leave_p_out" and config["limited_sample_size"] <= 0 and choices <= set(models.NETWORKS)
            and len({c in models.SEQUENCES for c in choices}) == 1 and len({c == "CNN" for c in choices}) == 1)


@dataclass(frozen=True)
class Planned:
    """A network to fit: the split it belongs to, its parameters and its place in the scan."""

    split: str
    parameters: dict[str, Any]
    inner: int | None
    code: Any


def _fit_all(config: Config, rows: DataFrame, width: int, names: tuple[str, ...], plan: list[Planned], states=None, commit=None) -> tuple[list[Fitted], list[trainer.State]]:
    given, fits, options = config.given, [], []
    for one in plan:
        o = config.values | one.parameters
        chosen(o["model_choice"], o["protocol"], given | one.parameters)
        weighed = rows.where(one.code == trainer.TRAIN) if o.get("use_class_weights") else None
        fits.append(models.network_fit(o["model_choice"], one.split, width, names, o, weighed))
        options.append(o)
    found = trainer.train(rows.withColumn("_uses", F.array(*[p.code.cast("int") for p in plan])), fits, features="_x", states=states, commit=commit)
    return [models.network_fitted(o["model_choice"], width, names, o, s) for o, s in zip(options, found)], found


def together(config: Config, samples: DataFrame, folder=None) -> Trained:
    """All splits' networks in one scan an epoch; with a nested search first those of all inner folds and parameters, likewise. In a run's ``folder`` the choice of the search, the states
    after every few epochs of the outer splits, and the finished models are committed, and what is there is not done again."""
    protocol, cv, choose_by = config["protocol"], config.cross_validation, choose(config)
    from ..operators.splits import parameter_values

    per_position = "CNN" in parameter_values(config["model_choice"])
    names = models.class_names(samples.where("role in ('train', 'val')"), per_position) if is_classification(protocol) else ()
    rows, outer = _codes(config, samples)
    ready, width = models.prepared(rows, parameter_values(config["model_choice"])[0], names)
    ready = ready.persist()
    best, seen = {name: {} for name, _ in outer}, []
    if folder and all(folder.has(f"models/{name}") for name, _ in outer):
        return _chosen([_loaded(folder, name) for name, _ in outer], choose_by, _searched(folder)[1], folder)
    if folder and folder.has("searched"):
        best, seen = _searched(folder)
    elif cv.get("nested"):
        grid = splits.parameter_grid(search_space(config))
        if cv["search_method"] == "random_search":
            grid = splits.random_subset(grid, cv["n_max_evaluations_random"], config["seed"])
        plan, inner_rows = [], ready
        for n, (name, code) in enumerate(outer):
            inner_rows = _fold_column(inner_rows, code == trainer.TRAIN, cv["nested_k"], 1, 0, bool(cv.get("stratified")), config["seed"], f"_inner{n}")
            for parameters in grid:
                plan += [Planned(name, parameters, i, F.when(F.col(f"_inner{n}") == i, trainer.CHECK).when(F.col(f"_inner{n}").isNotNull(), trainer.TRAIN).otherwise(0)) for i in range(cv["nested_k"])]
        inner_rows = inner_rows.persist()  # else each use of them deals all folds again
        fitted_all, _ = _fit_all(config, inner_rows, width, names, plan)
        values = _values([measured(f.predict(inner_rows.where(p.code == trainer.CHECK)), per_position) for p, f in zip(plan, fitted_all)], protocol, choose_by)
        inner_rows.unpersist()
        means = {}
        for p, v in zip(plan, values):
            means.setdefault((p.split, repr(p.parameters)), (p.parameters, []))[1].append(v)
        for (name, _), (parameters, each) in means.items():
            mean = sum(each) / len(each)
            seen.append((name, parameters, mean))
            if not best[name] or _better(choose_by, mean, best[name][1]):
                best[name] = (parameters, mean)
        best = {name: b[0] for name, b in best.items()}
        if folder:
            rows = [(name, json.dumps(p), float(m), best[name] == p) for name, p, m in seen]
            folder.write("searched", samples.sparkSession.createDataFrame(rows, "split_name string, parameters string, mean double, best boolean"))
    plan = [Planned(name, best[name], None, code) for name, code in outer]
    def commit(epoch: int, states: list[trainer.State]) -> None:
        if (epoch + 1) % runs.EVERY == 0:
            folder.keep_states(epoch, states)

    states = folder.states() if folder else None
    if states is None and (path := config.values.get("pretrained_model")):
        states = [_pretrained(ready.sparkSession, path, config, plan[0], width, names)]
    fitted_all, _ = _fit_all(config, ready, width, names, plan, states, commit if folder else None)
    done = [_finished(p.split, p.parameters, metrics.evaluated(measured(f.predict(ready.where(p.code == trainer.CHECK)), per_position), protocol), f, folder) for p, f in zip(plan, fitted_all)]
    return _chosen(done, choose_by, seen, folder)


def _pretrained(spark, path: str, config: Config, one: Planned, width: int, names: tuple[str, ...]) -> trainer.State:
    """A first state with the parameters of a finished run's best network, which must have the same shape."""
    model = runs.Run(spark, path).trained()
    o = config.values | one.parameters
    fit = models.network_fit(o["model_choice"], one.split, width, names, o | {"use_class_weights": False})
    if (model.choice, model.features, model.names, len(model.parameters)) != (o["model_choice"], width, names, fit.network.size):
        raise ConfigError(f"{path} holds another network than the one to train")
    state = trainer.State.first(fit)
    state.now[0], state.best = model.parameters, model.parameters.copy()
    return state


def _finished(name: str, parameters: dict[str, Any], found: DataFrame, fitted: Fitted, folder) -> SplitResult:
    """The result, committed where there is a folder and the model can be saved."""
    if folder and isinstance(fitted.model, models.Trained):
        found = folder.keep_model(name, parameters, fitted, found)
    return SplitResult(name, parameters, found.cache(), fitted)


def _loaded(folder, name: str) -> SplitResult:
    parameters, fitted, found = folder.model(name)
    return SplitResult(name, parameters, found, fitted)


def _searched(folder) -> tuple[dict[str, Any], list[tuple[str, dict[str, Any], float]]]:
    if not folder.has("searched"):
        return {}, []
    rows = folder.read("searched").collect()
    return {r["split_name"]: json.loads(r["parameters"]) for r in rows if r["best"]}, [(r["split_name"], json.loads(r["parameters"]), r["mean"]) for r in rows]


def measured(predicted: DataFrame, per_position: bool) -> DataFrame:
    """Rows to measure: of a sequence with a label for each residue a row for each residue."""
    if not per_position:
        return predicted
    kept = [c for c in predicted.columns if c not in ("seq_hash", "label", "pred", "_x", "_y", "features", "embedding") and not c.startswith(("_outer", "_inner"))]
    each = predicted.select("seq_hash", *kept, "label", F.posexplode("pred").alias("position", "pred"))
    return each.select(F.concat_ws("/", "seq_hash", "position").alias("seq_hash"), *kept, "position", F.get("label", "position").alias("label"), "pred")


def _chosen(done: list[SplitResult], choose_by: str, seen: list, folder=None) -> Trained:
    if not done:
        raise ValueError("there is no split to train on")
    best, best_value = None, None
    for result in done:
        value = _value(result, choose_by)
        if best is None or _better(choose_by, value, best_value):
            best, best_value = result, value
    if folder and isinstance(best.fitted.model, models.Trained):
        folder.write("best", folder.spark.createDataFrame([(best.name,)], "split_name string"))
        folder.drop("states")
    every = reduce(DataFrame.unionByName, [r.metrics.select(F.lit(r.name).alias("split_name"), "metric", "value") for r in done])
    return Trained(done, best, every, results.average_over_splits(every), seen)


def train(config: Config, samples: DataFrame, folder=None) -> Trained:
    """Fits every split; the best one by the chosen metric is kept for the test sets. ``folder`` (a ``runs.Folder``) gets each finished split, and gives those that are finished."""
    if can_train_together(config):
        return together(config, samples, folder)
    nested, choose_by, done, seen = bool(config.cross_validation.get("nested")), choose(config), [], []
    for i, split in enumerate(planned(config, samples)):
        if folder and folder.has(f"models/{split.name}"):
            done.append(_loaded(folder, split.name))
            continue
        parameters = {}
        if nested:
            parameters, more = searched(config, split, i + 1)
            seen += more
        result = fitted(config, parameters, split)
        done.append(_finished(result.name, parameters, result.metrics, models.savable(result.fitted), folder))
    return _chosen(done, choose_by, seen, folder)
