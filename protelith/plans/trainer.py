"""Data-parallel minibatch training of small networks, many fits in one scan, and predictions with dropout.

Rows are dealt by a hash of their key into shards of about ``SHARD_ROWS``, a partition each, whatever the cluster, so results repeat. An epoch is one Spark job:
each task takes the parameters of all fits that still run, makes minibatch steps of each over its shard's rows in that epoch's order, and gives the new parameters
and optimiser states back, which are averaged by rows (local steps, synchronised once an epoch; one shard is plain minibatch training). The same scan measures the validation rows
with the parameters that the epoch starts from. Folds and parameter grids are fits over the same rows, told apart by a code for each row and fit,
so k folds times a grid take as many scans as the longest of them has epochs.

Partial sums meet in the square root of the shards before they reach the driver, which sees parameters only. A lost executor costs the epoch's tasks that it had; with
``commit`` a fit can go on from any finished epoch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.networks import STATES, Batch, Network, cross_entropy, softmax, squared_error, step

SHARD_ROWS = 4096
TRAIN, CHECK = 1, 2  # codes of ``uses``; any other number leaves the row out


@dataclass(frozen=True)
class Fit:
    """One network to fit; ``classes`` (0 for values) and ``class_weights`` choose the loss."""

    name: str
    network: Network
    classes: int = 0
    optimizer: str = "adam"
    learning_rate: float = 1e-3
    batch_size: int = 128
    epochs: int = 200
    patience: int = 10
    epsilon: float = 0.001
    seed: int = 42
    weights_init: str = "default"
    class_weights: tuple[float, ...] | None = None

    def loss(self, labels: list[np.ndarray], positions: int) -> Callable:
        if self.network.per_position:
            y = np.full((len(labels), positions), np.nan)
            for i, own in enumerate(labels):
                y[i, :len(own)] = own
        else:
            y = np.array([own[0] if len(own) else np.nan for own in labels])
        return cross_entropy(y, np.asarray(self.class_weights) if self.class_weights else None) if self.classes else squared_error(y)


@dataclass
class State:
    """Where a fit stands: ``now`` has the parameters and the optimiser's rows, ``best`` the parameters of the best epoch."""

    now: np.ndarray
    best: np.ndarray
    steps: float = 0.0
    epoch: int = 0  # epochs that are done
    best_epoch: int = 0
    best_loss: float = math.inf
    left: int = 0
    stopped: bool = False
    seen: list[tuple[int, float, float]] = field(default_factory=list)  # epoch, training and validation loss

    @staticmethod
    def first(fit: Fit) -> State:
        p = fit.network.initial(fit.seed, fit.weights_init)
        return State(np.vstack([p[None], np.zeros((STATES[fit.optimizer], len(p)))]), p.copy(), left=fit.patience)

    def after(self, fit: Fit, now: np.ndarray, steps: float, training: float, check: float) -> State:
        """The state after an epoch. ``check`` was measured with the parameters that the epoch began with, which are kept if it is the best by a share of ``epsilon``."""
        training, check = float(training), float(check)
        loss = training if math.isnan(check) else check
        better = loss < self.best_loss * (1 - fit.epsilon) if math.isfinite(self.best_loss) else math.isfinite(loss)
        kept = {"best": self.now[0].copy(), "best_epoch": self.epoch, "best_loss": loss, "left": fit.patience} if better else {"left": self.left - 1}
        over = (not better and self.left == 0) or self.epoch + 1 >= fit.epochs
        return replace(self, now=now, steps=steps, epoch=self.epoch + 1, stopped=over, seen=[*self.seen, (self.epoch, training, loss)], **kept)


def rows_of(batch: pa.RecordBatch, network: Network, x: str) -> list[np.ndarray]:
    """The feature arrays of a batch: (features,) or, flattened in the column, (positions, features)."""
    column = batch.column(x)
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum([0, *sizes])
    return [values[a:b].reshape(-1, network.features) if network.positions else values[a:b] for a, b in zip(ends, ends[1:])]


def stacked(network: Network, rows: list[np.ndarray], seeds: np.ndarray | None) -> Batch:
    if not network.positions:
        return Batch(np.stack(rows), None, seeds)
    sizes = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), max(1, sizes.max()), rows[0].shape[1]))
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    return Batch(x, sizes, seeds)


PART = "fit int, slot int, weight double, steps double, state binary, loss double, loss_n double, check double, check_n double"


def _epoch(fits: list[Fit], handed, epoch: int, slots: int, x: str):
    """What a task does in an epoch: minibatch steps over the rows of its shard, batch by batch, in the order in which they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        given = handed.value  # fit number: (state, steps)
        own = {i: state.copy() for i, (state, _) in given.items()}
        steps = {i: t for i, (_, t) in given.items()}
        sums = {i: np.zeros(5) for i in given}  # rows, loss, its weight, check, its weight
        waiting: dict[int, list] = {i: [] for i in given}

        def one(i: int, rows: list, learn: bool) -> None:
            fit = fits[i]
            seeds = np.array([s for _, _, s in rows], np.uint64) + np.uint64((fit.seed * 1_000_003 + epoch) % (1 << 32)) if learn else None
            batch = stacked(fit.network, [r for r, _, _ in rows], seeds)
            loss = fit.loss([y for _, y, _ in rows], batch.x.shape[1])
            n = sum(np.count_nonzero(~np.isnan(y)) for _, y, _ in rows)
            if not n:
                return
            if learn:
                value, gradient = fit.network.gradient(own[i][0], batch, loss)
                steps[i] += 1
                step(fit.optimizer, own[i], gradient, steps[i], fit.learning_rate)
                sums[i] += (len(rows), value * n, n, 0, 0)
            else:
                value, _ = loss(fit.network.outputs(given[i][0][0], batch))
                sums[i] += (0, 0, 0, value * n, n)

        for batch in batches:
            seeds = batch.column("_seed").to_numpy(zero_copy_only=False).view(np.uint64)
            labels, uses = batch.column("_y").to_pylist(), batch.column("_uses").to_pylist()
            features = rows_of(batch, fits[0].network, x)
            for i in given:
                for learn, code in ((True, TRAIN), (False, CHECK)):
                    rows = [(features[k], np.array([np.nan if v is None else v for v in labels[k]], float), seeds[k]) for k in range(len(features)) if uses[k][i] == code and len(features[k])]
                    if learn:
                        rows = waiting[i] + rows
                        whole = len(rows) - len(rows) % fits[i].batch_size
                        waiting[i] = rows[whole:]
                        rows = rows[:whole]
                    for at in range(0, len(rows), fits[i].batch_size):
                        one(i, rows[at:at + fits[i].batch_size], learn)
        for i, rows in waiting.items():
            if rows:
                one(i, rows, True)
        slot = TaskContext.get().partitionId() % slots
        out = [(i, slot, s[0], s[0] * steps[i], (s[0] * own[i]).tobytes(), *s[1:]) for i, s in sums.items() if s[0] or s[4]]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[c.split()[0] for c in PART.split(", ")]).astype({"fit": "int32", "slot": "int32"}), preserve_index=False) if out else _none()

    return run


def _none() -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist([], pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PART.split(", ")]))


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["weight", "loss", "check"])  # one order of summing, whatever came first
    total = group.iloc[[0]].copy()
    for c in ("weight", "steps", "loss", "loss_n", "check", "check_n"):
        total[c] = group[c].sum()
    total["state"] = [np.sum([np.frombuffer(s) for s in group["state"]], axis=0).tobytes()]
    return total


def dealt(rows: DataFrame, key: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with _seed, a partition for each shard, persisted."""
    shards = max(1, math.ceil(rows.count() / shard_rows))
    seed = F.xxhash64(F.col(key).cast("string"))
    return rows.withColumn("_seed", seed).repartitionById(shards, F.pmod("_seed", F.lit(shards)).cast("int")).persist()


def train(rows: DataFrame, fits: list[Fit], key: str = "seq_hash", features: str = "features", shard_rows: int = SHARD_ROWS,
          states: list[State] | None = None, commit: Callable[[int, list[State]], None] | None = None) -> list[State]:
    """The states of all fits when they have stopped. ``rows``: key, features (double array; sequences of vectors flattened), _y (double array of labels or class
    numbers, null ones unknown) and _uses (a code for each fit). ``states`` go on from there; ``commit`` gets the epoch and all states after each epoch."""
    if len({(f.network.positions, f.network.features) for f in fits}) > 1:
        raise ValueError("fits of one scan read the same features")
    table = dealt(rows.select(key, features, "_y", "_uses"), key, shard_rows)
    states = list(states) if states else [State.first(f) for f in fits]
    sc, slots = rows.sparkSession.sparkContext, max(1, math.isqrt(table.rdd.getNumPartitions()))
    try:
        for epoch in range(min((s.epoch for s in states if not s.stopped), default=0), max(f.epochs for f in fits)):
            running = {i: (s.now, s.steps) for i, s in enumerate(states) if not s.stopped and s.epoch == epoch}
            if not running:
                break
            handed = sc.broadcast(running)
            ordered = table.sortWithinPartitions(F.xxhash64(F.lit(epoch), "_seed"), F.col(key).cast("string"))
            parts = ordered.mapInArrow(_epoch(fits, handed, epoch, slots, features), PART).groupBy("fit", "slot").applyInPandas(_summed, PART)
            found = {i: own for i, own in parts.toPandas().groupby("fit")}
            handed.destroy()
            for i in running:
                if i not in found or not found[i]["weight"].sum():
                    raise ValueError(f"{fits[i].name} has no row to train on")
                t = _summed(found[i]).iloc[0]
                now = np.frombuffer(t["state"]).reshape(states[i].now.shape) / t["weight"]
                states[i] = states[i].after(fits[i], now, t["steps"] / t["weight"], t["loss"] / max(t["loss_n"], 1), t["check"] / t["check_n"] if t["check_n"] else math.nan)
            if commit:
                commit(epoch, states)
    finally:
        table.unpersist()
    return states


def outputs(rows: DataFrame, network: Network, parameters: np.ndarray, classes: bool, features: str = "features", passes: int = 0, key: str = "seq_hash", seed: int = 42) -> DataFrame:
    """``rows`` with outputs: probabilities of classes, or values. An array; for networks with an output for each position an array of them for each, and with
    ``passes`` one for each forward pass with dropout, whose masks depend on key and pass only. All passes are made in one scan."""
    if passes and not network.dropout:
        raise ValueError("forward passes with dropout need a network that has some")
    if passes and network.per_position:
        raise ValueError("forward passes are for networks with one output for a row")
    nested = network.per_position or passes
    handed = rows.sparkSession.sparkContext.broadcast(parameters)
    extra = ArrayType(ArrayType(DoubleType())) if nested else ArrayType(DoubleType())
    seeded = rows.withColumn("_seed", F.xxhash64(F.col(key).cast("string")))
    schema = StructType([*rows.schema.fields, StructField("outputs", extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = rows_of(batch, network, features)
                seeds = batch.column("_seed").to_numpy(zero_copy_only=False).view(np.uint64)
                usable = [i for i, r in enumerate(x) if len(r)]
                found: list = [None] * len(x)
                for p in range(passes or 1):
                    if not usable:
                        break
                    given = stacked(network, [x[i] for i in usable], seeds[usable] + np.uint64((seed + 1) * 1_000_003 + p) if passes else None)
                    out = network.outputs(parameters_of(), given)
                    out = softmax(out) if classes else out
                    for i, o in zip(usable, out):
                        if passes:
                            found[i] = [*(found[i] or []), o.tolist()]
                        else:
                            found[i] = o[:len(x[i])].tolist() if network.per_position else o.tolist()
                kind = pa.list_(pa.list_(pa.float64())) if nested else pa.list_(pa.float64())
                columns = [batch.column(f.name) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [f.name for f in schema.fields])

    def parameters_of() -> np.ndarray:
        return handed.value

    return seeded.mapInArrow(run, schema)


def coded(labels: Column, names: list, classes: bool) -> Column:
    """A label, or an array of them, as the doubles that training takes; classes by their place in ``names``, others unknown."""
    if not classes:
        return F.transform(labels, lambda v: v.cast("double"))
    known = F.array(*[F.lit(n) for n in names])
    return F.transform(labels, lambda v: F.nullif(F.array_position(known, v) - 1, F.lit(-1)).cast("double"))


def summaries(passes: Column, classes: bool, confidence_level: float = 0.05) -> Column:
    """mean, std, lower, upper of each output over the passes (bounds are interpolated quantiles), and for classes the BALD score."""
    if not 0 < confidence_level < 1:
        raise ValueError(f"the confidence level lies between 0 and 1, not at {confidence_level}")
    n = F.size(passes)
    places = F.sequence(F.lit(0), F.size(passes[0]) - 1)
    over = lambda f: F.aggregate(passes, F.lit(0.0), lambda acc, p: acc + f(p))
    mean = F.transform(places, lambda k: over(lambda p: p[k]) / n)
    std = F.transform(places, lambda k: F.sqrt(over(lambda p: F.pow(p[k] - over(lambda q: q[k]) / n, 2)) / F.greatest(n - 1, F.lit(1))))

    def quantile(q: float) -> Column:
        at = (n - 1) * q
        low = F.floor(at).cast("int")
        of = lambda v: v[low] + (at - low) * (v[F.least(low + 1, n - 1)] - v[low])
        return F.transform(places, lambda k: F.transform(F.array(F.array_sort(F.transform(passes, lambda p: p[k]))), of)[0])

    fields = [mean.alias("mean"), std.alias("std"), quantile(confidence_level / 2).alias("lower"), quantile(1 - confidence_level / 2).alias("upper")]
    if classes:
        entropy = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, v: acc - v * F.log(v + 1e-10))
        fields.append((entropy(mean) - over(entropy) / n).alias("bald"))
    return F.struct(*fields)
