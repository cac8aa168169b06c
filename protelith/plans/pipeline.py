"""Lazy step chain over records: validation, embedding, scaling, splitting, training, metrics."""

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sequence_hash
from ..functions.sequences import ALPHABET, mask_bits, residue_labels
from ..operators import baselines, embedders, metrics, results, splits, targets, uncertainty, validate, vectors
from ..sources import tables
from . import models, runs
from .config import Config, ConfigError, is_classification, is_per_residue, needs_residue_embeddings
from .training import measured, train


@dataclass(frozen=True)
class Context:
    """What steps hand on; DataFrames stay lazy until a metric is asked for."""

    config: Config
    records: DataFrame | None = None
    samples: DataFrame | None = None
    predictions: DataFrame | None = None
    results: dict[str, Any] = field(default_factory=dict)


Step = Callable[[Context], Context]


def validation(c: Context) -> Context:
    """Raises on records that break a rule; with ``ignore_file_inconsistencies`` repeated sequences and unreadable targets go instead."""
    protocol = c.config["protocol"]
    numeric, per_residue, records = not is_classification(protocol), is_per_residue(protocol), c.records
    target = lambda: validate.bad_targets(records, numeric, per_residue)
    if c.config["ignore_file_inconsistencies"]:
        records = records.join(target().select("seq_id"), "seq_id", "left_anti")
        if not c.config.values.get("interaction"):
            records = validate.unique_by_hash(records, "seq_id").drop("seq_hash")
    checks = {"letters": validate.bad_letters(records), "targets": target(), "sets": validate.missing_roles(records)}
    if not c.config.values.get("interaction"):
        checks["repeated sequences"] = validate.duplicate_sequences(records)
    if "mask" in records.columns:
        checks["masks without a residue"] = validate.masks_without_residues(records)
    if "embedding" in records.columns:
        checks["embeddings for some records only"] = validate.embeddings_all_or_none(records)
    for what, found in checks.items():
        validate.raise_on_violation(found, what)
    return replace(c, records=validate.route_sets(records))


def composition_embedding(records: DataFrame) -> DataFrame:
    """The mean one-hot vector of each sequence."""
    none = F.array_repeat(F.lit(0.0), len(ALPHABET))
    return embedders.pooled(embedders.one_hot_residues(records)).withColumn("embedding", F.coalesce("embedding", none))


#: By name, an embedder per sequence and one per residue.
EMBEDDERS: dict[str, tuple[Callable[[DataFrame], DataFrame] | None, Callable[[DataFrame], DataFrame] | None]] = {
    "one_hot_encoding": (composition_embedding, embedders.one_hot_residues),
    "random_embedder": (lambda r: embedders.random_vectors(r, "seq"), None),
}


def scale_embedder(scales: DataFrame) -> tuple:
    """An embedder pair from a table of residue scales, to be put into ``EMBEDDERS``."""
    return lambda r: embedders.pooled(embedders.scale_residues(r, scales)), lambda r: embedders.scale_residues(r, scales)


def _embedded(c: Context, records: DataFrame) -> DataFrame:
    per_residue = needs_residue_embeddings(c.config["protocol"])
    if "embedding" in records.columns:
        return records
    if path := c.config.values.get("embeddings_file"):
        wanted = records.select(sequence_hash(F.col("seq"), F.col("seq_id")).alias("seq_hash"))
        store = tables.read_embeddings(records.sparkSession, path, None if c.config["ignore_file_inconsistencies"] else wanted)
        return records.withColumn("seq_hash", sequence_hash(F.col("seq"), F.col("seq_id"))).join(store.select("seq_hash", "embedding"), "seq_hash").drop("seq_hash")
    name = c.config["embedder_name"]
    embed = EMBEDDERS[name][int(per_residue)] if name in EMBEDDERS else None
    if embed is None:
        raise ConfigError(f"no embedder {name} for {'residues' if per_residue else 'sequences'}; put one into EMBEDDERS")
    return embed(records)


def _whole_sequences(c: Context) -> bool:
    """Whether a sample is a sequence with a label for each residue."""
    return is_per_residue(c.config["protocol"]) and set(splits.parameter_values(c.config["model_choice"])) <= set(models.SEQUENCES)


def embedding(c: Context) -> Context:
    """A sample for each sequence, residue or interaction: seq_hash, seq_id, role, set_name, label, embedding."""
    protocol, records = c.config["protocol"], c.records
    key = sequence_hash(F.col("seq"), F.col("seq_id"))
    as_label = (lambda x: x) if is_classification(protocol) else (lambda x: x.try_cast("double"))
    if how := c.config.values.get("interaction"):
        return replace(c, samples=_interactions(c, records, how, as_label))
    rows = _embedded(c, records)
    if not is_per_residue(protocol):
        return replace(c, samples=rows.select(key.alias("seq_hash"), "seq_id", "role", "set_name", as_label(F.col("target")).alias("label"), "embedding"))
    labels = residue_labels(F.col("target")) if is_classification(protocol) else F.split("target", ";")
    with_masks = rows.withColumn("mask_bits", mask_bits(F.col("mask"))) if "mask" in rows.columns else rows.withColumn("mask_bits", F.lit(None).cast("array<int>"))
    lengths = with_masks.where("target is not null").withColumn("_n", F.size(labels)).where(F.col("_n") != F.size("embedding")).select("seq_id", "_n")
    validate.raise_on_violation(lengths, "targets of another length than their residues")
    if _whole_sequences(c):  # a sample is a sequence with all its residues; masked ones have no label
        known = F.transform(labels, lambda x, i: F.when(F.coalesce(F.get("mask_bits", i), F.lit(1)) == 1, as_label(x)))
        return replace(c, samples=with_masks.select(key.alias("seq_hash"), "seq_id", "role", "set_name", known.alias("label"), "embedding"))
    each = targets.exploded_residues(with_masks.withColumn("labels", F.coalesce(labels, F.transform("embedding", lambda x: F.lit(None).cast("string")))))
    each = each.select(F.concat_ws("/", key, "position").alias("seq_hash"), "seq_id", "position", "role", "set_name", as_label(F.col("label")).alias("label"), F.get("embedding", "position").alias("embedding"))
    return replace(c, samples=each)


def _interactions(c: Context, records: DataFrame, how: str, as_label) -> DataFrame:
    """A sample for each undirected pair of a record and its INTERACTOR; raises on missing partners and on pairs with several targets or sets."""
    partner = records.select(F.col("seq_id").alias("_id"), F.col("seq").alias("_seq")).dropDuplicates(["_id"])
    lost = records.join(partner, F.col("interactor") == F.col("_id"), "left_anti").select("seq_id", "interactor")
    validate.raise_on_violation(lost, "interactors that are no record")
    both = records.join(partner, F.col("interactor") == F.col("_id"))
    mine, theirs = sequence_hash(F.col("seq"), F.col("seq_id")), sequence_hash(F.col("_seq"), F.col("_id"))
    edges = both.select(F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b"), "target", "role", "set_name", F.least("seq_id", "_id").alias("seq_id"))
    per = edges.groupBy("a", "b").agg(F.countDistinct(F.struct(F.coalesce("target", F.lit("")), "role", "set_name")).alias("kinds"), F.min("target").alias("target"),
                                      F.min("role").alias("role"), F.min("set_name").alias("set_name"), F.min("seq_id").alias("seq_id"))
    validate.raise_on_violation(per.where("kinds > 1").select("a", "b"), "interactions with several targets or sets")
    distinct = validate.unique_by_hash(records.drop("interactor"), "seq_id")
    vectors_of = _embedded(c, distinct).select("seq_hash", "embedding")
    joined = targets.interaction_embeddings(per, vectors_of, how, "seq_hash")
    return joined.select(F.concat_ws("&", "a", "b").alias("seq_hash"), "seq_id", "role", "set_name", as_label(F.col("target")).alias("label"), "embedding")


def scaling(c: Context) -> Context:
    """Scaled by, and with ``pca`` projected on, what the training samples give."""
    train = lambda df: df.where("role = 'train'")
    if needs_residue_embeddings(c.config["protocol"]) and set(splits.parameter_values(c.config["model_choice"])) <= set(models.SEQUENCES):
        return _scaled_sequences(c, train(c.samples))
    validate.raise_on_violation(_other_widths(c.samples), "embeddings of several widths")
    fitted = vectors.fit_scaler(train(c.samples), c.config["scaling_method"])
    samples = vectors.scale(c.samples, fitted, out="features")
    c = replace(c, results=c.results | {"scaler": fitted})
    if c.config.values.get("dimension_reduction_method") == "pca":
        projection = vectors.fit_pca(train(samples), c.config["n_reduced_components"], "features")
        samples = vectors.project(samples, projection, "features", "features")
        explained = [r["explained"] for r in projection.orderBy("component").collect()]
        return _kept(replace(c, samples=samples, results=c.results | {"explained_variance": explained, "projection": projection}))
    return _kept(replace(c, samples=samples))


def _kept(c: Context) -> Context:
    """With ``output_dir`` the run's folder is begun, or taken up again; the scaler and the projection in it are those to use."""
    if not c.config.values.get("output_dir"):
        return c
    folder = runs.Folder(c.samples.sparkSession, c.config["output_dir"])
    folder.begin(c.config)
    for part in ("scaler", "projection"):
        if part in c.results and not folder.has(part):
            folder.write(part, c.results[part])
    return c


def _scaled_sequences(c: Context, train: DataFrame) -> Context:
    """Sequences of vectors, each vector scaled by what the training residues give."""
    residues = c.samples.select(F.explode("embedding").alias("embedding"))
    validate.raise_on_violation(_other_widths(residues), "embeddings of several widths")
    fitted = vectors.fit_scaler(train.select(F.explode("embedding").alias("embedding")), c.config["scaling_method"])
    return _kept(replace(c, samples=vectors.scale_sequences(c.samples, fitted, out="features"), results=c.results | {"scaler": fitted}))


def _other_widths(samples: DataFrame) -> DataFrame:
    widths = validate.embedding_widths(samples)
    return widths.agg(F.count("*").alias("widths"), F.min("width").alias("least"), F.max("width").alias("most")).where("widths > 1")


def splitting(c: Context) -> Context:
    """The classes that occur must be known before splits are trained; samples are written down, as every split reads them."""
    return replace(c, samples=c.samples.persist())


def training(c: Context) -> Context:
    """Fits every split; the best one predicts all samples outside of training and validation."""
    folder = runs.Folder(c.samples.sparkSession, c.config["output_dir"]) if c.config.values.get("output_dir") else None
    done = train(c.config, c.samples, folder)
    whole = _whole_sequences(c)
    predictions = measured(done.best.fitted.predict(c.samples.where("role not in ('train', 'val')")), whole)
    found = {"splits": done.metrics, "average": done.average, "best_split": done.best.name, "best_parameters": done.best.parameters,
             "searched": done.searched, "epochs": done.best.fitted.epochs, "best_epoch": done.best.fitted.best_epoch}
    return replace(c, predictions=predictions.persist(), results=c.results | found)  # metrics, baselines and intervals all read them


def testing(c: Context) -> Context:
    """Metrics of each test set with bootstrap intervals, and those of the baselines; with ``output_dir`` all of it is written there."""
    test, protocol, n = c.predictions.where("role = 'test'"), c.config["protocol"], c.config["bootstrapping_iterations"]
    naive = {"random_sampling": baselines.random_sampling} if is_classification(protocol) else {"uniform": baselines.uniform_between}
    samples = c.samples
    if _whole_sequences(c):
        samples = samples.select("role", "seq_hash", F.posexplode("label").alias("position", "label")).withColumn("seq_hash", F.concat_ws("/", "seq_hash", "position"))
    known, bare = samples.where("role = 'train' and label is not null"), test.drop("pred")
    said = {name: f(known, bare, "seq_hash", c.config["seed"]) for name, f in naive.items()}
    if not is_classification(protocol):
        said["mean_only"] = baselines.mean_of_train(known, bare)
    elif {r["label"] for r in known.select("label").distinct().limit(3).collect()} <= {"0", "1"}:
        said |= {"one_only": baselines.constant(bare, "1"), "zero_only": baselines.constant(bare, "0")}
    every = results.stacked([test.withColumn("model", F.lit("model")), *(p.withColumn("model", F.lit(k)) for k, p in said.items())])
    every = every.select("model", "set_name", "seq_hash", "label", "pred")
    found = metrics.evaluated(every, protocol, ["model", "set_name"])
    intervals = _bootstrapped(every, protocol, n, c.config["seed"]) if n else None
    if path := c.config.values.get("output_dir"):
        found.write.mode("overwrite").parquet(f"{path}/metrics")
        c.predictions.select("seq_id", "seq_hash", "set_name", "label", "pred").write.mode("overwrite").parquet(f"{path}/predictions")
    return replace(c, results=c.results | {"metrics": found.where("model = 'model'").drop("model"), "baselines": found.where("model <> 'model'"), "intervals": intervals,
                                           "set_sizes": results.set_sizes(c.samples)})


def _bootstrapped(rows: DataFrame, protocol: str, n: int, seed: int) -> DataFrame:
    """model, set_name, metric, mean, lower, upper over ``n`` resamples of each test set."""
    keys = ["model", "set_name"]
    numbered = splits._numbered(rows.where("label is not null"), ["seq_hash"], keys).withColumnRenamed("ordinal", "row_ix")
    drawn = uncertainty.resampled(numbered, keys, n, seed)
    kind = metrics.classification(metrics.confusion(drawn, [*keys, "iteration"]), [*keys, "iteration"]) if is_classification(protocol) else metrics.regression(drawn, [*keys, "iteration"])
    values = [x for x in kind.columns if x not in (*keys, "iteration")]
    long = kind.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values])).alias("m")).select(*keys, "m.*")
    return uncertainty.interval(long, [*keys, "metric"], "value")


DEFAULT: dict[str, Step] = {"validation": validation, "embedding": embedding, "scaling": scaling, "splitting": splitting, "training": training, "testing": testing}


def run(config: Config, records: DataFrame, steps: dict[str, Step] | None = None, **instead: Step) -> Context:
    """The steps in order; named ones can be replaced by keyword."""
    chain = dict(steps or DEFAULT)
    if unknown := set(instead) - set(chain):
        raise ValueError(f"no such steps: {sorted(unknown)}")
    context = Context(config, records)
    for name, step in (chain | instead).items():
        context = step(context)
    return context
