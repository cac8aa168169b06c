"""Assay tables, embedding stores, reports, subsets and the older three-file layout."""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import set_name

ASSAY = "mutant string, mutated_sequence string, DMS_score double"
_RESULTS = "results: map<string, map<string, double>>"
REPORT = (f"embedder_name string, training_date string, supervised_results map<string, struct<min_seq_len: int, max_seq_len: int, {_RESULTS}>>, "
          f"zeroshot_results map<string, struct<method: string, {_RESULTS}>>")
REPORT_FILES = "*report_*.json"


def read_assay(spark: SparkSession, path: str, single_only: bool = False) -> DataFrame:
    """A mutational scan; raises if a column is missing or no row is left."""
    found = spark.read.csv(path, header=True)
    missing = {c.split()[0] for c in ASSAY.split(", ")} - set(found.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    rows = found.select("mutant", "mutated_sequence", F.col("DMS_score").try_cast("double").alias("DMS_score"))
    if single_only:
        rows = rows.where(~F.col("mutant").contains(":"))
    if rows.isEmpty():
        raise ValueError("the assay is empty")
    return rows


def read_embeddings(spark: SparkSession, path: str, wanted: DataFrame | None = None, key: str = "seq_hash") -> DataFrame:
    """An embedding store; with ``wanted`` only its keys, all of which must be there."""
    store = spark.read.parquet(path)
    if wanted is None:
        return store
    absent = wanted.select(key).distinct().join(store, key, "left_anti")
    if (n := absent.count()):
        raise ValueError(f"{n} embeddings are missing")
    return store.join(wanted.select(key).distinct(), key, "left_semi")


def write_embeddings(embeddings: DataFrame, path: str, key: str = "seq_hash") -> None:
    (embeddings.select(key, "original_id", F.col("embedding").cast("array<float>").alias("embedding"))
     .write.option("compression", "zstd").parquet(path))


def check_cardinality(store: DataFrame, expected: int) -> None:
    if (n := store.count()) != expected:
        raise ValueError(f"{n} embeddings, expected {expected}")


def read_reports(spark: SparkSession, path: str, files: str = REPORT_FILES) -> DataFrame:
    """Benchmark reports of a file or folder; unreadable ones are left out, of equal (embedder, date) one stays."""
    return (spark.read.schema(REPORT).option("recursiveFileLookup", True).option("pathGlobFilter", files)
            .option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
            .where("embedder_name is not null").dropDuplicates(["embedder_name", "training_date"]))


def write_report(report: DataFrame, path: str) -> None:
    """A report, one row, as a JSON file that ``read_reports`` finds in the folder ``path``."""
    name = report.select(F.regexp_replace(F.concat_ws("_", "embedder_name", "training_date"), r"[^A-Za-z0-9_.-]+", "-")).first()[0]
    report.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")  # a row


def load_report(spark: SparkSession, path: str, embedder: str, date: str) -> DataFrame:
    """The report of that embedder and date under ``path``, or an empty one."""
    try:
        found = read_reports(spark, path, "*.json").where((F.col("embedder_name") == embedder) & (F.col("training_date") == date)).limit(1)
    except AnalysisException:  # no such folder
        found = spark.createDataFrame([], REPORT)
    empty = spark.createDataFrame([(embedder, date, {}, {})], REPORT)
    return empty if found.isEmpty() else found


def report_rows(reports: DataFrame) -> DataFrame:
    """embedder_name, mode, task, test_set, metric, value of all supervised and zero-shot results."""
    parts = []
    for mode in ("supervised", "zeroshot"):
        each = reports.select("embedder_name", F.lit(mode).alias("mode"), F.explode(f"{mode}_results").alias("task", "r"))
        parts.append(each.select("embedder_name", "mode", "task", F.explode("r.results").alias("test_set", "m")).select("embedder_name", "mode", "task", "test_set", F.explode("m").alias("metric", "value")))
    return reduce(DataFrame.unionByName, parts)


def read_assay_reference(spark: SparkSession, path: str) -> DataFrame:
    """assay (file name) and taxon of a reference table; raises if a column is missing."""
    found = spark.read.csv(path, header=True)
    if missing := {"DMS_id", "taxon"} - set(found.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return found.select(F.concat("DMS_id", F.lit(".csv")).alias("assay"), "taxon")


def write_parameters(scaler: DataFrame, path: str) -> None:
    """A fitted scaler as a table; nothing is pickled."""
    scaler.select("dim", "shift", "scale").write.mode("overwrite").parquet(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def subset_set(name: str) -> str:
    """The set that a named subset stands for, by the start of its name; unknown ones are test sets of their own."""
    low = name.lower()
    return next((s for s in ("train", "val", "test", "pred") if low.startswith(s)), f"test-{low}")


def union_subsets(subsets: dict[str, DataFrame], sequence: str, target: str | None = None, mask: str | None = None) -> DataFrame:
    """Named subsets as records with their set; at least three subsets with all asked columns are needed."""
    if len(subsets) < 3:
        raise ValueError("at least three subsets are needed")
    parts = []
    for name, df in subsets.items():
        if absent := {c for c in (sequence, target, mask) if c} - set(df.columns):
            raise ValueError(f"{name}: missing columns {sorted(absent)}")
        optional = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")  # noqa: E731, B023
        parts.append(df.select(F.col(sequence).alias("seq"), optional(target).alias("target"), optional(mask).alias("mask"), F.lit(subset_set(name)).alias("set")))
    return reduce(DataFrame.unionByName, parts)


def legacy_merge(sequences: DataFrame, labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Sequences (seq_id, seq, target, set), overridden by labels (seq_id, label, set), with masks (seq_id, mask).

    ``conflict`` marks records whose files name different sets.
    """
    out = sequences.join(labels.select("seq_id", F.col("label").alias("_label"), F.col("set").alias("_set")), "seq_id", "left")
    out = out.withColumn("conflict", F.coalesce(set_name(F.col("set")) != set_name(F.col("_set")), F.lit(False)))
    out = out.withColumns({"target": F.coalesce("_label", "target"), "set": set_name(F.coalesce("_set", "set"))}).drop("_label", "_set")
    return out.join(masks, "seq_id", "left") if masks is not None else out.withColumn("mask", F.lit(None).cast("string"))
