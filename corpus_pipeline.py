"""A cleaning and packing pipeline over documents: toxicity, near-duplicates, repeated strings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of ``documents``; n_chars follows the text.

Rows: null texts count as empty and stay (one of them, as near-duplicates of each other); rows without a doc_id stay until
they are packed; repeated rows are one group of near-duplicates; rows of one doc_id with different texts are judged each by its own; a document of which
the repeats leave nothing but blanks goes; texts of any length are read whole; an empty table passes all stages; columns beyond those of ``documents``
stay until the last stage.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protelith.llm import decontaminate, packing, simhash, suffixes, toxicity
from protelith.llm.common import shared_folder, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def whole_characters(text: Column) -> Column:
    """Bytes as text without the parts of characters that a cut has left; replacement characters of the text itself stay."""
    escape, lost = "\ue000", "\ufffd"
    marked = F.replace(F.replace(text, F.lit(escape), F.lit(escape + "a")), F.lit(lost), F.lit(escape + "b"))
    whole = F.translate(F.make_valid_utf8(marked), lost, "")
    return F.replace(F.replace(whole, F.lit(escape + "b"), F.lit(lost)), F.lit(escape + "a"), F.lit(escape))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier document holds are cut out; documents of which nothing is left go."""
    small_batches(spark)
    cut = suffixes.remove_repeats(docs)
    text = F.col("_kept").cast("string")
    cut = cut.withColumn("text", F.when(F.col("_n_removed") > 0, whole_characters(text)).otherwise(text))
    cut = cut.where((F.col("_n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids, each with its sequence and offset."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", remove_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the network nor the hashes; tests/llm/test_pipeline.py compares each stage with a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
