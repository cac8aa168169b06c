"""Annotated FASTA: one row per record, attributes in the header line."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the format writes an attribute.
ATTRIBUTE = r"([A-Z_]+)=([^ ]+)"


def _stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_records(records: DataFrame, multiline: str = "concat") -> DataFrame:
    """seq_id, seq, attributes from rows ``value`` that each hold a record without its ``>``.

    ``multiline``: "concat" joins the sequence's lines, "last" keeps the last one. Of an attribute given twice the later counts.
    """
    if multiline not in ("concat", "last"):
        raise ValueError(multiline)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: _stripped(x) != "")
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    seq = F.array_join(F.transform(body, _stripped), "") if multiline == "concat" else F.when(F.size("lines") > 1, _stripped(F.element_at("lines", -1))).otherwise("")
    return (records.withColumn("lines", lines).where(F.size("lines") > 0).withColumn("header", _stripped(F.col("lines")[0]))
            .select(F.regexp_extract("header", r"^\S+", 0).alias("seq_id"), seq.alias("seq"), attributes(F.col("header")).alias("attributes")))


def attributes(header: Column) -> Column:
    keys, values = (F.regexp_extract_all(header, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def read_fasta(spark: SparkSession, path: str, multiline: str = "concat") -> DataFrame:
    """seq_id, seq, attributes, and the columns target, set, mask, interactor. ``>`` may stand at line starts only."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(_stripped(F.col("value")) != "")
    return promoted(parse_records(raw, multiline))


def promoted(records: DataFrame) -> DataFrame:
    return records.withColumns({k.lower(): F.try_element_at("attributes", F.lit(k)) for k in ("TARGET", "SET", "MASK", "INTERACTOR")})


def rendered(records: DataFrame) -> DataFrame:
    """A column value with the text of each record, attribute keys in upper case and sorted."""
    entries = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(F.upper(e["key"]), F.lit("="), e["value"])))
    return records.select(F.concat(F.lit(">"), F.concat_ws(" ", F.array_append(F.array("seq_id"), F.array_join(entries, " "))), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))


def write_fasta(records: DataFrame, path: str) -> None:
    rendered(records).write.text(path)


def filter_fasta(spark: SparkSession, source: str, target: str, predicate: Column) -> tuple[int, int]:
    """Writes the records for which ``predicate`` holds; how many were kept, of how many."""
    records = read_fasta(spark, source)
    counts = records.agg(F.count_if(predicate).alias("kept"), F.count(F.lit(1)).alias("n")).first()
    write_fasta(records.where(predicate), target)
    return counts["kept"], counts["n"]


def from_sequences(spark: SparkSession, sequences: "list[str] | dict[str, str]") -> DataFrame:
    """Records from a list, named Seq0, Seq1, ..., or from a dict by id."""
    named = sequences.items() if isinstance(sequences, dict) else ((f"Seq{i}", s) for i, s in enumerate(sequences))
    return spark.createDataFrame([(k, v) for k, v in named], "seq_id string, seq string").withColumn("attributes", F.create_map().cast("map<string,string>"))
