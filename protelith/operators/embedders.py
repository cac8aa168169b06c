"""Embeddings that need no model: one-hot, residue scales, seeded noise; batches for those that do."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.sequences import ALPHABET, UNKNOWN, letter_index, one_hot

DIMENSIONS = 128


def letters(seq: Column) -> Column:
    return F.filter(F.split(F.coalesce(seq, F.lit("")), ""), lambda x: x != "")


def one_hot_residues(records: DataFrame, seq: str = "seq", out: str = "embedding") -> DataFrame:
    """A vector of 0 and 1 for each residue."""
    return records.withColumn(out, F.transform(letters(F.col(seq)), lambda x: F.transform(one_hot(x), lambda v: v.cast("double"))))


def random_vectors(records: DataFrame, key: str, n: int = DIMENSIONS, seed: int = 42, out: str = "embedding") -> DataFrame:
    """``n`` numbers in [0, 1) from a hash of the seed, the key and the dimension: equal keys get equal vectors, anywhere."""
    return records.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: uniform(str(seed), F.col(key), i)))


def read_scales(spark: SparkSession, path: str) -> DataFrame:
    """(letter, values) of a matrix or table of residue scales in text form: a first line with the columns' names, then a letter and its numbers in each line.

    That is the format in which substitution matrices such as BLOSUM62 are distributed; lines that start with ``#`` are comments. Columns that are
    letters outside of the alphabet are left out, those of the alphabet come in its order; other columns keep theirs. A letter with two lines is an error.
    """
    whole = spark.read.text(path, wholetext=True).first()["value"]  # a line for each letter
    lines = [x.split() for x in whole.splitlines() if x.strip() and not x.startswith("#")]
    header, known = lines[0], [x[0] for x in lines[1:]]
    if twice := sorted({x for x in known if known.count(x) > 1}):
        raise ValueError(f"{path} has several lines for {', '.join(twice)}")
    by_letter = all(len(h) == 1 for h in header)
    order = [header.index(a) for a in ALPHABET if a in header] if by_letter else list(range(len(header)))
    return spark.createDataFrame([(x[0], [float(x[1 + i]) for i in order]) for x in lines[1:] if x[0] in ALPHABET], "letter string, values array<double>")


def scale_residues(records: DataFrame, scales: DataFrame, seq: str = "seq", unknown: str | None = UNKNOWN, out: str = "embedding") -> DataFrame:
    """The scales' values for each residue; letters without a row take that of ``unknown``, or zeros if it is None or has no row."""
    table = scales.agg(F.map_from_entries(F.collect_list(F.struct("letter", "values"))).alias("_t"), F.max(F.size("values")).alias("_w"))  # a row per letter at most
    zeros = F.array_repeat(F.lit(0.0), F.col("_w"))
    other = F.coalesce(F.try_element_at("_t", F.lit(unknown)), zeros) if unknown else zeros
    return (records.join(F.broadcast(table)).withColumn(out, F.transform(letters(F.col(seq)), lambda x: F.coalesce(F.try_element_at(F.col("_t"), x), other))).drop("_t", "_w"))


def pooled(records: DataFrame, vector: str = "embedding") -> DataFrame:
    """The mean over residues in place of a vector for each; null for a sequence without residues."""
    width = F.size(F.col(vector)[0])
    mean = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + F.get(x, i)) / F.size(vector))
    return records.withColumn(vector, F.when(F.size(vector) > 0, mean))


def without_positions(vectors: Column, drop: Column) -> Column:
    """Residue vectors without those at the positions (from 0) of ``drop``, as for special tokens."""
    return F.filter(vectors, lambda x, i: ~F.array_contains(drop, i))


def longest_first(records: DataFrame, seq: str = "seq", within: bool = False) -> DataFrame:
    """Sorted by descending length; ``within`` partitions only."""
    order = [F.desc(F.length(seq)), F.col(seq)]
    return records.sortWithinPartitions(*order) if within else records.orderBy(*order)


def budget_batches(records: DataFrame, keys: list[str], order: list[str], length: str, budget: int) -> DataFrame:
    """keys, batch (from 0), n, total: rows in ``order`` fill batches of fewer than ``budget`` residues in all; a longer one is a batch of its own.

    A batch is closed by the row that would reach the budget; a row over the budget doesn't close the batch around it, which goes on. Keys cut the
    table into what one worker gets.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(length).cast("long").alias("_l"))))
    none, number = F.array().cast("array<struct<batch:long,l:long>>"), lambda i: F.lit(i).cast("long")
    start = F.struct(number(-1).alias("open"), number(0).alias("used"), number(0).alias("next"), none.alias("done"))

    def put(s, x):
        alone = x["_l"] > budget
        opens = ~alone & ((s["open"] < 0) | (s["used"] + x["_l"] >= budget))
        batch = F.when(alone | opens, s["next"]).otherwise(s["open"])
        return F.struct(F.when(alone, s["open"]).otherwise(batch).alias("open"),
                        F.when(alone, s["used"]).when(opens, x["_l"]).otherwise(s["used"] + x["_l"]).alias("used"),
                        (s["next"] + (alone | opens).cast("long")).alias("next"),
                        F.array_append(s["done"], F.struct(batch.alias("batch"), x["_l"].alias("l"))).alias("done"))

    filled = records.groupBy(*keys).agg(F.aggregate(rows, start, put)["done"].alias("_d")).select(*keys, F.explode("_d").alias("_d"))
    return filled.groupBy(*keys, F.col("_d.batch").alias("batch")).agg(F.count("*").alias("n"), F.sum("_d.l").alias("total"))


def in_batches(records: DataFrame, embed: Callable[[list[str]], list], schema: str, seq: str = "seq", budget: int = 8192 * 6) -> DataFrame:
    """Any embedder over batches of fewer than ``budget`` residues: ``embed`` gets sequences and returns a vector (or one for each residue) for each.

    Each task sorts what it gets by length, so that batches hold sequences of like length, and streams it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, held, used = [None] * len(b), [], 0
            for i, s in enumerate(b[seq].fillna("")):
                if held and used + len(s) >= budget:
                    for at, v in zip(held, embed([b[seq].iloc[k] or "" for k in held])):
                        out[at] = v
                    held, used = [], 0
                held.append(i)
                used += len(s)
            for at, v in zip(held, embed([b[seq].iloc[k] or "" for k in held]) if held else []):
                out[at] = v
            yield b.assign(embedding=pd.Series(out, index=b.index, dtype=object))

    return longest_first(records, seq, within=True).mapInPandas(run, schema)


def masked(records: DataFrame, key: str, seq: str = "seq", share: float = 0.15, seed: int = 42, mask: str = "<mask>") -> DataFrame:
    """Adds masked (the text with some letters replaced) and targets (the letters' index where one was drawn, else -100).

    A letter is drawn with probability ``share``, and the one with the least number if none is; of those drawn, eight tenths become the mask token, one tenth a
    letter at random, one tenth stay. All numbers are hashes of the seed, the key and the position.
    """
    known = ALPHABET.replace(UNKNOWN, "")
    n = lambda what, i: uniform(f"{seed}{what}", F.col(key), i)
    drawn = records.withColumn("_l", letters(F.col(seq))).withColumn("_u", F.transform("_l", lambda x, i: n("d", i)))
    drawn = drawn.withColumn("_least", F.array_position("_u", F.array_min("_u")) - 1)
    chosen = drawn.withColumn("_d", F.transform("_u", lambda u, i: (u < share) | ((F.array_min("_u") >= share) & (i == F.col("_least")))))
    letter = lambda i: F.substring(F.lit(known), (F.floor(n("a", i) * len(known)) + 1).cast("int"), F.lit(1))
    new = F.zip_with(F.transform("_l", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), "_d", lambda s, d: F.when(
        d, F.when(n("r", s["i"]) < 0.8, mask).when(n("r", s["i"]) < 0.9, letter(s["i"])).otherwise(s["x"])).otherwise(s["x"]))
    targets = F.zip_with("_l", "_d", lambda x, d: F.when(d, letter_index(x).cast("int")).otherwise(-100))
    return chosen.withColumns({"masked": F.array_join(new, ""), "targets": targets}).drop("_l", "_u", "_least", "_d")


def store_name(embedder: str, reduced: bool, half: bool = False) -> str:
    """The file name of an embedding store; of a name with folders only the last part counts."""
    return ("reduced_" if reduced else "") + "embeddings_file_" + embedder.rstrip("/").split("/")[-1] + ("_half" if half else "") + ".parquet"


def store_path(folder: str, protocol: str, embedder: str, half: bool = False) -> str:
    """folder/protocol/embedder/name, reduced for protocols of one vector per sequence."""
    return "/".join([folder.rstrip("/"), protocol, embedder.rstrip("/").split("/")[-1], store_name(embedder, protocol.startswith("sequence"), half)])
