"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become words (runs of letters and digits; a number with grouped or decimal digits is one word), lower-cased. In the
template form numbers (in digits or English words), names (capitalised words) and units after a number become typed
placeholders, one word for one word, so both forms keep the same positions. Every window of eight words of every document is
hashed in both forms, in one pass, and joined with the benchmark's windows. A document leaks an item

* plainly, if the item's plain windows that it holds cover at least half of the item's words, or
* as a template, if at one alignment the item's template windows cover at least half of its words and the slots
  are consistent: one value in the item always stands for one value in the document, and distinct names
  stay distinct. Any capitalised word may be a name, so that names at the start of a sentence or of the text count; what is
  no name must stand for itself as any value must.

A bitmap of the hashes of the benchmark's windows, of one size whatever their number, is broadcast and drops most other windows beside their text; of those that are left only the
window's own words move to a shuffled join with the benchmark's windows, where they are compared word by word. So a row that moves has a bounded size, however long its text.

Rows: null or short texts have no windows; texts of any length are read whole; an item shorter than a window is one window of
its own length; an item without a word never matches, null item ids are skipped, and several items may be leaked at once; rows are judged by their own
text, whatever other rows have the same or a null doc_id; repeated rows give one result; extra columns stay in
``drop_leaks`` and are left out of ``leaks``; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, possibly_among

WINDOW, COVERAGE = 8, 0.5
BREAK = r"[^\p{L}\p{N}]+"
NUMBER, NAME, UNIT = "zznumber", "zzname", "zzunit"
NUMBERS = ("zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
           "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion")
UNITS = ("mm|cm|km|m|inches|inch|feet|foot|yards?|miles?|mg|kg|g|grams?|kilograms?|pounds?|ounces?|ml|l|lit(?:er|re)s?|gallons?|"
         "seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|degrees?|kmh|mph|watts?|volts?|joules?")


def joined_numbers(text: Column) -> Column:
    """The text with 1,000 and 3.5 as one word each."""
    return F.regexp_replace(text, r"(?<=\p{Nd})[.,](?=\p{Nd})", "")


def templated(text: Column) -> Column:
    """The text with placeholders; as many words as before, in the same places."""
    numbered = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])(?:\p{{Nd}}+|(?i:{NUMBERS}))(?![\p{{L}}\p{{N}}])", NUMBER)
    measured = F.regexp_replace(numbered, rf"(?<={NUMBER}[\s-]{{1,3}})(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.regexp_replace(measured, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", NAME)


def words(text: Column) -> Column:
    return F.split(F.lower(text), BREAK)


def _hash(array: str, at: Column | str, length: int) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(length)])


def _slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """The windows of all items: form, h, item_id, length, n_words, wpos, and the window's words in both forms."""
    clean = F.regexp_replace(joined_numbers(F.coalesce(F.col(text), F.lit(""))), rf"^{BREAK}|{BREAK}$", "")
    items = (benchmark.select(F.col(item_id).alias("item_id"), clean.alias("t")).where("item_id is not null and t <> ''").distinct()
             .select("item_id", words(F.col("t")).alias("p"), words(templated(F.col("t"))).alias("t")))
    each = items.withColumn("length", F.least(F.size("p"), F.lit(WINDOW))).withColumn("n_words", F.size("p"))
    each = each.withColumn("wpos", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("length"))))
    cutout = lambda c: F.slice(F.col(c), F.col("wpos") + 1, F.col("length"))
    each = each.select("item_id", "length", "n_words", "wpos", cutout("p").alias("plain"), cutout("t").alias("template"))
    hashed = lambda c: F.coalesce(*[F.when(F.col("length") == n, _hash(c, F.lit(0), n)) for n in range(1, WINDOW + 1)])
    return each.select("*", F.explode(F.array(F.struct(F.lit("plain").alias("form"), hashed("plain").alias("h")),
                                              F.struct(F.lit("template").alias("form"), hashed("template").alias("h")))).alias("f")).select("*", "f.*").drop("f")


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` (keys and text): keys, pos, the document's words there, and the item's window, for each window in common in either form."""
    keys = [c for c in docs.columns if c != "text"]
    body = joined_numbers(F.coalesce(F.col("text"), F.lit("")))
    each = docs.select(*keys, words(body).alias("p"), words(templated(body)).alias("t")).select("*", F.posexplode("p").alias("pos", "_w")).drop("_w")
    # The placeholders' window is another one only if it has a slot.
    both = [F.struct(F.lit(k).alias("length"), F.when(F.col("pos") + k <= F.size("p"), _hash(c, "pos", k)).alias("h")) for k in lengths for c in "pt"]
    keep = F.array_distinct(F.array(*both)) if len(lengths) > 1 else F.array(*both)
    each = each.select("*", F.explode(keep).alias("w")).select(*keys, "p", "t", "pos", "w.length", "w.h").where("h is not null")
    met = possibly_among(each, "h", windows.select("h"))
    there = lambda c: F.slice(F.col(c), F.col("pos") + 1, F.col("length"))
    met = met.select(*keys, "pos", "h", there("p").alias("theirs"), there("t").alias("their_form")).distinct()
    found = met.join(windows, "h")
    same = F.when(F.col("form") == "plain", F.col("theirs") == F.col("plain")).otherwise(F.col("their_form") == F.col("template"))
    return found.where(same).select(*keys, "pos", "theirs", "item_id", "form", "wpos", "length", "n_words", "plain", "template")


def _covered(spots: Column) -> Column:
    """Words under windows of one length at distinct places: array of (wpos, length)."""
    placed = F.array_sort(spots)
    return F.aggregate(placed, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct(
        (s["n"] + x["wpos"] + x["length"] - F.greatest(s["end"], x["wpos"])).alias("n"), (x["wpos"] + x["length"]).alias("end")))["n"]


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, item_id: str, item_text: str) -> DataFrame:
    """keys, item_id, form, n_matched, n_words, coverage of ``docs`` (keys and text)."""
    keys = [c for c in docs.columns if c != "text"]
    windows = cut(_items(benchmark, item_id, item_text))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW rows
    hits = cut(_hits(docs, windows, lengths or [WINDOW]))
    spot = F.collect_set(F.struct("wpos", "length"))  # as many as the item has windows, at most
    tallied = [_covered(spot).alias("covered"), F.countDistinct("wpos").alias("n_matched"), F.max("n_words").alias("n_words")]
    enough = F.col("covered") >= coverage * F.col("n_words")
    plain = hits.where("form = 'plain'").groupBy(*keys, "item_id").agg(*tallied).where(enough).withColumn("form", F.lit("plain"))
    aligned = hits.where("form = 'template'").withColumn("shift", F.col("pos") - F.col("wpos"))
    met = aligned.groupBy(*keys, "item_id", "shift").agg(*tallied).where(enough)
    slot = F.explode(F.filter(F.arrays_zip("template", "plain", "theirs"), lambda s: _slot(s["template"])))
    pairs = aligned.select(*keys, "item_id", "shift", slot.alias("s")).select(*keys, "item_id", "shift", "s.*").distinct()
    named = F.col("template") == NAME
    unsound = pairs.groupBy(*keys, "item_id", "shift").agg(
        (F.count("*") > F.countDistinct("template", "plain")).alias("two_values"),
        (F.countDistinct(F.when(named, F.struct("plain", "theirs"))) > F.countDistinct(F.when(named, F.col("theirs")))).alias("names_mixed")).where("two_values or names_mixed")
    same = [met[c].eqNullSafe(unsound[c]) for c in (*keys, "item_id", "shift")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    template = met.join(unsound, condition, "left_anti").withColumn("form", F.lit("template")).drop("shift")
    best = F.max(F.struct((F.col("form") == "plain").alias("plain"), "covered", "n_matched", "n_words", "form"))
    return plain.unionByName(template).groupBy(*keys, "item_id").agg(best.alias("b")).select(
        *keys, "item_id", "b.form", "b.n_matched", "b.n_words", (F.col("b.covered") / F.col("b.n_words")).alias("coverage"))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, form (plain or template), n_matched (windows), n_words (of the item), coverage (share of its words): the documents that leak an item."""
    return _leaks(_keyed(docs, doc_id, text), benchmark, coverage, item_id, item_text).drop("_k1", "_k2")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(body).alias("_k1"), F.xxhash64(F.lit(1), body).alias("_k2"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no item."""
    lost = _leaks(_keyed(docs, text, text).drop("doc_id"), benchmark, COVERAGE, "item_id", "text").select("_k1", "_k2").distinct()
    body = F.coalesce(docs[text], F.lit(""))
    return docs.join(lost, (F.xxhash64(body) == lost["_k1"]) & (F.xxhash64(F.lit(1), body) == lost["_k2"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
