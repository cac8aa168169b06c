"""Removal of repeated passages: seed and extend over winnowed anchors.

A window is ``MATCH`` consecutive words. In each window the ``GRAM``-word gram with the least hash is its anchor (the first of equal ones), so equal
windows have the same anchor at the same place, and the windows of one anchor stand next to each other: they are its stretch. The steps:

1. each document's anchors are found, each with its stretch and a hash of all words in it, and with the document's digest;
2. seeds: documents are joined on the anchors that several of them hold (minimum and maximum of doc_id by anchor, no pairs);
3. extension: matches are extended from the anchor both ways to the ends of the stretch. Where whole stretches are equal, which the hash shows, the smallest
   doc_id keeps its own and all others lose theirs, whatever the number of copies. Of stretches that differ, each window is a candidate, and of equal windows the one
   with the smallest doc_id stays; only documents that hold the first copy of such a stretch are read again for this;
4. stretches and windows that are lost are merged into maximal repeats, none shorter than a window.

Groups are met by partial aggregates and joins that can be split, never gathered: a passage of a third of all documents costs each task one row by anchor. Anchors and windows
are compared by two 64-bit hashes together.

Rows: a null text has no words; texts of any length are hashed by segments; a null doc_id is neither smaller nor larger than another, so such a row neither loses nor causes
removals; rows of equal doc_id never remove from each other, and repeated rows are treated alike; an empty table gives an empty result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, possibly_among, release, small_batches

MATCH, GRAM = 50, 16
SEGMENT_BYTES, SEGMENT_WORDS, KNOWN_WORDS = 4 << 20, 1 << 18, 1 << 18
U64 = np.uint64
HIGH, LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)
_blank = re.compile(rb"[\x20\x09-\x0D]")


class _Hashes(dict):
    """Hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by segments that end at a blank."""
    at = 0
    while at < len(raw):
        end = _blank.search(raw, at + SEGMENT_BYTES)
        end = end.start() if end else len(raw)
        yield raw[at:end].split()
        at = end + 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(31))) * U64(0xC2B2AE3D27D4EB4F)
        return (h ^ (h >> U64(29))) * U64(0x165667B19E3779F9)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive entries, put together from runs of powers of two."""
    n = len(words) - length + 1
    out, at, runs, size = None, 0, {1: words}, 1
    while 2 * size <= length:
        runs[2 * size] = _mix(runs[size][:-size], runs[size][size:])
        size *= 2
    for size in sorted(runs, reverse=True):
        if length & size:
            piece = runs[size][at:at + n]
            out = piece if out is None else _mix(out, piece)
            at += size
    return out


def stretches(words: np.ndarray, match: int = MATCH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, hash of the stretch, first and last window start, hashes of all windows from ``base`` on, base) of a document's word hashes, by segments."""
    for base in range(0, len(words) - match + 1, SEGMENT_WORDS):
        part = words[base:base + SEGMENT_WORDS + match - 1]
        grams, windows = run_hashes(part, gram), run_hashes(part, match)
        low = (grams & HIGH) | np.arange(len(grams), dtype=U64)
        span, width = match - gram + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        at = (low & LOW).astype(np.int64)
        turn = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.r_[0, turn], np.r_[turn - 1, len(at) - 1]
        shape = ((last - first) * match + at[first] - first).astype(U64)
        yield grams[at[first]], _mix(_mix(windows[first], windows[last]), shape), first + base, last + base, windows, base


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


DIGEST = "doc_id long, version long, n_words long, sha256 string, anchors array<long>, stretches array<long>, firsts array<int>, lasts array<int>"
WINDOWS = "anchor long, window long, doc_id long, version long, start int"


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), kind))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: its digest and its anchors with their stretches."""
    none = np.empty(0, np.int64)
    for batch in batches:
        sizes, digests, found = [], [], ([], [], [], [])
        for text in batch.column(2):
            sha, hashes = hashlib.sha256(), []
            for words in words_of(text.as_py()):
                if words:
                    sha.update(b" " * bool(hashes) + b" ".join(words))
                    hashes.append(_hashed(words))
            h = np.concatenate(hashes) if hashes else none.astype(U64)
            own = [(a.view(np.int64), r.view(np.int64), first, last) for a, r, first, last, _, _ in stretches(h)]
            for column, parts in zip(found, zip(*own) if own else ([none],) * 4):
                column.append(np.concatenate(parts))
            sizes.append(len(h)), digests.append(sha.hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), _lists(found[0], pa.int64()), _lists(found[1], pa.int64()),
                   _lists(found[2], pa.int32()), _lists(found[3], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGEST.split(", ")])
        release()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the wanted anchors."""
    for batch in batches:
        ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out = [[np.empty(0, np.int64)] for _ in range(5)]
        for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3))):
            wanted = np.sort(wanted.values.to_numpy(zero_copy_only=False))
            h = [_hashed(words) for words in words_of(text.as_py())]
            for anchor, _, first, last, windows, base in stretches(np.concatenate(h)):
                anchor = anchor.view(np.int64)
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor)
                size = (last - first + 1)[hit]
                start = np.repeat(first[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                for column, values in zip(out, (np.repeat(anchor[hit], size), windows[start - base].view(np.int64), np.full(len(start), ids[i]), np.full(len(start), versions[i]), start)):
                    column.append(values)
        kinds = (pa.int64(),) * 4 + (pa.int32(),)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(out, kinds)], [c.split()[0] for c in WINDOWS.split(", ")])
        release()


def _merged(spans: pd.Series) -> pd.DataFrame:
    """Packed spans of each document as maximal runs in order, and the words in them."""
    runs, sizes = [], []
    for packed in spans:
        s = np.sort(np.asarray(packed, np.int64))
        start, end = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
        new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
        start, end = start[new], end[np.r_[new[1:] - 1, len(end) - 1]]
        runs.append(start << 32 | end), sizes.append(int((end - start).sum()))
    return pd.DataFrame({"n_removed": sizes, "spans": pd.Series(runs, dtype=object)})


def _kept_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The words outside the packed spans, joined by one blank."""
    out = []
    for text, packed in zip(texts, spans):
        words = [w for part in words_of(text) for w in part]
        s = np.asarray(packed, np.int64)
        ends = [0, *(s & 0xFFFFFFFF).tolist()]
        out.append(b" ".join(w for a, b in zip(ends, [*(s >> 32).tolist(), len(words)]) for w in words[a:b]))
    release()
    return pd.Series(out, dtype=object)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("version"), body.alias("text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Digests, a row for each of ``docs`` (doc_id, version, n_words, sha256 of its words joined by one blank), and what is lost: doc_id, version, n_removed,
    spans (maximal repeats in order, each packed as first word << 32 | word after the last)."""
    keyed = _keyed(docs, doc_id, text)
    digests = cut(keyed.mapInArrow(_digests, DIGEST))
    found = digests.where("doc_id is not null and size(anchors) > 0").select(
        "doc_id", "version", F.inline(F.arrays_zip("anchors", "stretches", "firsts", "lasts")).alias("anchor", "stretch", "first", "last"))
    several = lambda df, *key: df.groupBy(*key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    seeds = cut(several(found, "anchor").where("low < high").select("anchor"))
    met = cut(possibly_among(found, "anchor", seeds).join(seeds, "anchor"))
    span = lambda first, end: F.shiftleft(first.cast("long"), 32).bitwiseOR(end.cast("long")).alias("span")

    classes = cut(several(met, "anchor", "stretch"))
    alike = met.join(classes.where("low < high"), ["anchor", "stretch"]).where("doc_id > low").select("doc_id", "version", span(F.col("first"), F.col("last") + MATCH))

    unlike = classes.groupBy("anchor").agg(F.min("low").alias("a_low"), F.max("high").alias("a_high"), F.count("*").alias("n")).where("n > 1 and a_low < a_high").select("anchor")
    unlike = cut(unlike)  # a join of what was written can be split by Spark where one anchor is everywhere
    open_ = met.join(classes, ["anchor", "stretch"]).where("doc_id = low").join(unlike, "anchor", "left_semi")
    wanted = cut(open_.groupBy("doc_id", "version").agg(F.collect_set("anchor").alias("wanted")))
    read = possibly_among(keyed, "version", wanted.select("version")).join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "wanted")
    windows = cut(read.mapInArrow(_windows, WINDOWS))
    first = several(windows, "anchor", "window").where("low < high").select("anchor", "window", "low")
    apart = windows.join(first, ["anchor", "window"]).where("doc_id > low").select("doc_id", "version", span(F.col("start"), F.col("start") + MATCH))

    merge = F.pandas_udf(_merged, "n_removed long, spans array<long>")
    lost = alike.unionByName(apart).groupBy("doc_id", "version").agg(F.collect_list("span").alias("spans")).select("doc_id", "version", merge("spans").alias("m"))
    return digests.select("doc_id", "version", "n_words", "sha256"), cut(lost.select("doc_id", "version", "m.*"))


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: doc_id, n_words, n_removed, spans (packed), kept (the words left of a document that loses some of them, else null) and
    kept_sha256 (of the words left, joined by one blank)."""
    digests, lost = repeats(docs, doc_id, text)
    all_rows = digests.join(lost, ["doc_id", "version"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    whole = all_rows.where("n_removed = 0 or n_removed = n_words").select(
        "doc_id", "n_words", "n_removed", "spans", F.lit(None).cast("string").alias("kept"), F.when(F.col("n_removed") == 0, F.col("sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"))
    some = lost.join(digests.select("doc_id", "version", "n_words").distinct(), ["doc_id", "version"]).where("n_removed < n_words")
    part = possibly_among(_keyed(docs, doc_id, text), "version", some.select("version")).join(some, ["doc_id", "version"])
    part = part.select("doc_id", "n_words", "n_removed", "spans", F.pandas_udf(_kept_words, "binary")("text", "spans").cast("string").alias("kept"))
    return whole.unionByName(part.withColumn("kept_sha256", F.sha2("kept", 256)))


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
