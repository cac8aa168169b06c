"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into quantile bins, and cyclic boosting adds one shallow tree after
another, feature by feature, to that feature's lookup table; then the pairs of features whose joint
table explains most of what is left get two-dimensional tables in the same way. A score is the sigmoid
of the sum of looked-up values, added for whole batches at a time.

The model is fitted on the driver from the features of at most ``MAX_LABELLED`` labelled documents (those
with the lowest seeded hash of doc_id). All texts are scored in full.

Rows: a null or empty text has the features of no words; null labels are no labels, and of several labels of a doc_id the highest counts; repeated rows
and equal texts score alike; a value on a bin's edge falls into the upper bin; an empty table gives an empty result; without labels of both kinds every score is 0.5; extra columns stay.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import remainder

MAX_LABELLED, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
SEED = 20240611
#: Frequent function words of four languages.
COMMON = frozenset("the of and to in is that for it was on with as be by are de la le et les des en un une du que qui pour dans par sur "
                   "der die und das ist von mit den für auf ein eine zu el y los las con se del".split())
FEATURES = ("log_words", "word_length", "word_length_sd", "upper", "digits", "symbols", "bars", "bangs", "stops", "other_marks", "newlines",
            "non_ascii", "log_lines", "repeated_lines", "distinct_words", "top_word", "same_word_again", "common_words", "line_words", "upper_words")
_letters = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_symbols = np.zeros(256, bool)
_symbols[list(b"#*$%&<>@^~=+\\{}[]_")] = True
_marks = np.zeros(256, bool)
_marks[list(b",;:'\"?-()/`")] = True


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    size = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    tokens = raw.split()
    n = max(1, len(tokens))
    words = _letters.findall(raw.lower())
    counts = Counter(words)
    lengths = np.fromiter(map(len, tokens), float, len(tokens)) if tokens else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = sum(k for w, k in ((w, counts.get(w.encode(), 0)) for w in COMMON))
    again = sum(map(bytes.__eq__, tokens, tokens[1:]))
    upper = sum(1 for t in tokens if len(t) > 1 and t.isupper())
    w = max(1, len(words))
    return [
        np.log1p(len(tokens)), min(lengths.mean(), 40.0), min(lengths.std(), 40.0), c[65:91].sum() / size, c[48:58].sum() / size,
        c[_symbols].sum() / size, c[124] / size, c[33] / size, c[46] / size, c[_marks].sum() / size, c[10] / size, c[128:].sum() / size,
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / w**0.8, max(counts.values(), default=0) / w,
        again / n, common / w, len(tokens) / max(1, len(lines)), upper / n,
    ]


def _step_tree(g: np.ndarray, h: np.ndarray, cuts: int = 2, least: float = 4.0) -> np.ndarray:
    """The values of a shallow tree over bins with gradient sums ``g`` and weights ``h``: greedy cuts, Newton leaves."""
    edges = [0, len(g)]
    G, H = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            m = np.arange(a + 1, b)
            m = m[(H[m] - H[a] >= least) & (H[b] - H[m] >= least)] if len(m) else m
            if len(m):
                gain = value(a, m) + value(m, b) - value(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float = 4.0) -> tuple[float, np.ndarray]:
    """The gain and values of the best cut of both axes into four leaves."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = (x[:-1, :-1] for x in (G, H))
    quads = [(a, b), (G[:-1, -1:] - a, H[:-1, -1:] - b), (G[-1:, :-1] - a, H[-1:, :-1] - b),
             (G[-1, -1] - G[:-1, -1:] - G[-1:, :-1] + a, H[-1, -1] - H[:-1, -1:] - H[-1:, :-1] + b)]
    gain = sum(np.where(w >= least, s * s / (w + 1.0), 0) for s, w in quads)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(g.shape)
    for k, (r, c) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        s, w = quads[k][0][i, j], quads[k][1][i, j]
        out[r, c] = s / (w + 1.0) if w >= least else 0.0
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Bin edges and lookup tables from features [n, features] and labels 0 or 1."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return {}
    edges = [np.unique(np.quantile(f, np.arange(1, BINS) / BINS)) for f in x.T]
    coarse = [np.unique(np.quantile(f, np.arange(1, PAIR_BINS) / PAIR_BINS)) for f in x.T]
    bins = [np.searchsorted(e, f, "right") for e, f in zip(edges, x.T)]
    wide = [np.searchsorted(e, f, "right") for e, f in zip(coarse, x.T)]
    base = float(np.log(y.mean() / (1 - y.mean())))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)
    sums = lambda b, v, n: np.bincount(b, v, n)
    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _step_tree(sums(bins[j], y - p, len(table)), sums(bins[j], p * (1 - p), len(table)))
            table += step
            total += step[bins[j]]
    p = 1 / (1 + np.exp(-total))
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)

    def joint(i, j, v):
        a, b = shape(i, j)
        return sums(wide[i] * b + wide[j], v, a * b).reshape(a, b)

    ranked = sorted(((_quadrants(joint(i, j, y - p), joint(i, j, p * (1 - p)))[0], i, j) for i in range(len(edges)) for j in range(i)
                     if min(shape(i, j)) > 1), reverse=True)[:PAIRS]
    pairs = {(i, j): np.zeros(shape(i, j)) for _, i, j in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in pairs.items():
            p = 1 / (1 + np.exp(-total))
            step = RATE * _quadrants(joint(i, j, y - p), joint(i, j, p * (1 - p)))[1]
            table += step
            total += step[wide[i], wide[j]]
    return {"base": base, "edges": edges, "coarse": coarse, "tables": tables, "pairs": pairs}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if not model:
        return np.full(len(x), 0.5)
    total = np.full(len(x), model["base"])
    for f, e, t in zip(x.T, model["edges"], model["tables"]):
        total += t[np.searchsorted(e, f, "right")]
    wide = [np.searchsorted(e, f, "right") for e, f in zip(model["coarse"], x.T)]
    for (i, j), t in model["pairs"].items():
        total += t[wide[i], wide[j]]
    return 1 / (1 + np.exp(-total))


def with_features(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return docs.withColumn(out, of(F.col(text)))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "quality") -> dict:
    """A model from the labelled documents for which ``use`` holds."""
    known = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y is not null")
    known = known.where(use) if use is not None else known
    sample = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(MAX_LABELLED)
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("doc_id", "features", "y").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit(np.array(rows["features"].tolist()).reshape(-1, len(FEATURES)), rows["y"].to_numpy())


def with_scores(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(shared.value, np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, scores(F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)
    return with_scores(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
