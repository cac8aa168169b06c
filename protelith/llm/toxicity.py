"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a trained word vector, a trained mean of vectors of its runs of three to five
characters, and how far it and those runs stand out among toxic training documents. The network reads
windows of 32 words that start every 24 words (the last one ends with the text), and a document's score
is that of its highest window. Each distinct word's input projection is computed once a task, so scoring a
window costs the recurrent steps alone.

The network is fitted on the driver from a bounded, stratified sample of labelled documents: at most
``MAX_TOXIC`` and ``MAX_CLEAN`` documents (those with the lowest seeded hash of doc_id), with all their windows. Labels belong to documents, so the windows that stand
for a toxic document are those that score highest, first by that measure, then by the network. All texts are
scored in full.

Rows: a null text or one without a word scores 0; null labels are no labels, and of several labels of a doc_id the highest
counts; repeated rows and equal texts score alike; without labels of both kinds every score is 0; extra columns stay; an empty
table gives an empty result.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LENGTH, STRIDE = 32, 24
LEAST = 4  # documents that a word of the vocabulary is in
MAX_TOXIC, MAX_CLEAN, FOLDS = 700, 1400, 4
VOCABULARY, GRAMS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 20_000, 1 << 15, 4, 4, 8, 8
CACHE = 200_000  # words kept in a task
STEP = 500  # documents scored at a time
SEED = 20240517
CAUTION = 4


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows of ``n`` words."""
    if n <= LENGTH:
        return [0] if n else []
    starts = list(range(0, n - LENGTH, STRIDE))
    return [*starts, n - LENGTH]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of three to five characters of each word with its ends marked: flat, each word's start and size."""
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    length = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(length), length)
    word = np.repeat(np.arange(len(words)), length)
    run, of, found = c[:-1] * 31 + c[1:], [], []
    for k, factor in ((3, 7), (4, 11), (5, 13)):
        if len(c) < k:
            break
        run = (run[:-1] * 31 + c[k - 1:]) % 1_000_003
        inside = np.flatnonzero(np.arange(len(run)) + k <= ends[:len(run)])
        of.append(word[inside])
        found.append(run[inside] * factor % GRAMS)
    of, found = np.concatenate(of), np.concatenate(found)
    size = np.bincount(of, minlength=len(words))
    return found[np.argsort(of, kind="stable")], np.cumsum(size) - size, size


class Inputs:
    """Words to rows of (vocabulary index, character runs, fixed inputs).

    The fixed inputs of training documents come from the other folds' labels (``fold``), those of all other
    documents from all labels; else the network would trust words that it has seen in one document.
    """

    def __init__(self, documents: Iterable[set[str]], toxic: np.ndarray):
        toxic = np.asarray(toxic, bool)
        seen, runs = [Counter() for _ in range(FOLDS)], np.zeros((2, FOLDS, GRAMS))
        bad, n = [Counter() for _ in range(FOLDS)], np.zeros((2, FOLDS))
        for i, (words, is_bad) in enumerate(zip(documents, toxic)):
            f = i % FOLDS
            seen[f].update(words)
            if is_bad:
                bad[f].update(words)
            g = np.unique(grams_of(list(words))[0])
            runs[int(is_bad), f, g] += 1
            n[int(is_bad), f] += 1
        total = sum(seen, Counter())
        common = sorted(w for w, k in total.most_common(VOCABULARY) if k >= LEAST)
        self.index = {w: i + 1 for i, w in enumerate(common)}
        of = lambda c: np.array([0, *(c[w] for w in common)], float)
        w_seen, w_bad = np.stack([of(c) for c in seen]), np.stack([of(c) for c in bad])
        self.word_odds, self.gram_odds = [], []
        for f in [None, *range(FOLDS)]:
            use = [i for i in range(FOLDS) if i != f]
            share = (n[1, use].sum() + 1) / (n[:, use].sum() + 2)
            self.word_odds.append(self._odds(w_bad[use].sum(0), w_seen[use].sum(0), share))
            self.gram_odds.append(self._odds(runs[1, use].sum(0), runs[:, use].sum((0, 1)), share))

    @staticmethod
    def _odds(b, n, share):
        """How far the toxic share among n documents stands out, in standard deviations beyond 2.5."""
        z = (b - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
        return (np.sign(z) * np.clip(np.abs(z) - 2.5, 0, 12) / 4).astype(np.float32)

    def rows(self, words: list[str], fold: int | None = None):
        """Vocabulary indexes, flat character runs with their word's start and size, fixed inputs."""
        ids = np.array([self.index.get(w, 0) for w in words], np.int64)
        flat, starts, size = grams_of(words)
        return ids, flat, starts, size, self.fixed(ids, flat, starts, size, fold)

    def fixed(self, ids, flat, starts, size, fold: int | None):
        at = 0 if fold is None else fold + 1
        g = self.gram_odds[at][flat]
        return np.stack([self.word_odds[at][ids], np.add.reduceat(g, starts) / size, np.maximum.reduceat(g, starts)], 1).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(n_words: int, seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM + 3, HIDDEN
    p = {"Ew": r.normal(0, 0.02, (n_words, WORD_DIM)), "Ec": r.normal(0, 0.02, (GRAMS, CHAR_DIM)),
         "A": r.normal(0, 0.3, (2 * h, ATTEND)), "a": np.zeros(ATTEND), "v": r.normal(0, 0.3, ATTEND), "w": r.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
    for way in "fb":
        p |= {f"W{way}": r.normal(0, 0.3, (d, 3 * h)), f"U{way}": r.normal(0, 0.2, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def recur(gx: np.ndarray, U: np.ndarray, keep: bool = False):
    """States of a gated recurrent layer over projected inputs gx [L, B, 3H]; with ``keep`` also what backward() needs."""
    L, B, _ = gx.shape
    H = HIDDEN
    h, states, saved = np.zeros((B, H), np.float32), np.empty((L, B, H), np.float32), []
    for t in range(L):
        gh = h @ U
        zr = 1 / (1 + np.exp(-(gx[t, :, :2 * H] + gh[:, :2 * H])))
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(gx[t, :, 2 * H:] + r * gh[:, 2 * H:])
        if keep:
            saved.append((h, z, r, n, gh[:, 2 * H:]))
        h = n + z * (h - n)
        states[t] = h
    return states, saved


def backward(d_states: np.ndarray, saved, U: np.ndarray):
    """Gradients for gx and U."""
    L, B, H = d_states.shape
    d_gx, d_U, dh = np.empty((L, B, 3 * H), np.float32), np.zeros_like(U), np.zeros((B, H), np.float32)
    for t in range(L - 1, -1, -1):
        h, z, r, n, un = saved[t]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        d_gh = np.concatenate([dz, dr, dn * r], 1)
        d_gx[t] = np.concatenate([dz, dr, dn], 1)
        d_U += h.T @ d_gh
        dh = dh * z + d_gh @ U.T
    return d_gx, d_U


def pool(p, f, b):
    """Attention over states [L, B, H] of both ways: logits and what the gradient needs."""
    s = np.concatenate([f, b], 2)
    u = np.tanh(s @ p["A"] + p["a"])
    e = u @ p["v"]
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = (e[:, :, None] * s).sum(0)
    return pooled @ p["w"] + p["b"][0], (s, u, e, pooled)


def project(p, ids, flat, starts, size, fixed):
    x = np.concatenate([p["Ew"][ids], np.add.reduceat(p["Ec"][flat], starts, 0) / size[:, None].astype(np.float32), fixed], 1)
    return x, x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]


def picked(rows, used: np.ndarray):
    """Of (ids, flat runs, starts, sizes) of n words and the fixed inputs of a row per word and fold, the rows ``used``."""
    ids, flat, starts, size, fixed = rows
    word = used % len(ids)
    ids, starts, size = ids[word], starts[word], size[word]
    begin = np.cumsum(size) - size
    return ids, flat[np.repeat(starts - begin, size) + np.arange(size.sum())], begin, size, fixed[used]


def gradients(p, rows, grid: np.ndarray, y: np.ndarray):
    """Gradients of the log loss for windows ``grid`` [B, L] of word rows."""
    used, where = np.unique(grid, return_inverse=True)
    own = picked(rows, used)
    x, gf, gb = project(p, *own)
    where = where.reshape(grid.shape).T
    f, saved_f = recur(gf[where], p["Uf"], True)
    b, saved_b = recur(gb[where[::-1]], p["Ub"], True)
    logit, (s, u, e, pooled) = pool(p, f, b[::-1])
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"w": pooled.T @ d, "b": d.sum(keepdims=True)}
    d_pooled = d[:, None] * p["w"]
    d_e = (s * d_pooled).sum(2)
    d_e = e * (d_e - (e * d_e).sum(0))
    d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
    g["v"], g["a"] = np.einsum("lba,lb->a", u, d_e), d_u.sum((0, 1))
    g["A"] = np.einsum("lbh,lba->ha", s, d_u)
    d_s = e[:, :, None] * d_pooled + d_u @ p["A"].T
    H, d_x = HIDDEN, np.zeros_like(x)
    for way, part, saved, order in (("f", d_s[:, :, :H], saved_f, where), ("b", d_s[::-1, :, H:], saved_b, where[::-1])):
        d_gx, g[f"U{way}"] = backward(part, saved, p[f"U{way}"])
        total = np.zeros((len(used), 3 * H), np.float32)
        np.add.at(total, order.ravel(), d_gx.reshape(-1, 3 * H))
        g[f"W{way}"], g[f"c{way}"] = x.T @ total, total.sum(0)
        d_x += total @ p[f"W{way}"].T
    g["Ew"], g["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
    np.add.at(g["Ew"], own[0], d_x[:, :WORD_DIM])
    np.add.at(g["Ec"], own[1], np.repeat(d_x[:, WORD_DIM:WORD_DIM + CHAR_DIM] / own[3][:, None], own[3], 0))
    return g


def logits(p, tables: tuple[np.ndarray, np.ndarray], grid: np.ndarray, block: int = 2048) -> np.ndarray:
    """Logits of windows [B, L] of rows of the projected inputs."""
    out = np.empty(len(grid), np.float32)
    for i in range(0, len(grid), block):
        g = grid[i:i + block].T
        f, b = recur(tables[0][g], p["Uf"])[0], recur(tables[1][g[::-1]], p["Ub"])[0]
        out[i:i + block] = pool(p, f, b[::-1])[0]
    return out


def _by_length(grids: list[np.ndarray]):
    """Indexes of windows of equal length."""
    sizes = np.array([len(g) for g in grids])
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def fit(documents: list[str], toxic: list[bool], rounds: int = 3, epochs: int = 4, seed: int = SEED, odds: bool = True) -> dict:
    """The network from documents, each its words joined by blanks. Without ``odds`` the inputs of label counts are zero, to see what the network adds."""
    toxic = np.array(toxic, bool)
    if not toxic.any() or toxic.all():
        return {}
    number: dict[str, int] = {}
    grids, sizes = [], []
    for d in documents:
        ids = np.array([number.setdefault(w, len(number)) for w in d.split(" ")], np.int32)
        at = windows(len(ids))
        grids += [ids[s:s + LENGTH] for s in at]
        sizes.append(len(at))
    ends = np.cumsum(sizes)
    words = list(number)
    inputs = Inputs(({words[j] for j in np.unique(np.concatenate(grids[a:b]))} for a, b in zip([0, *ends[:-1]], ends)), toxic)
    if not odds:
        inputs.word_odds, inputs.gram_odds = ([np.zeros_like(x) for x in table] for table in (inputs.word_odds, inputs.gram_odds))
    one = inputs.rows(words)
    rows = (one[0], one[1].astype(np.int32), *one[2:4], np.concatenate([inputs.fixed(*one[:4], f) for f in range(FOLDS)]))
    del number, words, one
    doc = np.repeat(np.arange(len(documents)), sizes)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    grids = [g + i % FOLDS * len(rows[0]) for g, i in zip(grids, doc)]
    r, p = np.random.default_rng(seed), fresh(len(inputs.index) + 1, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    groups, step = _by_length(grids), 0
    score = np.array([rows[4][g, 0].max() for g in grids])

    def scored():
        gf, gb = (np.empty((len(rows[4]), 3 * HIDDEN), np.float32) for _ in "fb")
        for i in range(0, len(gf), 1 << 14):
            used = np.arange(i, min(i + (1 << 14), len(gf)))
            _, gf[used], gb[used] = project(p, *picked(rows, used))
        out = np.empty(len(grids), np.float32)
        for g in groups:
            out[g] = logits(p, (gf, gb), np.stack([grids[i] for i in g]))
        return out

    for _ in range(rounds):
        best = np.zeros(len(grids), bool)
        order = np.lexsort((-score, doc))
        best[order[starts]] = True
        chosen = np.where(toxic[doc], best, best | (r.random(len(grids)) < 0.15))
        y, weight = toxic[doc].astype(np.float32), max(1, round((chosen & ~toxic[doc]).sum() / max(1, (chosen & toxic[doc]).sum())))
        for _ in range(epochs):
            for g in groups:
                mine = g[chosen[g]]
                mine = r.permutation(np.repeat(mine, np.where(y[mine] > 0, min(weight, 8), 1)))
                for i in range(0, len(mine), 128):
                    at = mine[i:i + 128]
                    step += 1
                    for k, v in gradients(p, rows, np.stack([grids[j] for j in at]), y[at]).items():
                        m, s = moments[k]
                        v = np.clip(v, -1, 1)
                        m += 0.1 * (v - m)
                        s += 0.001 * (v * v - s)
                        if k in ("Ew", "Ec"):
                            p[k] *= 0.99
                        p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
        score = scored()
    # The bias that splits the training documents best, in the middle of the gap; losing clean ones counts CAUTION times.
    top = np.maximum.reduceat(score, starts)
    label = toxic[doc[starts]]
    order = np.argsort(top)
    right = CAUTION * np.cumsum(~label[order]) / (~label).sum() - np.cumsum(label[order]) / label.sum()
    k = int(np.argmax(right))
    shift = (top[order[k]] + top[order[min(k + 1, len(order) - 1)]]) / 2
    return {"inputs": inputs, "p": {k: v.astype(np.float32) for k, v in p.items()}, "shift": float(shift)}


def _worded(batches):
    for batch in batches:
        found = [(i, toxic, " ".join(w)) for i, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"]) if (w := WORD.findall((text or "").lower()))]
        yield pd.DataFrame(found, columns=["doc_id", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", odds: bool = True) -> dict:
    """A model from the labelled documents for which ``use`` holds."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(use) if use is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lowest = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(n)
    sample = lowest(1, MAX_TOXIC).unionByName(lowest(0, MAX_CLEAN))  # at most MAX_TOXIC + MAX_CLEAN ids
    found = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample.select(F.col("doc_id").cast("long"), "toxic")), "doc_id")
             .mapInPandas(_worded, "doc_id long, toxic int, words string").toPandas())
    if not len(found):
        return {}
    found = found.drop_duplicates().sort_values(["doc_id", "words"], kind="stable")
    return fit(found["words"].tolist(), (found["toxic"] == 1).tolist(), odds=odds)


class Scorer:
    """Scores texts; keeps the projected inputs of the words it has met."""

    def __init__(self, model: dict):
        self.p, self.inputs, self.shift = model["p"], model["inputs"], model["shift"]
        self.clear()

    def clear(self):
        self.ids: dict[str, int] = {}
        self.tables = tuple(np.empty((1024, 3 * HIDDEN), np.float32) for _ in range(2))

    def learn(self, words: list[str]):
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if not new:
            return
        at, n = len(self.ids), len(self.ids) + len(new)
        while n > len(self.tables[0]):
            self.tables = tuple(np.concatenate([t, np.empty_like(t)]) for t in self.tables)
        _, f, b = project(self.p, *self.inputs.rows(new))
        self.tables[0][at:n], self.tables[1][at:n] = f, b
        self.ids.update(zip(new, range(at, n)))

    def score(self, texts) -> np.ndarray:
        grids: dict[int, list] = {}
        owners: dict[int, list] = {}
        if len(self.ids) > CACHE:
            self.clear()
        for i, text in enumerate(texts):
            w = WORD.findall(text.lower()) if text else []
            if not w:
                continue
            try:
                row = np.array([self.ids[x] for x in w], np.int32)
            except KeyError:
                self.learn(w)
                row = np.array([self.ids[x] for x in w], np.int32)
            at = np.array(windows(len(w)))
            n = min(len(w), LENGTH)
            grids.setdefault(n, []).append(row[at[:, None] + np.arange(n)])
            owners.setdefault(n, []).append(np.full(len(at), i))
        top = np.full(len(texts), -np.inf, np.float32)
        for n, g in grids.items():
            np.maximum.at(top, np.concatenate(owners[n]), logits(self.p, self.tables, np.concatenate(g)))
        return np.where(np.isinf(top), 0.0, sigmoid(top.astype(np.float64) - self.shift))


def score_column(docs: DataFrame, model: dict, text: str = "text") -> Column:
    if not model:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(np.concatenate([scorer.score(texts.iloc[i:i + STEP].tolist()) for i in range(0, len(texts), STEP)]) if len(texts) else np.empty(0))
            release()
        scorer.clear()
        release()

    return scores(F.col(text))


def with_scores(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    return docs.withColumn(out, score_column(docs, model, text))


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5."""
    model = train(docs, labels, remainder(5) != 0)
    return docs.where(score_column(docs, model) < 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(5) != 0)
    return with_scores(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
