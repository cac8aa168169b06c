"""Quality rules: base counts, and divergence from language references.

Each text gives a histogram over character classes and one over frequent function words (and the rest).
The reference of a language is the mean of the proportions of its documents that pass the base
rules, drawn towards the mean of all languages as if ``PRIOR`` documents of that mean were added: a language with few documents
has nearly the pooled reference, one with many nearly its own, without a step between. A text fails if the Jensen-Shannon
distance (the square root of the divergence, base 2) of either
histogram from its language's reference exceeds the limit. Guards: the character histogram counts from
``MIN_CHARS`` characters on, the word histogram from ``MIN_WORDS`` words on. Rows without a language are compared with the pooled reference.

Texts are read once: counts and histograms go to the shared checkpoint folder, references and verdicts come from there.

Rows: a null or empty text has no words, fails the base rules and is not kept; a null doc_id stays null, and ids of any size are kept exactly; texts of any length are counted whole; repeated
rows and equal texts are judged alike, each counting in the reference; a distance equal to its limit passes; extra columns
are left out; an empty table gives an empty result.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_CHARS, MIN_WORDS, PRIOR = 200, 50, 20
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.13, 0.36
CLASSES = ("lower", "upper", "space", "newline", "period_comma", "symbol", "mark", "other_letter")
#: Frequent function words of four languages.
COMMON = tuple(sorted(set("the of and to in is that for it was on with as be by are this from de la le et les des en un une du que qui pour dans par sur est au "
                          "der die und das ist von mit den für auf ein eine zu nicht als el y los las con se del al lo es su".split())))
_other = len(CLASSES) - 1
_class = np.full(256, _other)
for _name, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("period_comma", b".,")):
    _class[list(_bytes)] = CLASSES.index(_name)
_class[list(b"#*$%&|<>")] = CLASSES.index("symbol")
_class[[b for b in range(33, 127) if _class[b] == _other]] = CLASSES.index("mark")
_class[48:58] = len(CLASSES)  # digits count in no class: clean texts may hold a long number
_first = np.ones(256, bool)
_first[128:192] = False
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_symbol = list(b"#*$%&|<>")
_common = {w.encode(): i for i, w in enumerate(COMMON)}
_letters = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WIDTH = len(CLASSES) + len(COMMON) + 1
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, histogram binary"


def repeated_words(tokens: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more, the first occurrence included."""
    if len(tokens) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
    two = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        two = np.unique(two, return_inverse=True)[1]
    three = two[:-1] * len(number) + ids[2:]
    order = np.argsort(three, kind="stable")
    s = three[order]
    same = s[1:] == s[:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]]
    covered = np.zeros(len(tokens), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def counted(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    c = np.bincount(data, minlength=256)
    tokens = raw.split()
    chars = int(c[_first].sum())
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    h = np.zeros(WIDTH, np.int64)
    h[:len(CLASSES)] = np.bincount(_class, np.where(_first, c, 0), len(CLASSES) + 1)[:-1].astype(np.int64)
    words = _letters.findall(raw.lower())
    get, at, rest = _common.get, len(CLASSES), len(COMMON)
    h[at:] = np.bincount([get(w, rest) for w in words], minlength=rest + 1)
    return len(tokens), chars - int(c[_space].sum()), int(c[_symbol].sum()), dup, repeated_words(tokens), h.astype("<i4").tobytes()


def _proportions(h: np.ndarray) -> np.ndarray:
    """Both histograms of rows [n, WIDTH], each scaled to sum 1 (0 if empty)."""
    h, k = h.astype(float), len(CLASSES)
    return np.concatenate([x / np.maximum(x.sum(1, keepdims=True), 1) for x in (h[:, :k], h[:, k:])], 1)


def _histograms(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(-1, WIDTH)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows, between 0 and 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(1) for x in (p, q)) / 2
    return np.sqrt(np.clip(kl, 0, 1))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per language of a task: documents and summed proportions."""
    total: dict = {}
    for b in batches:
        p = np.c_[np.ones(len(b)), _proportions(_histograms(b["histogram"]))] if len(b) else np.zeros((0, WIDTH + 1))
        langs = b["lang"].fillna("").to_numpy()
        for lang in np.unique(langs.astype(str)):
            total[lang] = total.get(lang, 0) + p[langs == lang].sum(0)
    yield pd.DataFrame({"lang": pd.Series(list(total), dtype=object), "sums": pd.Series([v.tolist() for v in total.values()], dtype=object)})


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance and kept of every row."""
    count = F.pandas_udf(_counted_all, COUNTS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), count(text).alias("c"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(rows.select("doc_id", "lang", "c.*").withColumn("base_failed", failed))
    part = rows.where(~F.col("base_failed")).select("lang", "histogram").mapInPandas(_sums, "lang string, sums array<double>")
    spread = part.select("lang", F.posexplode("sums").alias("k", "v"))
    of_all = {r["k"]: r["v"] for r in spread.groupBy("k").agg(F.sum("v").alias("v")).collect()}  # WIDTH + 1 rows
    pooled = np.array([of_all.get(k, 0.0) for k in range(WIDTH + 1)])
    pooled = (pooled[1:] / max(1.0, pooled[0])).tolist()
    packed = F.map_from_entries(F.collect_list(F.struct("k", "v")))
    prior = F.lit(pooled)
    refs = (spread.where("lang <> ''").groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(packed.alias("m"))
            .select("lang", F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda k: (F.col("m")[k] + PRIOR * prior[k - 1]) / (F.col("m")[0] + PRIOR)).alias("reference")))

    @F.pandas_udf("char_distance double, word_distance double")
    def measure(histograms: pd.Series, references: pd.Series) -> pd.DataFrame:
        k = len(CLASSES)
        h = _histograms(histograms)
        p = _proportions(h)
        q = np.array([pooled if r is None else r for r in references], float).reshape(-1, WIDTH)
        return pd.DataFrame({"char_distance": np.where(h[:, :k].sum(1) >= MIN_CHARS, distances(p[:, :k], q[:, :k]), 0.0),
                             "word_distance": np.where(h[:, k:].sum(1) >= MIN_WORDS, distances(p[:, k:], q[:, k:]), 0.0)})

    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = rows.join(refs, "lang", "left").select(F.col("doc_id").cast("long").alias("doc_id"), *counts, measure("histogram", "reference").alias("d")).select("doc_id", *counts, "d.*")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("char_distance") <= MAX_CHAR_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE))


def _counted_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counted(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")])


def query(spark, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _sql() -> str:
    """The same in SQL, with a row for each text and histogram bin."""
    classes = ("[a-z]", "[A-Z]", r"[\x20\x09\x0B-\x0D]", r"\x0A", "[.,]", "[#*$%&|<>]", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", r"[^\x09-\x0D\x20-\x7E]")
    counts = [f"len(regexp_extract_all(text, '{c}'))" for c in classes]
    at = {n: i for i, n in enumerate(CLASSES)}
    counts[at["mark"]] += f" - {counts[at['period_comma']]} - {counts[at['symbol']]}"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    common = "[" + ", ".join(f"'{w}'" for w in COMMON) + "]"
    n, m = len(CLASSES), len(COMMON)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY doc_id),
base AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT w.doc_id, lang, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN again USING (doc_id))),
chars AS (SELECT doc_id, 0 AS h, unnest(range(0, {n})) AS k, unnest([{", ".join(counts)}]) AS c FROM base),
tokens AS (SELECT doc_id, coalesce(list_position({common}, t), {m + 1}) - 1 AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM base)),
bins AS (SELECT doc_id, h, k, c FROM chars UNION ALL SELECT doc_id, 1, k, count(*) FROM tokens GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, h, k, c / nullif(sum(c) OVER (PARTITION BY doc_id, h), 0) AS p, sum(c) OVER (PARTITION BY doc_id, h) AS n FROM bins),
good AS (SELECT doc_id, lang FROM base WHERE NOT base_failed),
sizes AS (SELECT lang, count(*) AS n FROM good WHERE lang <> '' GROUP BY lang),
pooled AS (SELECT h, k, coalesce(sum(p), 0) / (SELECT count(*) FROM good) AS q FROM good JOIN p USING (doc_id) GROUP BY h, k),
summed AS (SELECT lang, h, k, sum(p) AS s FROM good JOIN p USING (doc_id) GROUP BY lang, h, k),
own AS (SELECT sizes.lang, h, k, (coalesce(s, 0) + {PRIOR} * q) / (n + {PRIOR}) AS q FROM sizes CROSS JOIN pooled LEFT JOIN summed USING (lang, h, k)),
q AS (SELECT doc_id, h, k, q FROM base JOIN own USING (lang) UNION ALL SELECT doc_id, h, k, q FROM base, pooled WHERE lang NOT IN (SELECT lang FROM own)),
both_sides AS (SELECT doc_id, h, k, coalesce(p.p, 0) AS p, coalesce(q.q, 0) AS q FROM q FULL JOIN p USING (doc_id, h, k)),
parts AS (SELECT doc_id, h, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM both_sides GROUP BY ALL),
sums AS (SELECT doc_id, max(n) FILTER (h = 0) AS chars, max(n) FILTER (h = 1) AS words FROM p GROUP BY doc_id),
found AS (SELECT base.*, CASE WHEN chars >= {MIN_CHARS} THEN a.x ELSE 0 END AS cd, CASE WHEN words >= {MIN_WORDS} THEN b.x ELSE 0 END AS wd
  FROM base LEFT JOIN sums USING (doc_id) LEFT JOIN parts a ON a.doc_id = base.doc_id AND a.h = 0 LEFT JOIN parts b ON b.doc_id = base.doc_id AND b.h = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
  NOT base_failed AND cd <= {MAX_CHAR_DISTANCE} AND wd <= {MAX_WORD_DISTANCE} AS kept FROM found"""


SQL = _sql()
