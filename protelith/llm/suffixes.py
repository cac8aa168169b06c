"""Removal of repeated byte strings across documents, by a content-defined sample of strings.

This stands in for difference-cover suffix sorting: no triples are sorted, no names recursed on, and no order of suffixes is built; what it keeps
of it is the cover. A difference cover is a sample of positions such that any two equal strings hold a sampled position at
the same distance from their start. Here the cover is content-defined: of the 31 grams of 20 bytes in a
50-byte string, the one with the least hash is sampled. That depends on the string alone, so it has the
cover's property, and it samples 6 % of the positions where the smallest arithmetic cover for this
length (6 of 31 residues) takes 19 %. The steps:

0. of equal texts only the one with the smallest doc_id takes part: the others are removed whole;
1. name the sampled grams and find the names held by more than one text (other names can't match);
2. for those, take the text around each sample, which holds all strings whose sample it is;
3. in each range of names sort the strings' hashes and compare neighbours: of equal strings the smallest
   doc_id stays, all others are removed.

Samples and strings travel as packed arrays, one row for each task's flush and range of names (answers: for
each range and home of the texts they go back to), and each
flush keeps one entry for equal samples, so a passage shared by very many documents arrives once a
flush. Names travel as their upper five bytes: names that agree by chance only bring strings to step 3 that find no equal there.
Texts are dealt once by doc_id and version, compressed; the same shuffle files serve the strings around samples and the cut at the end.
Strings are compared by two 64-bit hashes (over 100 effective bits).

Rows: null texts count as empty; a null doc_id is neither smaller nor larger than another, so such rows
neither lose nor cause removals; rows with equal doc_id never remove from each other, so ties stay; repeated rows are
treated alike; an empty table gives an empty result. Texts of any length are cut into overlapping segments. Extra columns stay.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_batches

MATCH, GRAM = 50, 20
CHUNK = 1 << 19  # bytes hashed at a time
FLUSH = 8 << 20  # bytes of text for each packed flush of names
STRING_FLUSH = 3 << 20  # and of strings
BLOCK = 4096  # stretches of text hashed at a time
NAMES_PER_RANGE, STRINGS_PER_RANGE = 1 << 20, 1 << 15
U64 = np.uint64
K1, K2, K3 = (U64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
ONE, HIGH, LOW = U64(1), U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)
NAME_BYTES = 5  # of a name's eight that are sent, the upper ones
SENT = ~((ONE << U64(64 - 8 * NAME_BYTES)) - ONE)
SEVERAL = ONE << U64(64 - 8 * NAME_BYTES)  # the lowest bit sent says: found in several documents


def _loads(data: np.ndarray, kind: str, n: int, at: int) -> np.ndarray:
    """The unaligned integer that starts at each of ``n`` bytes from ``at``."""
    return np.ndarray((n,), kind, data, at, (1,)).astype(U64)


def cover(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, match: int = MATCH):
    """The sample of ``data``, whose texts are [starts, ends): name, text index, first and last string start with that sample."""
    n = len(data) - GRAM + 1
    none = np.empty(0, np.int64)
    if n < match - GRAM + 1:
        return none.astype(U64), none, none, none
    with np.errstate(over="ignore"):
        h = _loads(data, "<u8", n, 0) * K1
        h ^= h >> U64(29)
        h += _loads(data, "<u8", n, 8)
        h *= K2
        h ^= h >> U64(32)
        h += _loads(data, "<u4", n, 16)
        h *= K3
        h ^= h >> U64(29)
    low = (h & HIGH) | np.arange(n, dtype=U64)
    span, width = match - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, np.maximum(starts, ends - match + 1), 1)
    np.add.at(edge, ends, -1)
    at = np.flatnonzero(np.cumsum(edge)[:len(low)] == 0)  # where a whole string of one text starts
    if not len(at):
        return none.astype(U64), none, none, none
    sample = (low[at] & LOW).astype(np.int64)
    turn = np.flatnonzero(sample[1:] != sample[:-1]) + 1
    first, last = at[np.r_[0, turn]], at[np.r_[turn - 1, len(at) - 1]]
    return h[sample[np.r_[0, turn]]] | ONE, np.searchsorted(starts, first, "right") - 1, first, last


def chunks(texts: pa.Array, match: int = MATCH):
    """(bytes, starts, ends, row numbers, base offsets) of about CHUNK bytes each; longer texts come in overlapping segments."""
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offs, body = texts.buffers()
    offs = np.frombuffer(offs, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    i, rows = 0, len(texts)
    while i < rows:
        if offs[i + 1] - offs[i] > CHUNK:
            text = body[offs[i]:offs[i + 1]]
            for s in range(0, len(text) - match + 1, CHUNK):
                part = text[s:s + CHUNK + match - 1]
                yield part, np.array([0]), np.array([len(part)]), np.array([i]), np.array([s])
            i += 1
            continue
        j = i + max(1, int(np.searchsorted(offs[i + 1:], offs[i] + CHUNK, "right")))
        while j > i + 1 and offs[j] - offs[j - 1] > CHUNK:
            j -= 1
        o = offs[i:j + 1] - offs[i]
        long_enough = np.diff(o) >= 0
        yield body[offs[i]:offs[j]], o[:-1][long_enough], o[1:], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def _sent(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - NAME_BYTES:]).tobytes()


def _received(parts) -> np.ndarray:
    """The names of several _sent() in turn; what was not sent is zero."""
    sent = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, NAME_BYTES)
    names = np.zeros((len(sent), 8), np.uint8)
    names[:, 8 - NAME_BYTES:] = sent
    return names.view("<u8").ravel()


def _by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts ``keys``, and where each new key starts in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)


def _by_home(version: np.ndarray, name: np.ndarray, homes: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Each text's distinct names, packed with those of all texts that share its home."""
    out = []
    if not len(version):
        return out
    order = np.lexsort((name, version))
    version, name = version[order], name[order]
    once = np.r_[True, (version[1:] != version[:-1]) | (name[1:] != name[:-1])]
    version, name = version[once], name[once]
    home = (version.view(U64) % U64(homes)).astype(np.int64)
    order, at = _by(home)
    for rows in np.split(order, at[1:]):
        v = version[rows]
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        out.append((int(home[rows[0]]), _sent(name[rows]), v[cuts].tobytes(), np.diff(np.r_[cuts, len(v)]).astype(np.int32).tobytes()))
    return out


SAMPLES = "bucket long, home long, names binary, versions binary, counts binary"
FOUND = "home long, names binary, versions binary, counts binary"


def _sampler(ranges: int):
    def flush(held):
        name, doc = (np.concatenate(x) for x in zip(*held))
        order, at = _by(name)
        size = np.diff(np.r_[at, len(name)])
        doc_sorted = doc[order]
        many = np.minimum.reduceat(doc_sorted, at) != np.maximum.reduceat(doc_sorted, at)
        known = order[np.repeat(many, size)]
        out = [(home, *packed) for home, *packed in ((h, h, *rest) for h, *rest in _by_home(doc[known], name[known] | SEVERAL, ranges))]
        first = order[at]
        sent = np.where(many, name[first] | SEVERAL, name[first] & ~SEVERAL)
        back = np.argsort(first, kind="stable")
        first, sent = first[back], sent[back]
        bucket = ((name[first] >> ONE) % U64(ranges)).astype(np.int64)
        order, at = _by(bucket)
        for rows in np.split(order, at[1:]):
            d = doc[first[rows]]
            cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            out.append((int(bucket[rows[0]]), None, _sent(sent[rows]), d[cuts].tobytes(), np.diff(np.r_[cuts, len(d)]).astype(np.int32).tobytes()))
        return _table(out, SAMPLES)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for data, starts, ends, rows, _ in chunks(batch.column(1)):
                name, i, _, _ = cover(data, starts, ends)
                if len(name):
                    held.append((name, ids[rows[i]]))
                size += len(data)
                if size >= FLUSH and held:
                    yield flush(held)
                    held, size = [], 0
                    release()
        if held:
            yield flush(held)
        del held
        release()

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _unpacked(versions, counts) -> np.ndarray:
    return np.concatenate([np.repeat(np.frombuffer(v, np.int64), np.frombuffer(c, np.int32)) for v, c in zip(versions, counts)])


def _shared(ranges: int):
    """Names of one range that several texts hold, packed by the texts' homes; there are as many homes as ranges."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ready = group["home"].notna()
        out = [(int(h), *packed) for h, *packed in group.loc[ready, ["home", "names", "versions", "counts"]].itertuples(index=False)]
        rest = group[~ready]
        if len(rest):
            name = _received(rest["names"])
            doc = _unpacked(rest["versions"], rest["counts"])
            order, at = _by(name | SEVERAL)
            doc_sorted = doc[order]
            many = (np.minimum.reduceat(doc_sorted, at) != np.maximum.reduceat(doc_sorted, at)) | np.logical_or.reduceat((name[order] & SEVERAL) == SEVERAL, at)
            found = order[np.repeat(many, np.diff(np.r_[at, len(name)]))]
            out += _by_home(doc[found], name[found] | SEVERAL, ranges)
            del name, doc, doc_sorted, order, at, found
        release()
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _gathered(group: pd.DataFrame) -> pd.DataFrame:
    """The shared names of each text of a home."""
    version, name = _unpacked(group["versions"], group["counts"]), _received(group["names"])
    order, at = _by(version)
    return pd.DataFrame([(int(version[rows[0]]), _sent(np.unique(name[rows]))) for rows in np.split(order, at[1:])], columns=["version", "names"])


_powers: dict = {}


def _substrings(data: np.ndarray, s: np.ndarray, e: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each data[s:e]."""
    n = len(data) + 1
    with np.errstate(over="ignore"):
        if which not in _powers or len(_powers[which][1]) < n:
            r = np.random.default_rng(7 + which)
            base = int(r.integers(1 << 62)) * 2 + 1
            grow = max(n, 1 << 18)
            up, down = np.full(grow, U64(base % (1 << 64))), np.full(grow, U64(pow(base, -1, 1 << 64)))
            up[0] = down[0] = ONE
            _powers[which] = r.integers(1 << 63, size=256, dtype=U64), np.multiply.accumulate(up), np.multiply.accumulate(down)
        letter, up, down = _powers[which]
        total = np.r_[U64(0), np.cumsum(letter[data] * up[:len(data)], dtype=U64)]
        h = (total[e] - total[s]) * down[s]
        h = (h ^ (h >> U64(32))) * K2 + (e - s).astype(U64)
    return h ^ (h >> U64(29))


PAIRS = "home long, docs binary, versions binary, starts binary, ends binary"
STRINGS = "bucket long, home long, docs binary, versions binary, firsts binary, sizes binary, body binary, ends binary"


def _pack(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pd.Series([pack(t) for t in texts], dtype=object)


def _stringer(ranges: int):
    """Around each shared sample, the text that holds its strings; what an equal text in the same flush already decides goes out as spans."""
    def flush(held):
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = list(zip(*held))
        name, doc, version, first, size, c1, c2 = (np.concatenate(x) for x in parts[:7])
        body = np.concatenate(parts[7])
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, c2, c1))
        a, b = c1[order], c2[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = np.repeat(doc[order][at], np.diff(np.r_[at, len(a)]))
        lost = order[doc[order] > least]
        kept = np.sort(order[doc[order] == least])
        out = []
        for home, *packed in _spans_by_home(doc[lost], version[lost], first[lost], first[lost] + size[lost], ranges):
            out.append((home, home, *packed[:3], None, None, packed[3]))
        bucket = ((name[kept] >> ONE) % U64(ranges)).astype(np.int64)
        by, at = _by(bucket)
        for rows in np.split(by, at[1:]):
            r = kept[rows]
            take = np.repeat(begin[r] - (np.cumsum(size[r]) - size[r]), size[r]) + np.arange(size[r].sum())
            out.append((int(bucket[rows[0]]), None, doc[r].tobytes(), version[r].tobytes(), first[r].tobytes(), size[r].astype(np.uint8).tobytes(), pack(body[take].tobytes()), None))
        return _table(out, STRINGS)

    def run(batches):
        held, size = [], 0
        unpack = zstandard.ZstdDecompressor().decompress
        for whole, at in ((b, i) for b in batches for i in range(0, b.num_rows, 1000)):
            batch = whole.slice(at, 1000)
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = pa.array([unpack(t) for t in batch.column(2).to_pylist()], pa.large_binary())
            wanted = np.unique(_received(batch.column(3).to_pylist()))
            for data, starts, ends, rows, base in chunks(texts):
                name, i, first, last = cover(data, starts, ends)
                if not len(name):
                    continue
                known = name & SENT | SEVERAL
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, known), len(wanted) - 1)] == known)
                if len(hit):
                    name, i, first, end = name[hit], i[hit], first[hit], last[hit] + MATCH
                    length = end - first
                    take = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    held.append((name, ids[rows[i]], versions[rows[i]], first - starts[i] + base[i], length,
                                 _substrings(data, first, end, 0), _substrings(data, first, end, 1), data[take]))
                size += len(data)
                if size >= STRING_FLUSH and held:
                    yield flush(held)
                    held, size = [], 0
                    release()
        if held:
            yield flush(held)
        del held
        release()

    return run


SPANS = "doc_id long, version long, spans binary"


def _spans(doc, version, start, end) -> list[tuple[int, int, bytes]]:
    """Merged [start, end) of each text, packed."""
    order = np.lexsort((start, version, doc))
    doc, version, start, end = doc[order], version[order], start[order], end[order]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
    return [(int(doc[i]), int(version[i]), merged(start[i:j], end[i:j]).tobytes()) for i, j in zip(cuts, np.r_[cuts[1:], len(doc)])]


def _spans_by_home(doc, version, start, end, homes: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """[start, end) of texts, packed by the texts' homes."""
    home = (version.view(U64) % U64(homes)).astype(np.int64)
    order, at = _by(home)
    return [(int(home[rows[0]]), *(x[rows].tobytes() for x in (doc, version, start, end))) for rows in np.split(order, at[1:])] if len(home) else []


def _merged_spans(group: pd.DataFrame) -> pd.DataFrame:
    """The spans of each text of a home."""
    columns = (np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("docs", "versions", "starts", "ends"))
    return pd.DataFrame(_spans(*columns), columns=["doc_id", "version", "spans"])


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs, as rows (start, end), of intervals sorted by start."""
    top = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > top[:-1]])
    return np.stack([start[new], top[np.r_[new[1:] - 1, len(top) - 1]]], 1).astype(np.int64)


def _compare(homes: int):
    """Sorts all strings of a range of names and compares neighbours."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ready = group["home"].notna()
        out = [(int(h), *packed) for h, *packed in group.loc[ready, ["home", "docs", "versions", "firsts", "ends"]].itertuples(index=False)]
        g = group[~ready]
        if len(g):
            out += _spans_by_home(*_lost(g), homes)
        release()
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return run


def _lost(g: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """doc_id, version, start, end of the runs that an earlier document holds."""
    doc, version, first = (np.concatenate([np.frombuffer(x, np.int64) for x in g[c]]) for c in ("docs", "versions", "firsts"))
    size = np.concatenate([np.frombuffer(x, np.uint8) for x in g["sizes"]]).astype(np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    body = np.frombuffer(b"".join(unpack(x) for x in g["body"]), np.uint8)
    strings, begin = size - MATCH + 1, np.cumsum(size) - size
    entry = np.repeat(np.arange(len(size)), strings)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = begin[entry] + step
    h1, h2 = np.empty(len(at), U64), np.empty(len(at), U64)
    last = np.cumsum(strings)
    for i in range(0, len(size), BLOCK):
        j = min(i + BLOCK, len(size))
        part = slice(last[i] - strings[i], last[j - 1])
        some, here = body[begin[i]:begin[j - 1] + size[j - 1]], at[part] - begin[i]
        h1[part], h2[part] = (_substrings(some, here, here + MATCH, k) for k in (0, 1))
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    d = doc[entry[order]]
    lost = np.zeros(len(entry), bool)
    lost[order] = d > np.repeat(np.minimum.reduceat(d, new), np.diff(np.r_[new, len(d)]))
    hit = np.flatnonzero(lost)
    if len(hit):
        e, s = entry[hit], step[hit]
        run = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (s[1:] != s[:-1] + 1)])
        stop = np.r_[run[1:] - 1, len(hit) - 1]
        return doc[e[run]], version[e[run]], first[e[run]] + s[run], first[e[run]] + s[stop] + MATCH
    none = np.empty(0, np.int64)
    return none, none, none, none


def repeated_spans(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, version, spans (packed pairs of 64-bit offsets) and whole (true: the text has an earlier copy): the bytes to
    remove.

    ``rows`` has doc_id long, version and check long (hashes of the text) and text binary, none null and no text shorter than a string;
    ``texts`` has doc_id, version and packed binary (the text compressed) of each of them, dealt by doc_id and version.
    """
    firsts = cut(rows.groupBy("version", "check").agg(F.min("doc_id").alias("first")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, round(size / 16 / NAMES_PER_RANGE))
    samples = rows.select("version", "text").mapInArrow(_sampler(ranges), SAMPLES)
    found = samples.groupBy("bucket").applyInPandas(_shared(ranges), FOUND)
    names = cut(found.groupBy("home").applyInPandas(_gathered, "version long, names binary"))
    ranges = max(1, round((names.agg(F.sum(F.octet_length("names"))).first()[0] or 0) / NAME_BYTES / STRINGS_PER_RANGE))
    wanted = names.join(firsts, "version").select(F.col("first").alias("doc_id"), "version", "names")
    strings = texts.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "packed", "names")
    pairs = strings.mapInArrow(_stringer(ranges), STRINGS).groupBy("bucket").applyInPandas(_compare(ranges), PAIRS)
    spans = pairs.groupBy("home").applyInPandas(_merged_spans, SPANS)  # not cut: the files of ``texts`` serve again only within one plan
    copies = rows.select("doc_id", "version", "check").join(firsts, ["version", "check"]).where("doc_id > first")
    return spans.withColumn("whole", F.lit(False)).unionByName(
        copies.select("doc_id", "version", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole")))


def _kept(packed: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What is left of each text; None where there is none."""
    unpack = zstandard.ZstdDecompressor().decompress
    removed, runs, kept = [], [], []
    for body, lost in zip(packed, spans):
        text = None if body is None else unpack(body)
        if text is None or lost is None or not len(lost):
            removed.append(0), runs.append(0), kept.append(text)
            continue
        s = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in lost])
        s = s[np.argsort(s[:, 0], kind="stable")]
        s = merged(s[:, 0], s[:, 1])
        removed.append(int((s[:, 1] - s[:, 0]).sum())), runs.append(len(s))
        ends = [0, *s[:, 1].tolist()]
        kept.append(b"".join(text[a:b] for a, b in zip(ends, [*s[:, 0].tolist(), len(text)])))
    return pd.DataFrame({"n_removed": removed, "n_spans": runs, "kept": pd.Series(kept, dtype=object)})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with _n_bytes, _n_removed, _n_spans and _kept (binary: what is left of the text).

    Columns of ``docs`` with these four names are replaced.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    key, version, check = F.col(doc_id).cast("long"), F.xxhash64(body), F.xxhash64(F.lit(MATCH), body)
    taken = key.isNotNull() & (F.octet_length(body) >= MATCH)
    rows = docs.where(taken)
    texts = rows.select(key.alias("doc_id"), version.alias("version"), F.pandas_udf(_pack, "binary")(body).alias("packed")).repartition("doc_id", "version")
    spans = repeated_spans(rows.select(key.alias("doc_id"), version.alias("version"), check.alias("check"), body.alias("text")), texts)
    spans = spans.groupBy(F.col("doc_id").alias("_d"), F.col("version").alias("_v")).agg(
        F.collect_list("spans").alias("_spans"), F.max("whole").alias("_whole"))
    once = texts.dropDuplicates(["doc_id", "version"]).toDF("_td", "_tv", "_packed")
    digest = ("_n_bytes", "_n_removed", "_n_spans", "_kept")
    others = [c for c in docs.columns if c not in (text, *digest)]
    keyed = docs.select(F.struct(*others).alias("row"), key.alias("key"), version.alias("version"),
                        F.when(~taken, body).alias("body"), F.octet_length(body).cast("long").alias("size"))
    keep = F.pandas_udf(_kept, "n_removed long, n_spans long, kept binary")
    whole = F.coalesce("_whole", F.lit(False))
    return (keyed.join(spans, (keyed["key"] == spans["_d"]) & (keyed["version"] == spans["_v"]), "left")
            .join(once, (keyed["key"] == once["_td"]) & (keyed["version"] == once["_tv"]), "left")
            .withColumn("cut", keep(F.when(~whole, F.col("_packed")), F.when(~whole, F.col("_spans"))))
            .select(*[F.col(f"row.`{c}`") for c in others], F.col("size").alias("_n_bytes"),
                    F.when(whole, F.col("size")).otherwise(F.col("cut.n_removed")).alias("_n_removed"),
                    F.when(whole, F.lit(1).cast("long")).otherwise(F.col("cut.n_spans")).alias("_n_spans"),
                    F.when(whole, F.lit(b"")).otherwise(F.coalesce("cut.kept", "body")).alias("_kept")))


def query(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"))
