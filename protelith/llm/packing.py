"""Hierarchical multi-length packing of token sequences.

Each document's ids (plus an end id) give as many full windows as they fill; the rest, shorter than a
window, is routed to the smallest context tier that holds it. Each tier has windows of its own size. From the longest
tier down, a tier's pieces open its windows, and the gap that a piece leaves is filled from the same and shorter
tiers: by one or two pieces that fill it exactly, else by the longest that fits. Windows of a shorter tier are sequences of
that size, without padding, if they come out full; the pieces of all others are packed into windows of the longest
tier, which alone are padded. Only the counts by length decide that plan, so it
is made from a histogram of at most ``window`` rows, whatever the size of the corpus; every piece then
finds its place from its length and its rank among pieces of that length.

Sequences are dealt to step groups in snake order of cost (a linear part and attention over each piece), which balances the groups.

Ranks come from counts by (task, length), so no length, however frequent, meets in one task.

Rows: a null or empty text is the end id alone; repeated rows, equal and null ids are packed each for itself, ids of any size exactly; which of several
pieces of one length takes which place follows from their order in the input;
texts of any length are cut into windows; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

TIERS = (256, 512, 1024, 2048)
LINEAR = 4096  # a token's cost beside attention, in tokens attended to
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, k long"
_encoders: dict = {}


def encoder(vocabulary: str = "byte_bpe_50k"):
    """text -> uint32 ids of the public byte-level vocabulary, as its tokenizers file gives them.

    tiktoken reads the same vocabulary and gives the same ids several times faster; a text that it refuses, or that
    holds an added token of the file, goes through tokenizers.
    """
    if vocabulary not in _encoders:
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        with open(P.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(P.path(f"{vocabulary}.json"))
        added = [t.content for t in slow.get_added_tokens_decoder().values()]

        def encode(text: str) -> np.ndarray:
            if not any(t in text for t in added):
                try:
                    return np.array(fast.encode_ordinary(text), np.uint32)
                except BaseException as refused:  # its Rust part panics on some very long runs
                    if isinstance(refused, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def pieces(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """A row for each piece: full windows, then the rest; k numbers a task's pieces of equal length."""
    def cut_up(batches):
        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                n = len(ids)
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append(i)
                    out.append((start, length, zlib.crc32(ids[start:start + length].tobytes()), n, part, seen[length]))
                    seen[length] += 1
            made = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(made, kinds)]], [c.split()[0] for c in PIECES.split(", ")])
            release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES)


def cost(lengths: list[int]) -> int:
    """What a sequence of such pieces costs in training."""
    return sum(x * (x + LINEAR) for x in lengths)


def _filled(left: np.ndarray, first: int, size: int) -> tuple[list[int], int]:
    """A window of ``size`` opened by a piece of length ``first``, its lengths, and how often ``left`` gives such a window; taken from ``left``."""
    made, gap = [first], size - first
    left[first] -= 1
    while gap:
        if left[gap]:
            take = [gap]
        else:
            pair = np.flatnonzero((left[1:gap] > 0) & (left[gap - 1:0:-1] > 0)) + 1
            pair = pair[(pair * 2 != gap) | (left[pair] > 1)]
            fits = np.flatnonzero(left[1:gap + 1]) + 1
            take = [int(pair[-1]), gap - int(pair[-1])] if len(pair) else [int(fits[-1])] if len(fits) else []
        if not take:
            break
        for x in take:
            left[x] -= 1
        made += take
        gap -= sum(take)
    used = Counter(made)
    more = min(int(left[x]) // n for x, n in used.items())
    for x, n in used.items():
        left[x] -= more * n
    return made, 1 + more


def plan(counts: dict[int, int], window: int = 2048) -> list[tuple[list[int], int, int]]:
    """(lengths of a sequence, number of such sequences, size of their tier), the costliest first."""
    left, again = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = [t for t in TIERS if t < window] + [window]
    patterns = []
    for size, below in sorted(zip(sizes, [0, *sizes]), reverse=True):
        for length in range(size, below, -1):
            while left[length]:
                made, repeat = _filled(left, length, size)
                if size == window or sum(made) == size:
                    patterns.append((made, repeat, size))
                else:
                    np.add.at(again, made, repeat)
    for length in range(window, 0, -1):
        while again[length]:
            patterns.append((*_filled(again, length, window), window))
    return sorted(patterns, key=lambda p: -cost(p[0]))


def layout(patterns: list[tuple[list[int], int, int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset, tier): where the pieces of each rank go."""
    taken, table, sequence = defaultdict(int), defaultdict(list), 0
    for lengths, repeat, tier in patterns:
        for x, offset, k in _slots(lengths):
            table[x].append((taken[x] + k * repeat, sequence, offset, tier))
        for x, n in Counter(lengths).items():
            taken[x] += n * repeat
        sequence += repeat
    return {x: np.array(rows, np.int64) for x, rows in table.items()}


def _slots(lengths: list[int]):
    """Each piece of a sequence: its length, its offset, and how many pieces of that length stand before it."""
    offset, seen = 0, Counter()
    for x in lengths:
        yield x, offset, seen[x]
        seen[x] += 1
        offset += x


def pack(docs: DataFrame, window: int = 2048, step_sequences: int = 64, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its window's size), step_group."""
    made = cut(pieces(docs, window, vocabulary))
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("part").alias("p"), F.col("length").alias("x"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    patterns = plan(histogram, window)
    places = made.sparkSession.sparkContext.broadcast(layout(patterns))
    steps = max(1, -(-sum(n for _, n, _ in patterns) // step_sequences))

    def put(batches):
        where = places.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset, tier = (np.empty(b.num_rows, np.int64) for _ in range(3))
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if b.num_rows else []:
                t = where[int(length[rows[0]])]
                i = np.searchsorted(t[:, 0], rank[rows], "right") - 1
                sequence[rows], offset[rows], tier[rows] = t[i, 1] + rank[rows] - t[i, 0], t[i, 2], t[i, 3]
            deal, at = np.divmod(sequence, steps)
            group = np.where(deal % 2 == 0, at, steps - 1 - at)
            made = [pa.array(sequence), pa.array(offset), pa.array(tier, pa.int32()), pa.array(group)]
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *made], [*names, "sequence_id", "offset", "tier", "step_group"])

    ranked = made.join(firsts, (made["part"] == firsts["p"]) & (made["length"] == firsts["x"])).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(put, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long, tier int, step_group long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
