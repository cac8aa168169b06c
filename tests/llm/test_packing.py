import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from protelith.llm import packing

from .conftest import MEDIUM, SMALL


def check(rows, n_docs):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    return docs, sequences


def test_round_trip(spark, plain):
    rows = packing.query(spark, SMALL).collect()
    docs, sequences = check(rows, len(plain))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in rows}
    for i, t in plain:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, total in sorted(docs[i]):
            assert start == at and total == len(ids) and crc[i, start] == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)
    used = [sum(n for _, n in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding < 0.02 * sum(used)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 50), max_size=30))
def test_plan_places_everything(counts):
    placed = {}
    for lengths, repeat, tier in packing.plan(counts):
        assert sum(lengths) <= tier and (tier == 2048 or sum(lengths) == tier)
        assert tier == 2048 or max(lengths) > tier // 2 or tier == packing.TIERS[0]
        for x in lengths:
            placed[x] = placed.get(x, 0) + repeat
    assert placed == counts


def test_layout_places_every_rank_once():
    counts = {1: 40, 56: 9, 200: 30, 256: 3, 312: 11, 700: 8, 1348: 7, 2048: 2}
    patterns, seen = packing.plan(counts), set()
    table = packing.layout(patterns)
    for x, n in counts.items():
        for rank in range(n):
            t = table[x]
            i = np.searchsorted(t[:, 0], rank, "right") - 1
            place = (t[i, 1] + rank - t[i, 0], t[i, 2])
            assert place not in seen
            seen.add(place)
    used = {}
    for (s, _), x in zip(sorted(seen), [y for lengths, repeat, _ in patterns for _ in range(repeat) for y in lengths]):
        used[s] = used.get(s, 0) + x
    assert sorted(used) == list(range(sum(r for _, r, _ in patterns))) and max(used.values()) <= 2048


def test_tiers_change_the_plan(monkeypatch):
    counts = {200: 100, 56: 100, 300: 50, 212: 50, 2000: 4}
    with_tiers = {(tuple(p), tier) for p, _, tier in packing.plan(counts)}
    assert ((200, 56), 256) in with_tiers and ((300, 212), 512) in with_tiers
    monkeypatch.setattr(packing, "TIERS", (2048,))
    assert {tier for _, _, tier in packing.plan(counts)} == {2048}


def test_long_windows_are_filled_from_shorter_tiers():
    assert packing.plan({1500: 10, 500: 10, 48: 10}) == [([1500, 500, 48], 10, 2048)]


def test_step_groups_are_balanced(spark):
    rows = packing.pack(spark.read.parquet(f"{MEDIUM}/documents.parquet"), step_sequences=32).collect()
    assert len({r.tier for r in rows}) > 1
    group, sequences = {}, {}
    for r in rows:
        group[r.step_group] = group.get(r.step_group, 0) + packing.cost([r.length])
        sequences.setdefault(r.sequence_id, set()).add((r.tier, r.step_group))
    assert all(len(x) == 1 for x in sequences.values())
    mean = sum(group.values()) / len(group)
    assert len(group) > 3 and all(abs(x - mean) < 0.05 * mean for x in group.values())


def test_edge_cases(spark, edge, empty):
    rows = packing.pack(edge).collect()
    check(rows, 12)
    assert sum(r.doc_tokens == 1 and r.length == 1 for r in rows) == 3
    assert packing.pack(empty).count() == 0
    odd = ["<|endoftext|> x", "\u2028\u00a0 a  b\t\tc\n\n", "x" * 5000, "日本語テキスト 123 ² ½", "it's we'll I'D"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [packing.encoder()(t).tolist() for t in odd] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_added_tokens_have_their_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y", "<|endoftext", "plain"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    assert want[0] == [64, 50256, 65] and [packing.encoder()(t).tolist() for t in odd] == want
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs).collect()} == {
        i: (len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())) for i, ids in enumerate(want)}
