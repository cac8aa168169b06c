import hashlib
import random
import zlib

import duckdb
import pytest

from protelith.llm import repair

from .conftest import MEDIUM, SMALL

BLANKS = " \t\n\x0b\f\r"
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def first(x):
    return (x is not None, x)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if x:
            out += [(conv, turn, "user" if x == 4 else role, "" if x == 1 else text.translate({ord(c): None for c in ".!?"}) if x == 2 else text)] * (2 if x == 3 else 1)
    return out


def cheapest(turns):
    """All ways as a search over (place, state), keeping every cheapest audit. turns of (initial, fault)."""
    best = {"e": {(0, ""): []}, "s": {}, "u": {}, "a": {}}

    def insert(states):
        for _ in range(3):
            for a, b in (("e", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                for (c, log), roles in list(states[a].items()):
                    if log.count("I") < 2 * len(turns) + 2 and not log.endswith("III"):
                        states[b].setdefault((c + 2, log + "I"), [*roles, (b, None)])

    for k, (initial, fault) in enumerate(turns):
        insert(best)
        after = {x: {} for x in "esua"}
        for state, ways in best.items():
            for (c, log), roles in ways.items():
                after[state][c + 3, log + "D"] = roles
                if fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    for to in "sua":
                        if to == "s" and state == "e" or to == "u" and state in "esa" or to == "a" and state == "u":
                            if initial == to:
                                after[to][c + late, log + "K"] = [*roles, (to, k, True)]
                            if to != "s":
                                after[to].setdefault((c + late + 2, log + "R"), [*roles, (to, k, False)])
        best = {x: {w: ways[w] for w in ways if w[0] <= min(ways)[0]} for x, ways in after.items()}  # all audits of the least cost of a state
    insert(best)
    return min((w, roles) for x in "ea" for w, roles in best[x].items())


def repaired(rows):
    """A result for each conversation, by the contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (first(r[0]), r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            last = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        (cost, audit), edits = cheapest([(role[:1], f) for (_, role, _), f in zip(own, faults)])
        names = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{names[e[0]]}:" if e[1] is None else f"{own[e[1]][1] if e[2] else names[e[0]]}:{own[e[1]][2]}" for e in edits)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    out = {r.conv_id: tuple(r)[1:] for r in df.select(*FIELDS[:-1], "repaired").collect()}
    return {k: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for k, v in out.items()}


@pytest.mark.parametrize("where", [SMALL, MEDIUM])
def test_query_equals_sql_and_brute_force(spark, where):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{where}/conversations.parquet'")
    df = repair.query(spark, where)
    rows = sorted(tuple(r) for r in df.select(*FIELDS).collect())
    assert set(df.columns) == set(FIELDS)
    assert rows == sorted(con.execute(f"select {', '.join(FIELDS)} from ({repair.SQL})").fetchall())
    given = [tuple(r) for r in spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = repaired(damage(given))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {r[0]: r[1:] for r in rows} == {c: want.get(c, empty) for c in {r[0] for r in given}}


def _random_rows(seed, conversations, longest):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "", " \n", "Ok? ", "Fine.", "so on", "Ünï.", None, "a:b\nc."]
    out = []
    for conv in range(conversations):
        for t in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant"] * 3 + ["system", "tool", "", "Assistant", "ugly", None])
            out.append((conv if conv else None, None if r.random() < 0.05 else t + r.randrange(3), role, r.choice(texts)))
    return out


def test_random_conversations(spark):
    rows = _random_rows(5, 150, 9)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(*r, "at") for r in rows], schema + ", at string")
    filled = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    assert got(repair.repaired(df)) == repaired(filled)
    assert got(repair.repaired(repair.damaged(df))) == repaired(damage(rows))


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [r for r in _random_rows(6, 40, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = got(repair.repaired(df))
    monkeypatch.setattr(repair, "BLOCK", 3)
    assert got(repair.repaired(df)) == want


def test_a_long_conversation(spark):
    n = 5000
    rows = [(1, i, ("user", "assistant")[i % 2] if i % 7 else "user", f"turn {i}.") for i in range(n)]
    row = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert row.gaps == row.blank == 0 and len(row.audit) >= n and row.repaired.count("\n") + 1 == sum(c != "D" for c in row.audit)
    assert row.cost == sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in row.audit)


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repaired(spark.createDataFrame([], schema)).collect() == []
    blank = spark.createDataFrame([(1, 0, "user", " "), (2, None, None, None)], schema)
    assert {r.conv_id: (r.cost, r.audit, r.repaired) for r in repair.repaired(blank).collect()} == {1: (3, "D", ""), 2: (3, "D", "")}
