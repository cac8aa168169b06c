"""Conversation structure repair by a fold: faults of turns, the cheapest edits that restore the structure, and the repaired conversation.

Turns are taken by turn (nulls first), then role and text. A turn's first fault counts: blank (nothing but blanks), duplicate (role and text seen earlier in the conversation), truncated (it does not end with
``.``, ``!`` or ``?``). Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; blank and duplicate turns must be deleted, a truncated turn that
stays costs 1 more. The initials of the roles that are left form ``(s?(ua)+)?``.

Windows by conversation give the fault flags and the illegal neighbours; then the turns of a conversation are collected as structs in order, and ``aggregate()`` carries the cheapest (cost, audit) of four
states: nothing yet, after system, after user, after assistant. Native ``least`` keeps the smaller cost and of equal ones the smaller audit; both are safe to keep, as equally dear audits of a state are
never prefixes of each other (they would differ by inserts only, which cost). Conversations of more than ``BLOCK`` turns are folded by blocks, from each of the four states, and the blocks' results joined, so
audits are not copied once a turn. Where edits leave a turn its place in the conversation gives its new role, so the repaired text needs no second fold.

A conversation is one row, as its repaired text is one value; all shuffling is one exchange by conversation.

Rows: null role and text count as one blank, so such a text is a blank turn; a role without initial u, a or s, the empty role included, can't be kept; null turns come first and count in no gap; a null conv_id is a
conversation of its own; repeated rows are duplicates; turns of equal number are ordered by role and text; texts of any length are read whole; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
BLANKS = " \t\n\x0b\f\r"
STATES = ("e", "s", "u", "a")
KIND = "struct<cost:bigint,audit:string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that the hash of conversation and turn decides: of twenty, 0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name) % 20).alias("x")).where("x <> 0")
    role = F.when(F.col("x") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at (place), initial, fault ('' or b, d, t), illegal (with the turn before), fresh (the first of its turn number)."""
    blank = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).withColumn("initial", F.substring("role", 1, 1))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(order), "before": F.lag("initial").over(order), "turn_before": F.lag("turn").over(order)})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", "b").when(again, "d").when(~end.isin(".", "!", "?"), "t").otherwise("")
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    return rows.select("conv_id", "turn", "role", "text", "at", "initial", fault.alias("fault"), (F.col("before").isNotNull() & ~legal).alias("illegal"),
                       (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("fresh"))


def _plus(state: Column, cost: Column | int, letters: Column | str, possible: Column | None = None) -> Column:
    """The state with one more edit; null where the state or the edit is impossible."""
    can = state.isNotNull() if possible is None else state.isNotNull() & possible
    cost, letters = (F.lit(x) if not isinstance(x, Column) else x for x in (cost, letters))
    return F.when(can, F.struct((state["cost"] + cost.cast("long")).alias("cost"), F.concat(state["audit"], letters).alias("audit")))


def _states(*columns: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(columns, STATES)])


def _start(state: Column) -> Column:
    zero, none = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")), F.lit(None).cast(KIND)
    return _states(*[F.when(state == i, zero).otherwise(none) for i in range(len(STATES))])


def _inserted(c: Column) -> Column:
    """The states after the cheapest inserts before the next turn."""
    e, s, u, a = (c[n] for n in STATES)
    return _states(e, s, F.least(u, _plus(e, 2, "I"), _plus(s, 2, "I"), _plus(a, 2, "I")), F.least(a, _plus(u, 2, "I"), _plus(e, 4, "II"), _plus(s, 4, "II")))


def _after(c: Column, t: Column) -> Column:
    """The states after a turn."""
    e, s, u, a = (c[n] for n in STATES)
    stays, late = ~t["fault"].isin("b", "d"), (t["fault"] == "t").cast("long")
    keep = lambda state, initial: _plus(state, late, "K", stays & (t["initial"] == initial))
    turn = lambda state: _plus(state, late + 2, "R", stays)
    gone = lambda state: _plus(state, 3, "D")
    return _states(gone(e), F.least(gone(s), keep(e, "s")), F.least(gone(u), *[f(x) for x in (e, s, a) for f in (lambda x: keep(x, "u"), turn)]), F.least(gone(a), keep(u, "a"), turn(u)))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of turn structs (initial, fault), of equal ones the audit that comes first."""
    fold = lambda part, state: F.aggregate(part, _start(state), lambda acc, t: _let(_inserted(acc), lambda c: _after(c, t)))
    entries = lambda i: F.when(i == 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in range(len(STATES))]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int")), lambda i: F.transform(entries(i), lambda k: fold(F.slice(turns, i * BLOCK + 1, F.lit(BLOCK)), k)))

    def joined(acc: Column, block: Column) -> Column:
        ways = lambda x: [_plus(acc[n], way["cost"], way["audit"], way.isNotNull()) for k, n in enumerate(STATES) for way in [F.get(block, F.lit(k))[x]]]
        return _states(*[F.least(*ways(x)) for x in STATES])

    return F.aggregate(blocks, _start(F.lit(0)), joined, lambda c: F.least(c["e"], c["a"], _plus(c["u"], 2, "I"), _plus(c["s"], 4, "II")))


def repaired_text(turns: Column, audit: Column) -> Column:
    """``role:text`` of the turns after the edits, joined by newlines. The audit's letters up to a K, R or D belong to one turn; new roles alternate after a system turn or from the start."""
    line = lambda kind, role, text: F.struct(kind.alias("kind"), role.alias("role"), text.alias("text"))
    inserts = lambda letters: F.array_repeat(line(F.lit("I"), F.lit(""), F.lit("")), F.length(F.translate(letters, "KRD", "")))
    own = lambda edits, t: F.filter(F.array(line(F.substring(edits, -1, 1), t["role"], t["text"])), lambda x: x["kind"] != "D")
    edits = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))
    lines = F.concat(F.flatten(F.zip_with(edits, turns, lambda e, t: F.concat(inserts(e), own(e, t)))), inserts(F.regexp_extract(audit, "I*$", 0)))

    def written(all_lines: Column) -> Column:
        first = F.get(all_lines, F.lit(0))
        led = F.coalesce((first["kind"] == "K") & first["role"].startswith("s"), F.lit(False)).cast("int")
        role = lambda x, i: F.when(x["kind"] == "K", x["role"]).when((i - led) % 2 == 0, "user").otherwise("assistant")
        return F.array_join(F.transform(all_lines, lambda x, i: F.concat(role(x, i), F.lit(":"), x["text"])), "\n")

    return _let(lines, written)


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired."""
    count = lambda what: F.sum(what.cast("long"))
    turns = F.sort_array(F.collect_list(F.struct("at", "initial", "fault", "role", "text")))
    found = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0).cast("long")).alias("gaps"),
        *[count(F.col("fault") == letter).alias(name) for letter, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))], count(F.col("illegal")).alias("illegal"), turns.alias("turns"))
    best = found.withColumn("best", cheapest(F.col("turns"))).select("*", "best.cost", "best.audit")
    return best.withColumn("repaired", repaired_text(F.col("turns"), F.col("audit"))).drop("turns", "best")


def query(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repaired(damaged(given)).withColumn("repaired_sha256", F.sha2("repaired", 256)).withColumnRenamed("conv_id", "_conv_id")
    out = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same with a recursion by turn; a state is its cost in nine digits and its audit, so the least string is the cheapest."""
    plus = lambda x, n, letters: f"(lpad(((substr({x}, 1, 9))::BIGINT + {n})::VARCHAR, 9, '0') || substr({x}, 10) || '{letters}')"
    stays, late = "fault NOT IN ('b', 'd')", "(CASE WHEN fault = 't' THEN 1 ELSE 0 END)"
    keep = lambda x, initial: f"CASE WHEN {stays} AND initial = '{initial}' THEN {plus(x, late, 'K')} END"
    turn = lambda x: f"CASE WHEN {stays} THEN {plus(x, f'2 + {late}', 'R')} END"
    gone = lambda x: plus(x, 3, "D")
    user = ", ".join(f(x) for x in "esa" for f in (lambda x: keep(x, "u"), turn))
    return rf"""
WITH RECURSIVE table_of AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: unicode(z)::BIGINT),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS x FROM conversations, table_of),
damaged AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE WHEN x = 1 THEN '' WHEN x = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM x, (VALUES (0), (1)) t(copy) WHERE x <> 0 AND (copy = 0 OR x = 3)),
placed AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
flagged AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS two FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM flagged GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS k, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counts
  UNION ALL SELECT conv_id, k, {gone('e')}, least({gone('s')}, {keep('e', 's')}), least({gone('u')}, {user}), least({gone('a')}, {keep('u', 'a')}, {turn('u')})
  FROM (SELECT f.conv_id, f.k, f.fault, f.initial, e, s, least(u, {plus('e', 2, 'I')}, {plus('s', 2, 'I')}, {plus('a', 2, 'I')}) AS u,
    least(a, {plus('u', 2, 'I')}, {plus('e', 4, 'II')}, {plus('s', 4, 'II')}) AS a FROM walk w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1)),
best AS MATERIALIZED (SELECT c.*, least(e, a, {plus('u', 2, 'I')}, {plus('s', 4, 'II')}) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n),
letters AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS letter, unnest(range(1, length(best) - 8)) AS j FROM best WHERE length(best) > 9),
edits AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS k FROM letters),
lines AS (SELECT e.conv_id, j, letter, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text, f.role, row_number() OVER (PARTITION BY e.conv_id ORDER BY j) - 1 AS i
  FROM edits e LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.k = e.k WHERE letter <> 'D'),
led AS (SELECT conv_id, count(*) FILTER (i = 0 AND letter = 'K' AND role LIKE 's%') AS led FROM lines GROUP BY conv_id),
texts AS (SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (i - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS repaired
  FROM lines l JOIN led ON led.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY l.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""


SQL = _sql()
