import random
import re
from collections import defaultdict

import pytest

from protelith.llm import common, decontaminate

from .conftest import SMALL

ITEM = "then Tom has 3 apples and Sue has 5 apples so Tom and Sue have how many apples after 7 days in total"
SALE = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many in May. How many clips did Natalia sell?"
NUMBERS, UNITS = (set(x.replace("(?:er|re)", "er").replace("?", "").split("|")) for x in (decontaminate.NUMBERS, "days|weeks|miles|km|dollars"))


def leaked(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.form for r in decontaminate.leaks(docs, bench).collect()}


def forms(text):
    """Words and their template, one by one."""
    text = re.sub(r"(?<=\d)[.,](?=\d)", "", text or "")
    raw, plain, template = re.findall(r"[^\W_]+", text), [], []
    for i, w in enumerate(raw):
        number = w.isdigit() or w.lower() in NUMBERS
        after = template and template[-1] == "#n" and re.search(rf"(?<![^\W_]){re.escape(raw[i - 1])}[\s-]{{1,3}}{re.escape(w)}(?![^\W_])", text)
        plain.append(w.lower())
        template.append("#n" if number else "#u" if after and w in UNITS else "#c" if re.fullmatch(r"[A-ZÀ-Þ][a-zß-ÿ]+", w) else w.lower())
    return plain, template


def brute(docs, items, window=8):
    windows, items = defaultdict(list), {k: forms(x) for k, x in items.items()}
    for k, both in items.items():
        n = min(window, len(both[0]))
        for form, words in zip(("plain", "template"), both):
            for w in range(len(words) - n + 1 if n else 0):
                windows[form, tuple(words[w:w + n])].append((k, w, n))
    found, lengths = {}, {len(x) for _, x in windows}
    for d, text in docs.items():
        spots = defaultdict(set)
        both = forms(text)
        for form, words in zip(("plain", "template"), both):
            for n in lengths:
                for i in range(len(words) - n + 1):
                    for k, w, _ in windows.get((form, tuple(words[i:i + n])), ()):
                        spots[k, None if form == "plain" else i - w] |= set(range(w, w + n))
        for (k, shift), at in spots.items():
            ip, it = items[k]
            if 2 * len(at) < len(ip) or found.get((d, k)) == "plain":
                continue
            pairs = {(it[x], ip[x], both[0][x + shift]) for x in at if it[x][0] == "#"} if shift is not None else set()
            names = [(a, b) for kind, a, b in pairs if kind == "#c"]
            if len({x[:2] for x in pairs}) == len(pairs) and len({b for _, b in names}) == len(names):
                found[d, k] = "plain" if shift is None else "template"
    return found


def test_reparameterised_items(spark):
    ann = "look then Ann has 8 apples and Joe has 2 apples so Ann and Joe have how many apples after 9 days in total ok"
    got = leaked(spark, [ITEM, ITEM.upper(), ann, ann.replace("so Ann", "so Bob"), ann.replace("Ann", "Joe"), ann.replace("9 days", "9 weeks"), "apples and pears", None, "",
                         ann.replace("8 apples", "2,500 apples").replace("has 2", "has twelve")])
    assert got == {(0, 0): "plain", (1, 0): "plain", (2, 0): "template", (5, 0): "template", (9, 0): "template"}


def test_names_at_the_start_of_sentences(spark):
    other = SALE.replace("Natalia", "Weng").replace("48", "1,200").replace("April", "June").replace("May", "July")
    got = leaked(spark, [other, other.replace("Weng then", "\nWeng then"), other.replace("1,200", "3.5"), other.replace("did Weng", "did Ling"), other.replace("July", "June"),
                         other.replace("1,200 of her friends", "ten of her friends")], [SALE])
    assert got == {(i, 0): "template" for i in (0, 1, 2, 5)}


def test_plain_coverage(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    half, less = " ".join(["a", *words[:15], "b"]), " ".join(words[:14])
    got = leaked(spark, [half, less, "x; W0 -- " + "! ".join(words), "w1 w2", " ".join([*words[:12], "odd", *words[13:22]])], [item, "hello there world", "", "...", " ".join(words[:22])])
    assert got == {(0, 0): "plain", (2, 0): "plain", (4, 0): "plain", (0, 4): "plain", (1, 4): "plain", (2, 4): "plain", (4, 4): "plain"}
    assert leaked(spark, ["say hello, there (world) now"], [item, "hello there world"]) == {(0, 1): "plain"}


@pytest.mark.parametrize("bits", [7, common.BITMAP_BITS])
def test_query_matches_brute_force(spark, plain, monkeypatch, bits):
    """With a bitmap that is full, and so drops nothing, too."""
    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = brute(dict(plain), items)
    got = {(r.doc_id, r.item_id): r.form for r in decontaminate.query(spark, SMALL).collect()}
    assert want and got == want


def test_planted_variants_match_brute_force(spark):
    r = random.Random(8)
    names, things = ["Ada", "Bo", "Cy", "Dee", "Eve", "Flo", "Gus"], ["pens", "cups", "maps", "keys"]
    story = "{a} has {x} {t} and gives {y} of them to {b} before walking {z} {u} home. {a} then counts what is left and {b} says that {a} has {w} {t} too many for the week"
    numbers = [*map(str, range(2, 99)), "3.5", "1,250", "seven"]
    fill = lambda: story.format(**dict(zip("ab", r.sample(names, 2))), t="cups", u=r.choice(["miles", "km"]), **dict(zip("xyzw", r.sample(numbers, 4))))
    items = {0: fill(), 1: SALE}
    planted = [f"Some words come first, as {r.choice(things)} do. {fill()} and more words follow it here" for _ in range(40)]
    clean = [" ".join(r.choices("a the cup pen map Key has of them then counts left 3 miles".split(), k=60)) for _ in range(20)]
    broken = [x.replace(" says that ", " says that Zoe and ").replace(" gives ", " never gives ").replace(" then counts ", " now counts ") for x in planted[:10]]
    docs = dict(enumerate(planted + clean + broken))
    got = leaked(spark, list(docs.values()), list(items.values()))
    assert got == brute(docs, items)
    assert sum((i, 0) in got for i in range(40)) == 40 and not any((i, 0) in got for i in range(40, 60))


def test_edge_cases(spark, edge, empty):
    bench = spark.createDataFrame([(1, "the same text stands in several documents and is longer"), (2, None), (None, "x"), (1, "the same text stands in several documents and is longer")],
                                  "item_id long, text string")
    got = decontaminate.leaks(edge, bench)
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(edge, bench.where("false")).count() == 0
    kept = decontaminate.drop_leaks(edge, bench)
    assert kept.columns == edge.columns and kept.count() == 8 and kept.where("doc_id is null").count() == 1
    assert decontaminate.drop_leaks(edge, bench.where("false")).count() == 12


def test_rows_are_judged_by_their_own_text(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:15])), (1, " ".join(words[20:35])), (None, " ".join(words)), (2, " ".join(words[:20]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, len(r.text.split())) for r in decontaminate.drop_leaks(docs, bench).collect()] == [(1, 15), (1, 15)]


def test_long_texts_move_as_windows_only(spark, monkeypatch):
    """Nothing is dropped by the bitmap, and what is shuffled is still eight words a position, not the text."""
    monkeypatch.setattr(common, "BITMAP_BITS", 7)
    words = [f"word{i % 9973}x{i % 31}" for i in range(30_000)]
    docs = spark.createDataFrame([(i, " ".join(words[i:] + words[:i])) for i in range(4)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words[500:530])), (2, "none of these words is there at all in any text")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_matched) for r in decontaminate.leaks(docs, bench).where("form = 'plain'").collect()) == [(i, 1, 23) for i in range(4)]
