import duckdb
import pytest

from protelith.llm import licenses

from .conftest import SMALL

def scanned(text, templates=licenses.TEMPLATES):
    return licenses.scanned(text, licenses.Automaton(templates), licenses.anchors(templates))


KINDS = licenses.Automaton((("a", "one [or two] three"), ("b", "start <3> end"), ("c", "[maybe] must")))


@pytest.mark.parametrize(("text", "want"), [
    ("x one three y", {"a"}), ("one or two three", {"a"}), ("one or three", set()), ("one one three", {"a"}), ("start a end", {"b"}), ("start a b c end", {"b"}),
    ("start end", set()), ("start a b c d end", set()), ("start start a end", {"b"}), ("must", {"c"}), ("maybe must", {"c"}), ("maybe", set()), ("", set())])
def test_automaton(text, want):
    assert KINDS.labels(text.encode().split()) == want


def test_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    rel = con.execute(licenses.SQL)
    names = [c[0] for c in rel.description]
    want = sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: r["doc_id"])
    got = [r.asDict() for r in licenses.query(spark, SMALL).orderBy("doc_id").collect()]
    assert got == want and any(r["labels"] for r in got)


def test_places(spark):
    texts = ["Under the MIT license; under THE mit License!", "Apache License, Version 2.0 ccbync cc by-nc", "undér the mit license", None]
    got = [scanned(t)[:6] for t in texts]
    assert got == [(8, 2, 0, 4, "mit", "mit"), (9, 2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (4, 0, None, None, "", ""), (0, 0, None, None, "", "")]


ODD = ["a cc_by_nc b", "_cc by nc_", "CC-BY-NC", "accby nc", "under_the_mit_license.apache license;version 2", "Copyright (c) 2020 Jo Doe. All rights reserved", "copyright all rights reserved",
       "x" * 200_000 + " under the MIT license", "", None, "licence", "under the mit licenses", "permission is hereby granted, free of charge"]


def filled(label):
    """A template's text with every optional word and one word for each gap."""
    text = [t for name, t in licenses.TEMPLATES if name == label][-1]
    return " ".join("someone" if t[0] == "<" else t for t in licenses._parts.findall(text) if t not in "[]")


def test_odd_texts_match_sql(spark):
    texts = [*ODD, *(filled(x).title() for x, _ in licenses.TEMPLATES), filled("mit").replace("noninfringement", "infringement"), filled("bsd-3-clause").replace("someone", "the x y z")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    rel = con.execute(licenses.SQL)
    names = [c[0] for c in rel.description]
    want = sorted((dict(zip(names, r)) for r in rel.fetchall()), key=lambda r: r["doc_id"])
    got = [r.asDict() for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert got == want
    assert got[0]["n_base"] == 1 and got[0]["labels"] == "cc-by-nc"
    assert all(label in got[len(ODD) + i]["labels"].split(",") for i, (label, _) in enumerate(licenses.TEMPLATES))
    assert got[-2]["labels"] == "" and got[-1]["labels"] == "bsd-3-clause"


def test_templates_of_a_caller(spark):
    own = (("x", "alpha [beta] gamma"), ("y", "[maybe] q <2> r"))
    docs = spark.createDataFrame(list(enumerate(["see alpha gamma", "Alpha_beta.GAMMA q s r", "alpha x gamma"])), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs, own).orderBy("doc_id").collect()] == ["x", "x,y", ""]
    assert licenses.anchors((("z", "[a] <3>"),)).search(b"") is not None


def test_edge_cases(spark, edge, empty):
    got = licenses.scan(edge).collect()
    assert len(got) == 12 and licenses.scan(empty).count() == 0
    words = {r.doc_id: r.n_words for r in got if r.doc_id is not None}
    assert (words[3], words[4], words[5], words[6], words[8], words[9]) == (0, 0, 0, 120_000, 2, 1) and all(r.labels == "" for r in got)


def test_underscores_separate_words():
    assert scanned("shared under cc_by_nc terms") == (6, 1, 2, 2, "cc-by-nc", "cc-by-nc", 0.8)
    assert scanned("_cc by nc_") == (3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 0.8)
    assert scanned("a_cc_b") == (3, 0, None, None, "", "", 0.0)  # as in the SQL
