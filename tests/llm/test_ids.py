"""Document ids that no double holds, beside null ids, come back as they are from every operator."""

import pytest

from protelith.llm import decontaminate, licenses, packing, passages, quality, rules, sharding, simhash, suffixes, toxicity

from .conftest import SCHEMA, SMALL

BIG = 1 << 53
IDS = [BIG + 1, None, BIG + 3, -BIG - 1, None, (1 << 62) + 1, 7]


@pytest.fixture(scope="module")
def far(spark):
    rows = [(i, f"document {n} of a few that differ in a number, what is license {n}", "en", None, None) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


OPERATORS = {
    "op1": lambda df, _: simhash.near_duplicates(df), "op2": lambda df, _: rules.judged(df), "op3": lambda df, _: sharding.external_shuffle(df, 4), "op5": lambda df, _: licenses.scan(df),
    "op6": lambda df, labels: toxicity.with_scores(df, toxicity.train(df, labels)), "op7": lambda df, labels: quality.with_scores(df, quality.train(df, labels)), "op8": lambda df, _: packing.pack(df),
    "op10": lambda df, _: suffixes.remove_repeats(df), "op13": lambda df, _: passages.remove_passages(df)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ids_are_exact(spark, far, name):
    labels = spark.createDataFrame([(i, n % 2, n % 2) for n, i in enumerate(IDS) if i is not None], "doc_id long, quality int, toxic int")
    got = [r.doc_id for r in OPERATORS[name](far, labels).select("doc_id").collect()]
    assert sorted(got, key=repr) == sorted(IDS, key=repr)


def test_leaks_name_exact_ids(spark, far):
    bench = spark.createDataFrame([("x", "document 2 of a few that differ in a number, what is license 2")], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.leaks(far, bench).where("form = 'plain'").collect()} >= {BIG + 3}
    assert set(r.doc_id for r in decontaminate.leaks(far, bench).collect()) <= set(IDS)
