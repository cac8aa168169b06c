import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from protelith.llm import toxicity

from .conftest import SMALL
from .test_classifiers import brute_score
from .test_decontaminate import brute as brute_leaks
from .test_packing import check as check_packing
from .test_simhash import brute_similar, closed

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage gets and gives, as run() chains them."""
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = (docs, out)
        docs = out
    return seen


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_columns_and_clean_documents(stages, documents):
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "packing"]
    for name, (_, out) in stages.items():
        assert name == "packing" or out.columns == documents.columns
    assert stages["packing"][0].count() > 0.6 * documents.count()
    assert stages["packing"][0].selectExpr("bool_and(n_chars = length(text))").first()[0]


def test_toxicity_matches_brute_force(spark, stages):
    docs, out = stages["toxicity"]
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), toxicity.remainder(5) != 0)
    want = {i for i, t in texts(docs).items() if brute_score(model, t) < 0.5}
    assert set(texts(out)) == want and 0 < len(texts(docs)) - len(want) < 40


def test_near_duplicates_match_brute_force(stages):
    docs, out = stages["near_duplicates"]
    sets, pairs = brute_similar(list(texts(docs).items()))
    assert set(texts(out)) == {i for i, c in closed(sets, pairs).items() if i == c}


def test_repeated_strings_match_brute_force(stages):
    docs, out = stages["repeated_strings"]
    before, first, want = texts(docs), {}, {}
    bodies = {i: t.encode() for i, t in before.items()}
    for i, b in sorted(bodies.items()):
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    for i, b in bodies.items():
        gone = set()
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone |= set(range(p, p + 50))
        left = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        if not gone or left.strip(" "):
            want[i] = left
    assert texts(out) == want and want != before


def test_leaks_match_brute_force(spark, stages):
    docs, out = stages["decontamination"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert set(texts(out)) == set(texts(docs)) - {d for d, _ in brute_leaks(texts(docs), items)}


def test_packing_holds_every_token(stages):
    docs, out = stages["packing"]
    rows = out.collect()
    placed, _ = check_packing(rows, docs.count())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: sum(n for _, n, _ in parts) for i, parts in placed.items()} == {
        i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(docs).items()}


def test_edge_rows_pass_all_stages(spark, edge, empty):
    docs, kept = edge, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        kept[name] = docs
    assert kept["toxicity"].count() == 12 and kept["decontamination"].columns == edge.columns
    assert sorted((r.doc_id or 0) for r in kept["near_duplicates"].collect()) == [0, 0, 1, 3, 6, 8, 9]
    assert sorted((r.doc_id or 0) for r in kept["decontamination"].collect()) == [0, 0, 1, 3, 6, 8, 9]
    assert kept["packing"].select("doc_id").distinct().count() == 6
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
    assert docs.count() == 0


def test_whole_characters(spark):
    rows = [("bad � sign".encode(), "bad � sign"), ("aé".encode()[:2] + b"b", "ab"), ("a�".encode() + b"\xbd", "a�"), (b"", "")]
    df = spark.createDataFrame([(bytearray(b), w) for b, w in rows], "b binary, want string")
    assert df.where(corpus_pipeline.whole_characters(F.col("b").cast("string")) != F.col("want")).count() == 0


def test_run_returns_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == stages["packing"][1].columns and out.count() == stages["packing"][1].count()
