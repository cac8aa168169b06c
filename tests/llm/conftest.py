import pytest

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def plain(documents):
    """(doc_id, text) in order of doc_id."""
    return [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns with names that operators use."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
    same = "the same text stands in several documents and is longer than fifty bytes, so it repeats"
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (5, " \t\n "), (None, same), (None, None), (6, long), (7, long + " tail"), (8, "é" * 40 + " ünï"), (9, "one")]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None) for i, t in rows], SCHEMA)
    clash = {c: f"'{c}'" for c in ("node", "fp", "version", "_version", "_text", "_score", "bucket", "home", "length", "rank", "words", "score", "_lost")}
    return df.selectExpr("*", *[f"{v} AS {c}" for c, v in clash.items()])


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
