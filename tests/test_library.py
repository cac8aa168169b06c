import datetime
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from protelith.functions import sequences, vectors as vec
from protelith.operators import embedders, leaderboard, metrics, results, splits, uncertainty, validate, variants, vectors
from protelith.plans import config
from protelith.sources import fasta, tables
from protelith.streaming import monitor

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_fasta_roundtrip(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text(">A TARGET=x SET=train TARGET=y ignored=1\nSEQ\nWENCE\n\n>B INTERACTOR=A mySET=val\nPRT\n>C\n")
    got = {r.seq_id: r for r in fasta.read_fasta(spark, str(path)).collect()}
    assert got["A"].seq == "SEQWENCE" and got["A"].target == "y" and got["A"].set == "train"
    assert got["B"].interactor == "A" and got["B"].set == "val" and got["C"].seq == ""
    assert {r.seq_id: r.seq for r in fasta.read_fasta(spark, str(path), "last").collect()}["A"] == "WENCE"
    kept, n = fasta.filter_fasta(spark, str(path), str(tmp_path / "out"), F.length("seq") > 3)
    assert (kept, n) == (1, 3)
    again = fasta.read_fasta(spark, str(tmp_path / "out")).collect()
    assert [(r.seq_id, r.seq, r.attributes) for r in again] == [("A", "SEQWENCE", {"TARGET": "y", "SET": "train"})]


def test_from_sequences(spark):
    assert [r.seq_id for r in fasta.from_sequences(spark, ["AC", "DE"]).collect()] == ["Seq0", "Seq1"]


def test_assay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mutant,mutated_sequence,DMS_score\nA1G,GC,0.5\nA1G:C2D,GD,x\n")
    assert tables.read_assay(spark, str(tmp_path / "a.csv"), single_only=True).count() == 1
    (tmp_path / "b.csv").write_text("mutant,DMS_score\nA1G,0.5\n")
    with pytest.raises(ValueError, match="mutated_sequence"):
        tables.read_assay(spark, str(tmp_path / "b.csv"))


def test_store(spark, tmp_path):
    e = spark.createDataFrame([("h1", "a", [1.0, 2.0])], "seq_hash string, original_id string, embedding array<float>")
    tables.write_embeddings(e, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="1 embeddings are missing"):
        tables.read_embeddings(spark, str(tmp_path / "s"), spark.createDataFrame([("h1",), ("h2",)], "seq_hash string"))


def test_preprocessing(spark):
    row = spark.createDataFrame([("SEQ<mask>UZ",)], "s string").select(
        sequences.spaced(F.col("s"), "<mask>").alias("a"), sequences.clean_rare(F.col("s")).alias("b"), sequences.fold_prefix(F.col("s")).alias("c")).first()
    assert row == ("S E Q <mask> U Z", "SEQ<mask>XX", "<AA2fold> SEQ<mask>UZ")


@pytest.mark.parametrize(("variant", "mutant"), [
    ("K2R", "WRTPV"), ("W1Y", "YKTPV"), ("T3A:V5I", "WKAPI"), ("K2R:K2Q", None), ("T2R", None), ("P9A", None), ("K2", None), ("", None)])
def test_variants(spark, variant, mutant):
    df = spark.createDataFrame([("WKTPV", variant)], "wt string, v string").withColumn("m", sequences.parse_variant(F.col("v")))
    got = df.select(sequences.mutant_sequence(F.col("wt"), F.col("m"))).first()[0]
    assert got == mutant


def test_edge_weights(spark):
    w = [r.w for r in spark.range(1024).select(variants.edge_weight(F.col("id")).alias("w")).collect()]
    assert w[0] == w[1023] == w[257] == w[765] == 1.0 and w[128] == w[894] == 0.5
    assert w[1] < 0.001 and w[1022] < 0.001 and w[256] > 0.999 and w[766] > 0.999
    assert all(abs(w[i] - w[1022 - i]) < 1e-12 for i in range(1, 257))


def test_arrays(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(
        vec.softmax(F.col("v")).alias("s"), vec.log_softmax(F.col("v")).alias("l"), vec.argmax(F.col("v")).alias("a"), vec.pad(F.col("v"), 5).alias("p"),
        vec.bald(F.array(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5)))).alias("b")).first()
    assert abs(sum(row.s) - 1) < 1e-12 and row.a == 2 and row.p == [1, 2, 3, 0, 0] and abs(row.b) < 1e-9
    assert abs(row.l[2] + 0.4076059644) < 1e-9


@FEW
@given(st.integers(2, 6), st.integers(2, 40))
def test_k_fold_blocks(spark, k, n):
    rows = splits.k_fold(spark.range(n), k, "id").orderBy("id").collect()
    sizes = [Counter(r.fold for r in rows)[i] for i in range(k)]
    assert sizes == [n // k + (i < n % k) for i in range(k)]
    assert [r.fold for r in rows] == sorted(r.fold for r in rows)


def test_split_plans(spark):
    assert splits.leave_p_out(spark.range(5), 2, "id").count() == 10
    assert splits.leave_p_out(spark.range(100), 2, "id").count() == 4950
    nested = splits.nested_k_fold(spark.range(20), 4, 3, "id")
    assert nested.where("role = 'test'").count() == 20
    assert nested.where("role = 'val'").groupBy("outer").count().select("count").distinct().collect() == [(15,)]
    assert splits.parameter_values("range(0, 10, 4)") == [0, 4, 8] and splits.parameter_values("[1e-3, 1e-4]") == [1e-3, 1e-4]
    assert len(splits.parameter_grid({"a": [1, 2], "b": "range(3)"})) == 6
    assert splits.continuous_bins(spark.range(7).selectExpr("5.0D AS v"), "v").select("bin").distinct().collect() == [(0,)]


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40))
def test_classification(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, pred int")
    got = metrics.classification(metrics.confusion(df)).first()
    assert got.accuracy == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    classes = {c for p in pairs for c in p}
    recall = [sum(p == (c, c) for p in pairs) / max(1, sum(p[0] == c for p in pairs)) for c in classes]
    assert got.macro_recall == pytest.approx(sum(recall) / len(classes))
    assert -1.000001 <= got.matthews <= 1.000001


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(20)], "id int, label double, pred double")
    assert metrics.spearman(df).first()[0] == pytest.approx(1.0)
    assert metrics.ndcg(df, [], "id").first()[0] == pytest.approx(1.0)
    assert metrics.ndcg(df.limit(9), [], "id").first()[0] == 0.0
    assert metrics.spearman(df.withColumn("pred", F.lit(1.0))).first()[0] == 0.0


def test_interval(spark):
    rows = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("row_ix"), (F.col("id") % 2).alias("hit"))
    drawn = uncertainty.resampled(rows, ["g"])
    assert drawn.count() == 1500
    ci = uncertainty.interval(drawn.groupBy("g", "iteration").agg(F.avg("hit").alias("v")), ["g"], "v").first()
    assert ci.lower <= ci.mean <= ci.upper and abs(ci.mean - 0.5) < 0.1


def test_early_stop(spark):
    losses = [(0, 1.0), (1, 0.5), (2, 0.6), (3, 0.6), (4, 0.6), (5, 0.1)]
    got = splits.early_stop(spark.createDataFrame(losses, "epoch int, loss double"), [], 2).first()
    assert (got.best_epoch, got.best_loss, got.stop_epoch) == (1, 0.5, 4)


def test_interval_ranks(spark):
    s = spark.createDataFrame([("a", "c", 0.1, 0.0, 0.2), ("b", "c", 0.25, 0.15, 0.35), ("d", "c", 0.9, 0.8, 1.0)], "entry string, category string, mean double, lower double, upper double")
    assert {r.entry: r["rank"] for r in leaderboard.interval_ranks(s).collect()} == {"a": 1, "b": 1, "d": 3}


def test_validation(spark):
    r = spark.createDataFrame([("a", "AC1", "x", None), ("b", "", None, "train"), ("c", "ACD", None, "pred")], "seq_id string, seq string, target string, set string")
    assert [x.bad_letter for x in validate.bad_letters(r).collect()] == ["1"]
    assert {x.seq_id: x.problem for x in validate.bad_targets(r, False, True).collect()} == {"a": "missing set", "b": "missing target"}
    with pytest.raises(validate.Violation):
        validate.raise_on_violation(validate.missing_roles(r), "sets")


def test_running_sums_within_groups(spark):
    rows = [(g, i * 7 % 50, i % 3) for g in (None, "a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, x int, n int")
    got = {(r.g, r.x): (r.ordinal, r.b) for r in splits._numbered(splits.running_before(df, ["x"], ["g"], F.col("n"), "b"), ["x"], ["g"]).collect()}
    for g in (None, "a", "b"):
        total = 0
        for k, (x, n) in enumerate(sorted((x, n) for h, x, n in rows if h == g)):
            assert got[g, x] == (k, total)
            total += n


def test_average_ranks(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (None, 1.0), ("a", 2.0), ("a", None), ("a", 2.0), ("a", 3.0)], "g string, v double")
    got = sorted(((r.g or "", r.v or 0.0, r["rank"]) for r in metrics.average_ranks(df, "v", ["g"], "rank").collect()))
    assert got == [("", 1.0, 1.0), ("", 5.0, 2.5), ("", 5.0, 2.5), ("a", 0.0, 1.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 3.0, 4.0)]


def test_kmers(spark):
    row = spark.createDataFrame([("ABCDE", "AB", "", None)], "a string, b string, c string, d string").select(
        *[sequences.kmers(F.col(c)).alias(c) for c in "abcd"], sequences.chunks(F.col("a")).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (["ABC", "BCD", "CDE"], [], [], None, ["ABC", "DE"])


def test_resampled_to_a_size(spark):
    rows = spark.range(10).select(F.lit("g").alias("g"), F.col("id").alias("row_ix"))
    assert uncertainty.resampled(rows, ["g"], 3, size=25).groupBy("iteration").count().collect() == [(i, 25) for i in range(3)] or {
        tuple(r) for r in uncertainty.resampled(rows, ["g"], 3, size=25).groupBy("iteration").count().collect()} == {(i, 25) for i in range(3)}
    assert uncertainty.resampled(rows, ["g"], 2, size=4).count() == 8


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.073388), (0.5, 3, 0.651448), (0.0, 7, 1.0), (1.0, 1, 0.5), (-3.0, 30, 0.005389)])
def test_p_of_t(t, df, p):
    assert uncertainty.two_sided_p(t, df) == pytest.approx(p, abs=1e-5)


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    rows, explained = vectors.pca(df, df, 3)
    values, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(explained, (values / values.sum())[::-1][:3])
    got = np.array([r.projected for r in rows.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ axes[:, ::-1][:, :3]), atol=1e-8)


def test_scales_and_noise(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# a matrix\n   C  A  X  B\nA -1  4  0  9\nC  8 -1 -2  9\nX -2  0 -1  9\nB 9 9 9 9\n")
    scales = embedders.read_scales(spark, str(tmp_path / "m.txt"))
    assert {r.letter: r["values"] for r in scales.collect()} == {"A": [4, -1, 0], "C": [-1, 8, -2], "X": [0, -2, -1]}
    df = spark.createDataFrame([("ACW", "k"), ("", "k"), (None, "j")], "seq string, key string")
    got = [r.embedding for r in embedders.scale_residues(df, scales).collect()]
    assert got == [[[4, -1, 0], [-1, 8, -2], [0, -2, -1]], [], []]
    assert [r.embedding for r in embedders.scale_residues(df, scales, unknown=None).collect()][0][2] == [0, 0, 0]
    noise = [r.embedding for r in embedders.random_vectors(df, "key", 16).collect()]
    assert noise[0] == noise[1] != noise[2] and len(noise[0]) == 16 and all(0 <= x < 1 for x in noise[0])


def test_batches_keep_to_the_budget(spark):
    seen = []

    def embed(seqs):
        assert sum(map(len, seqs)) < 30 or len(seqs) == 1
        return [[float(len(s))] for s in seqs]

    df = spark.createDataFrame([(i, "A" * (i * 13 % 40)) for i in range(50)], "id int, seq string")
    for r in embedders.in_batches(df, embed, "id int, seq string, embedding array<double>", budget=30).collect():
        assert r.embedding == [len(r.seq)]
        seen.append(r.id)
    assert sorted(seen) == list(range(50))
    assert [r.id for r in embedders.longest_first(df.limit(5)).collect()] == [3, 2, 1, 4, 0]


def test_masking(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKL" * 20) for i in range(20)] + [(99, "A"), (100, "")], "id int, seq string")
    rows = embedders.masked(df, "id").collect()
    drawn = sum(t != -100 for r in rows[:20] for t in r.targets)
    assert 450 < drawn < 750 and sum(r.masked.count("<mask>") for r in rows[:20]) / drawn == pytest.approx(0.8, abs=0.06)
    for r in rows:
        assert len(r.targets) == len(r.seq) and all(t in (-100, "ACDEFGHIKLMNPQRSTVWXY".index(x)) for t, x in zip(r.targets, r.seq))
    assert rows[20].targets == [0] and rows[21].masked == "" and rows[21].targets == []


def test_store_names():
    assert embedders.store_path("out/", "sequence_to_class", "org/model", True) == "out/sequence_to_class/model/reduced_embeddings_file_model_half.parquet"
    assert embedders.store_name("one_hot", False) == "embeddings_file_one_hot.parquet"


def test_matched_scores_raise(spark):
    score = lambda rows: spark.createDataFrame(rows, "variant string, score double")
    assert variants.matched_scores(score([("A1C", 0.5)]), score([("A1C", 2.0)])).collect() == [("A1C", 0.5, 2.0)]
    for bad in ([("A1D", 2.0)], [], [("A1C", 1.0), ("A1C", 2.0)]):
        with pytest.raises(validate.Violation):
            variants.matched_scores(score([("A1C", 0.5)]), score(bad))


def test_reports(spark, tmp_path):
    rows = [("m", "2024-01-01", {"t": (1, 9, {"test": {"acc": 0.5}})}, {"z": ("wt", {"all": {"scc": 0.25}})})]
    tables.write_report(spark.createDataFrame(rows, tables.REPORT), str(tmp_path))
    (tmp_path / "bad.json").write_text("{not json")
    found = tables.load_report(spark, str(tmp_path), "m", "2024-01-01")
    assert {tuple(r) for r in tables.report_rows(found).collect()} == {("m", "supervised", "t", "test", "acc", 0.5), ("m", "zeroshot", "z", "all", "scc", 0.25)}
    assert tables.load_report(spark, str(tmp_path / "none"), "m", "x").first().supervised_results == {}


def test_observers_and_output(spark, tmp_path):
    seen = []
    run = results.Observed({"seed": 1}, (lambda name, values: seen.append((name, values)), results.table_observer(spark, str(tmp_path / "t"))))
    run.add("epoch", loss=0.5)
    run.add("epoch", accuracy=1.0)
    run.save(str(tmp_path / "out.yml"))
    again = results.Observed.loaded(str(tmp_path / "out.yml"))
    assert seen == [("epoch", {"loss": 0.5}), ("epoch", {"accuracy": 1.0})] and again.configuration == {"seed": 1} and again.derived == {"epoch": {"loss": 0.5, "accuracy": 1.0}}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_model_hash(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    one = results.model_hash([("x", df)], {"a": 1, "b": 2})
    assert len(one) == 16 and one == results.model_hash([("x", df.orderBy(F.desc("i")))], {"b": 2, "a": 1})
    assert len({one, results.model_hash([("x", df.limit(1))], {"a": 1, "b": 2}), results.model_hash([("x", df)], {"a": 1}), results.model_hash([("x", df)], {"a": 1, "b": 2}, True)}) == 4


@pytest.mark.parametrize(("arguments", "fine"), [
    (("flip", None, 1, 9), True), (("ProteinGym", "wt_marginals"), True), (("flip", "x", 1, 9), False), (("flip", None, 9, 9), False), (("flip", None, None, 9), False),
    (("flip", None, -9, 0), False), (("proteingym",), False), (("other", "x"), False)])
def test_benchmark_arguments(arguments, fine):
    if fine:
        results.check_benchmark(*arguments)
    else:
        with pytest.raises(ValueError):
            results.check_benchmark(*arguments)


def test_order_and_times(spark):
    df = spark.createDataFrame([("human",), ("nonvirus",), ("virus",)], "task string")
    assert [r.task for r in results.virus_first(df).collect()] == ["nonvirus", "virus", "human"]
    found = results.elapsed(datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 2, 500_000))
    assert found == {"start_time": "2024-01-01T00:00:00", "end_time": "2024-01-01T00:00:02.500000", "elapsed_time": 2.5}


GOOD = {"protocol": "sequence_to_class", "input_file": "x.fasta"}


@pytest.mark.parametrize("bad", [
    {"protocol": "nonsense"}, {"input_file": None}, {"input_file": "x.txt"}, {"input_data": [1]}, {"unknown": 1}, {"seed": -1}, {"seed": True}, {"num_epochs": 0},
    {"embedder_name": "a", "embeddings_file": "b"}, {"n_reduced_components": 3}, {"learning_rate": [1e-3, 1e-4]}, {"scaling_method": "other"},
    {"model_choice": "CNN"}, {"protocol": "sequence_to_value", "model_choice": "FNN"}, {"learning_rate": 1e-3}, {"patience": 3}, {"model_choice": "FNN", "use_class_weights": True},
    {"protocol": "residues_to_class"}, {"auto_resume": True}, {"pretrained_model": "m", "cross_validation_config": {"method": "k_fold", "k": 3}},
    {"protocol": "residue_to_class", "dimension_reduction_method": "pca", "n_reduced_components": 2}, {"embeddings_file": "e", "use_half_precision": True},
    {"cross_validation_config": {"method": "hold_out", "repeat": 2}}, {"protocol": "sequence_to_value", "cross_validation_config": {"method": "k_fold", "k": 3, "stratified": True}},
    {"protocol": "residue_to_class", "interaction": "multiply"}, {"protocol": "sequence_to_value", "use_class_weights": True},
    *[{"cross_validation_config": c} for c in ({"method": "k_fold"}, {"method": "hold_out", "k": 3}, {"method": "leave_p_out"}, {"method": "k_fold", "k": 3, "p": 1}, {"method": "k_fold", "k": 1},
                                               {"method": "k_fold", "k": 3, "nested": True}, {"method": "k_fold", "k": 3, "nested": True, "nested_k": 2, "search_method": "grid_search"},
                                               {"method": "k_fold", "k": 3, "n_max_evaluations_random": 3})],
])
def test_config_rules(bad):
    with pytest.raises(config.ConfigError):
        config.verified(GOOD | bad)


def test_config_defaults():
    c = config.verified(GOOD | {"model_choice": "FNN", "learning_rate": [1e-3, 1e-4], "cross_validation_config": {"method": "k_fold", "k": 3, "nested": True, "nested_k": 2, "search_method": "grid_search"}})
    assert c["seed"] == 42 and config.search_space(c) == {"learning_rate": [1e-3, 1e-4]}


def test_scaler_and_centroids(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (0, [2.0, 1.0]), (1, [10.0, 1.0])], "label int, embedding array<double>")
    scaled = vectors.scale(df, vectors.fit_scaler(df))
    assert all(r.scaled[1] == 0 for r in scaled.collect())
    got = vectors.nearest_centroid(scaled, vectors.mean_by(scaled, ["label"], "scaled")).collect()
    assert [r.prediction for r in got] == [r.label for r in got]


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    batch = {(r.start, r.event_type): r.n for r in monitor.tumbling(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = monitor.tumbling(stream).writeStream.outputMode("update").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.start, r.event_type): r.n for r in spark.table("counts").collect()} == batch


def test_fasta_with_any_line_ends_and_tabs(spark, tmp_path):
    path = tmp_path / "crlf.fasta"
    path.write_bytes(b">a TARGET=x SET=train\t\r\nACD\r\nEF\r\n\r\n>b\r\n GH\t\r\n\t\r\n>c TARGET=y\r\nKL\r\n")
    got = {r.seq_id: (r.seq, r.target, r.set) for r in fasta.read_fasta(spark, str(path)).collect()}
    assert got == {"a": ("ACDEF", "x", "train"), "b": ("GH", None, None), "c": ("KL", "y", None)}
    assert {r.seq_id: r.seq for r in fasta.read_fasta(spark, str(path), "last").collect()} == {"a": "EF", "b": "GH", "c": "KL"}


def test_scales_and_wild_types_that_are_not_one(spark, tmp_path):
    path = tmp_path / "scale.txt"
    path.write_text("# a comment\n" * 2000 + "first second\nA 1 2\nC 3 4\n")
    assert {r.letter: r["values"] for r in embedders.read_scales(spark, str(path)).collect()} == {"A": [1.0, 2.0], "C": [3.0, 4.0]}
    path.write_text("first\nA 1\nC 2\nA 3\n")
    with pytest.raises(ValueError, match="several lines for A"):
        embedders.read_scales(spark, str(path))
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "pppl double, perplexity double")
    with pytest.raises(ValueError, match="several wild types"):
        variants.against_wild_type(rows, rows)


@pytest.mark.parametrize("classes", ["ab", "abc"])
def test_class_suite_from_counts(spark, classes):
    r = np.random.default_rng(3)
    label, pred = (r.choice(list(classes), 60) for _ in "lp")
    rows = spark.createDataFrame([("k" if i % 4 else "other", a if i else None, b) for i, (a, b) in enumerate(zip(label.tolist(), pred.tolist()))], "grp string, label string, pred string")
    got = {(x.grp, x.metric): x.value for x in metrics.evaluated(rows, "sequence_to_class", ["grp"]).collect()}
    for grp, keep in (("k", np.arange(60) % 4 > 0), ("other", np.arange(60) % 4 == 0)):
        keep = keep & (np.arange(60) > 0)
        a, b = label[keep], pred[keep]
        acc = (a == b).mean()
        assert all(abs(got[grp, m] - acc) < 1e-12 for m in ("accuracy", "micro_precision", "micro_recall", "micro_f1"))
        for c in classes:
            tp, of, said = ((a == c) & (b == c)).sum(), (a == c).sum(), (b == c).sum()
            want = {"precision": tp / max(said, 1), "recall": tp / max(of, 1), "accuracy": tp / max(of, 1), "f1": 2 * tp / max(of + said, 1)}
            assert all(abs(got[grp, f"{m} class {c}"] - v) < 1e-12 for m, v in want.items())
            if classes == "ab" and c == "b":
                assert all(abs(got[grp, m] - want[n]) < 1e-12 for m, n in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1")))
        assert ((grp, "f1_score") in got) == (classes == "ab")
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        assert abs(got[grp, "spearman"] - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-9
