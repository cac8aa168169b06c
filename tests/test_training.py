"""Configured runs, end to end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from protelith.operators import vectors
from protelith.plans import config, models, pipeline, training
from protelith.sources import tables

GOOD = {"protocol": "sequence_to_class", "input_data": True, "bootstrapping_iterations": 3}
SCHEMA = "seq_id string, seq string, target string, set string"


def unlike(n=60):
    rng = random.Random(3)
    return [(f"s{i}", "".join(rng.choices("AC" if i % 2 else "DE", k=12)) + "ACDE"[i % 4] * (i % 5), "x" if i % 2 else "y", ("train", "val", "test")[min(2, i % 5)]) for i in range(n)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(unlike(), SCHEMA).cache()


def value(found, metric, **where):
    for k, v in where.items():
        found = found.where(F.col(k) == v)
    return found.where(F.col("metric") == metric).first()["value"]


def test_hold_out(spark, records):
    done = pipeline.run(config.verified(GOOD | {"use_class_weights": True}), records)
    assert value(done.results["metrics"], "accuracy") > 0.9 and done.results["best_split"] == "hold_out"
    ci = done.results["intervals"].where("model = 'model' and metric = 'accuracy'").first()
    assert ci.lower <= ci.mean <= ci.upper
    assert {r.model for r in done.results["baselines"].select("model").distinct().collect()} == {"random_sampling"}
    assert {(r.set_name, r.n) for r in done.results["set_sizes"].collect()} == {("test", 36), ("total", 36)}
    with pytest.raises(ValueError, match="no such steps"):
        pipeline.run(config.verified(GOOD), records, other=lambda c: c)


def test_k_fold_and_test_set_by_best_split(spark, records, tmp_path):
    options = GOOD | {"model_choice": "Centroid", "output_dir": str(tmp_path / "out"), "cross_validation_config": {"method": "k_fold", "k": 3, "repeat": 2, "stratified": True, "choose_by": "accuracy"}}
    done = pipeline.run(config.verified(options), records)
    splits = [r.split_name for r in done.results["splits"].where("metric = 'accuracy'").collect()]
    assert sorted(splits) == sorted(f"k_fold-strat-rep-{f}-{r}" for f in (1, 2, 3) for r in (1, 2))
    best = max(r.value for r in done.results["splits"].where("metric = 'accuracy'").collect())
    assert value(done.results["splits"], "accuracy", split_name=done.results["best_split"]) == best
    mean = np.mean([r.value for r in done.results["splits"].where("metric = 'accuracy'").collect()])
    assert abs(value(done.results["average"], "accuracy") - mean) < 1e-12
    assert spark.read.parquet(str(tmp_path / "out" / "predictions")).count() == 36


def test_folds_deal_every_row_once(spark, records):
    samples = records.select(F.col("seq_id").alias("seq_hash"), F.col("set").alias("role"), F.col("target").alias("label"))
    seen = [r.seq_hash for s in training.folds(samples, 4) for r in s.val.collect()]
    assert sorted(seen) == sorted(r.seq_hash for r in samples.where("role <> 'test'").collect())
    for s in training.folds(samples, 4):
        assert not {r.seq_hash for r in s.train.collect()} & {r.seq_hash for r in s.val.collect()}


def test_leave_p_out(spark, records):
    few = records.where("set = 'test'").unionByName(records.where("set <> 'test'").orderBy("seq_id").limit(5))
    done = pipeline.run(config.verified(GOOD | {"model_choice": "Centroid", "cross_validation_config": {"method": "leave_p_out", "p": 2}}), few.withColumn(
        "set", F.when(F.col("set") == "val", "train").otherwise(F.col("set"))))
    assert done.results["splits"].where("metric = 'accuracy'").count() == 10


def test_nested_search(spark, records):
    options = GOOD | {"model_choice": ["Centroid", "LogReg"], "cross_validation_config": {
        "method": "k_fold", "k": 2, "nested": True, "nested_k": 2, "search_method": "grid_search", "choose_by": "accuracy"}}
    done = pipeline.run(config.verified(options), records)
    searched = done.results["searched"]
    assert len(searched) == 4 and {p["model_choice"] for _, p, _ in searched} == {"Centroid", "LogReg"}
    assert done.results["best_parameters"]["model_choice"] in ("Centroid", "LogReg")


def test_perceptron_stops_early(spark, records):
    done = pipeline.run(config.verified(GOOD | {"model_choice": "FNN", "num_epochs": 100, "patience": 1, "epsilon": 0.001}), records)
    epochs = done.results["epochs"]
    assert 1 < len(epochs) and done.results["best_epoch"] in [e for e, _, _ in epochs] and epochs[-1][0] <= 100
    losses = [v for _, _, v in epochs]
    assert min(losses) <= losses[0] and value(done.results["metrics"], "accuracy") > 0.8


def test_limited_sample(spark, records):
    c = config.verified(GOOD | {"limited_sample_size": 4, "model_choice": "Seen"} if models.register("Seen", lambda t, v, o, k: models.Fitted(
        lambda rows, n=t.count(): rows.withColumn("pred", F.lit(str(n))))) is None else {})
    done = pipeline.run(c, records)
    assert {r.pred for r in done.predictions.select("pred").distinct().collect()} == {"4"}


def test_values_with_projection(spark):
    rows = [(s, q, str(q.count("A") * 1.5 + q.count("D")), k) for s, q, _, k in unlike()]
    c = config.verified(GOOD | {"protocol": "sequence_to_value", "scaling_method": "standard", "dimension_reduction_method": "pca", "n_reduced_components": 3})
    done = pipeline.run(c, spark.createDataFrame(rows, SCHEMA))
    assert value(done.results["metrics"], "mse") < value(done.results["baselines"], "mse", model="mean_only")
    assert len(done.results["explained_variance"]) == 3 and done.samples.select(F.size("features")).first()[0] == 3


def test_residues_with_masks(spark):
    rows = [(i, s, "".join("H" if x in "AC" else "L" for x in s), k, "01" * (len(s) // 2) + "1" * (len(s) % 2)) for i, s, _, k in unlike(30)]
    r = spark.createDataFrame(rows, SCHEMA + ", mask string")
    done = pipeline.run(config.verified(GOOD | {"protocol": "residue_to_class"}), r)
    assert value(done.results["metrics"], "accuracy") == 1.0
    used = done.samples.where("label is not null").count()
    assert used == sum(m.count("1") for *_, m in rows) < done.samples.count() == sum(len(s) for _, s, *_ in rows)
    with pytest.raises(ValueError, match="masks"):
        pipeline.run(config.verified(GOOD | {"protocol": "residue_to_class"}), r.withColumn("mask", F.lit("0")))
    with pytest.raises(ValueError, match="targets"):
        pipeline.run(config.verified(GOOD | {"protocol": "residue_to_class"}), r.withColumn("target", F.lit("H")))


def test_interactions(spark):
    rows = [(f"s{i}", s, "1" if (i % 2) == ((i + 2) % 4 % 2) else "0", k) for i, s, _, k in ((int(a[1:]), *b) for a, *b in unlike(40))]
    r = spark.createDataFrame(rows, SCHEMA).withColumn("target", (F.crc32("seq") % 2).cast("string")).withColumn("interactor", F.concat(F.lit("s"), (F.substring("seq_id", 2, 9).cast("int") + 5) % 40))
    done = pipeline.run(config.verified(GOOD | {"interaction": "concat"}), r)
    assert done.samples.count() == 40 and done.samples.select(F.size("features")).first()[0] == 42
    both = r.unionByName(r.where("seq_id = 's0'").withColumns({"seq_id": F.lit("s5"), "interactor": F.lit("s0"), "seq": F.lit(rows[5][1]), "target": F.lit("7")}))
    with pytest.raises(ValueError, match="several targets"):
        pipeline.run(config.verified(GOOD | {"interaction": "concat"}), both.dropDuplicates(["seq_id", "interactor"]))
    with pytest.raises(ValueError, match="no record"):
        pipeline.run(config.verified(GOOD | {"interaction": "concat"}), r.withColumn("interactor", F.lit("none")))


def test_embeddings_from_a_store(spark, records, tmp_path):
    e = pipeline.composition_embedding(records).select(pipeline.sequence_hash(F.col("seq"), F.col("seq_id")).alias("seq_hash"), F.col("seq_id").alias("original_id"), "embedding")
    tables.write_embeddings(e, str(tmp_path / "e"))
    options = GOOD | {"model_choice": "Centroid", "embeddings_file": str(tmp_path / "e")}
    assert value(pipeline.run(config.verified(options), records).results["metrics"], "accuracy") > 0.9
    tables.write_embeddings(e.limit(50), str(tmp_path / "few"))
    with pytest.raises(ValueError, match="10 embeddings are missing"):
        pipeline.run(config.verified(options | {"embeddings_file": str(tmp_path / "few")}), records)


def test_scaler_round_trip(spark, records, tmp_path):
    fitted = vectors.fit_scaler(pipeline.composition_embedding(records))
    tables.write_parameters(fitted, str(tmp_path / "s"))
    assert sorted(tables.read_parameters(spark, str(tmp_path / "s")).collect()) == sorted(fitted.collect())


def test_logistic_regression_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), str(k)) for v, k in zip(x, y)], "features array<double>, label string")
    a, w = np.c_[x, np.ones(200)], np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]), a.T @ (y - p))
    model = models.linear(df, None, {"num_epochs": 100, "epsilon": 1e-9}, True).model
    assert np.allclose(np.r_[model.coefficients.toArray(), model.intercept], w, atol=1e-3)
    assert {r.pred for r in models.fit_predict(df, df, True).select("pred").distinct().collect()} == {"0", "1"}


def test_several_passes(spark, records):
    rows = records.select("seq_id", F.col("target").alias("label"), F.array(F.length("seq").cast("double")).alias("features"))
    fits = [models.centroid(rows.where(F.crc32("seq_id") % 3 != i), None, {}, True) for i in range(3)]
    assert models.passes(fits, rows, ["seq_id"]).groupBy("seq_id").agg(F.count("pred").alias("n")).where("n <> 3").count() == 0
