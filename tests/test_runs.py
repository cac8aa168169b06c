"""Networks by configuration, saved runs, resuming and predictions from a folder alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from protelith.functions.hashing import sequence_hash
from protelith.plans import config, models, pipeline, runs, trainer, training

from .test_networks import table
from .test_training import GOOD, SCHEMA, unlike, value

FAST = {"num_epochs": 12, "patience": 12, "batch_size": 8, "learning_rate": 0.03}


@pytest.fixture(scope="module")
def valued(spark):
    rows = [(s, q, str(round(10 * (q.count("A") * 1.5 + q.count("D") * 0.7) / len(q), 3)), k) for s, q, _, k in unlike()]
    return spark.createDataFrame(rows, SCHEMA).cache()


def embedded(records):
    return pipeline.composition_embedding(records).select(sequence_hash(F.col("seq"), F.col("seq_id")).alias("seq_hash"), F.col("target").alias("label"), "embedding", "set")


def said(df):
    return {r.seq_hash: r.pred for r in df.select("seq_hash", "pred").collect()}


@pytest.mark.parametrize("choice,optimizer", [("FNN", "adam"), ("DeeperFNN", "sgd")])
def test_networks_for_values_beat_the_mean(spark, choice, optimizer):
    df, _, _ = table(spark, 300)
    rows = df.select("seq_hash", "features", F.col("_y")[0].alias("label"), (F.substring("seq_hash", 2, 9).cast("int") % 4).alias("part"))
    o = {"num_epochs": 15, "patience": 15, "epsilon": 0.001, "batch_size": 16, "seed": 1, "optimizer_choice": optimizer, "learning_rate": 0.02 if optimizer == "adam" else 0.005, "dropout_rate": 0.0}
    fitted = models.network(choice)(rows.where("part > 1"), rows.where("part = 1"), o, False)
    got = fitted.predict(rows.where("part = 0")).agg(F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("mse"), F.var_pop("label").alias("spread")).first()
    assert got.mse < 0.5 * got.spread and len(fitted.epochs) == 15


def test_gaussian_process_by_configuration(spark, valued):
    done = pipeline.run(config.verified(GOOD | {"protocol": "sequence_to_value", "model_choice": "GP", "num_epochs": 2}), valued)
    assert value(done.results["metrics"], "mse") < value(done.results["baselines"], "mse", model="mean_only")
    assert {"std", "lower", "upper"} <= set(done.predictions.columns)


def test_convolution_over_residues_with_masks(spark):
    rows = [(i, s, "".join("H" if x in "AC" else "L" for x in s), k, "01" * (len(s) // 2) + "1" * (len(s) % 2)) for i, s, _, k in unlike(30)]
    done = pipeline.run(config.verified(GOOD | FAST | {"protocol": "residue_to_class", "model_choice": "CNN", "use_class_weights": True}), spark.createDataFrame(rows, SCHEMA + ", mask string"))
    assert value(done.results["metrics"], "accuracy") > 0.95
    of_test = {s: m for i, s, _, k, m in rows if k == "test"}
    assert done.predictions.where("role = 'test' and label is not null").count() == sum(m.count("1") for m in of_test.values())
    assert done.predictions.where("role = 'test'").count() == sum(len(s) for s in of_test)
    values = [(i, s, ";".join("1.0" if x in "AC" else "-1.0" for x in s), k) for i, s, _, k in unlike(30)]
    done = pipeline.run(config.verified(GOOD | FAST | {"protocol": "residue_to_value", "model_choice": "CNN"}), spark.createDataFrame(values, SCHEMA))
    assert value(done.results["metrics"], "mse") < 0.2


def test_light_attention_over_residues(spark, records_of):
    done = pipeline.run(config.verified(GOOD | FAST | {"protocol": "residues_to_class", "model_choice": "LightAttention", "scaling_method": "standard"}), records_of)
    assert value(done.results["metrics"], "accuracy") > 0.9
    with pytest.raises(config.ConfigError, match="no model"):
        config.verified(GOOD | {"protocol": "residues_to_class", "model_choice": "FNN"})
    with pytest.raises(config.ConfigError, match="can't act on"):
        config.verified(GOOD | {"protocol": "residues_to_class", "model_choice": "LightAttention", "bottleneck_dim": 8})


@pytest.fixture(scope="module")
def records_of(spark):
    return spark.createDataFrame(unlike(), SCHEMA).cache()


def test_folds_and_a_nested_search_take_one_scan_each(spark, records_of, monkeypatch):
    """A joint training of the folds equals the loop; a nested search is one training of all its fits."""
    options = GOOD | FAST | {"model_choice": "FNN", "num_epochs": 2, "cross_validation_config": {"method": "k_fold", "k": 2, "choose_by": "accuracy"}}
    key = F.col("seq_id").alias("seq_hash")
    samples = records_of.select(key, F.col("set").alias("role"), F.col("target").alias("label"), F.array(F.length("seq").cast("double"), F.crc32("seq") / 2e9).alias("features")).cache()
    scans = []
    real = trainer.train
    monkeypatch.setattr(trainer, "train", lambda rows, fits, **o: scans.append(len(fits)) or real(rows, fits, **o))
    a = training.train(config.verified(options), samples)
    with monkeypatch.context() as m:
        m.setattr(training, "can_train_together", lambda c: False)
        b = training.train(config.verified(options), samples)
    assert scans == [2, 1, 1]
    assert [np.allclose(x.fitted.model.parameters, y.fitted.model.parameters, atol=1e-12) for x, y in zip(a.splits, b.splits)] == [True, True]
    assert sorted(map(tuple, a.metrics.collect())) == sorted(map(tuple, b.metrics.collect()))
    scans.clear()
    nested = options | {"bottleneck_dim": [4, 8], "num_epochs": 1, "cross_validation_config": options["cross_validation_config"] | {"nested": True, "nested_k": 2, "search_method": "grid_search"}}
    c = training.train(config.verified(nested), samples)
    assert scans == [2 * 2 * 2, 2] and len(c.searched) == 4
    for name, parameters in ((s.name, s.parameters) for s in c.splits):
        assert parameters in [p for n, p, v in c.searched if n == name and v == max(w for m, _, w in c.searched if m == name)]


@pytest.mark.parametrize("choice,more", [("FNN", FAST), ("LogReg", {}), ("Centroid", {})])
def test_predictions_from_the_folder_equal_those_of_the_run(spark, records_of, tmp_path, choice, more):
    out = str(tmp_path / "run")
    done = pipeline.run(config.verified(GOOD | more | {"model_choice": choice, "scaling_method": "standard", "output_dir": out}), records_of)
    run = runs.open_run(spark, out)
    rows = embedded(records_of).where("set = 'test'")
    assert said(run.predict(rows)) == said(done.predictions) and run.best == "hold_out" and run.splits == ["hold_out"]
    mine = {r.metric: r.value for r in run.evaluate(rows).collect()}
    theirs = {r.metric: r.value for r in done.results["metrics"].where("set_name = 'test'").collect()}
    assert mine.keys() == theirs.keys() and all(abs(mine[k] - theirs[k]) < 1e-12 for k in mine)
    ci = {r.metric: r for r in run.bootstrapped(rows, iterations=10).collect()}
    assert ci["accuracy"].lower <= ci["accuracy"].mean <= ci["accuracy"].upper
    with pytest.raises(ValueError, match="no split"):
        run.predict(rows, "other")
    assert spark.read.parquet(f"{out}/predictions").count() == len(said(done.predictions))  # reports stand beside the parts


def test_projection_and_values_from_the_folder(spark, valued, tmp_path):
    out = str(tmp_path / "run")
    options = GOOD | FAST | {"protocol": "sequence_to_value", "model_choice": "FNN", "scaling_method": "standard", "dimension_reduction_method": "pca", "n_reduced_components": 3, "output_dir": out}
    done = pipeline.run(config.verified(options), valued)
    run = runs.open_run(spark, out)
    rows = embedded(valued).where("set = 'test'")
    got, want = said(run.predict(rows)), said(done.predictions)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    passes = run.forward_passes(rows, n=6).collect()
    assert all(len(r.mcd_predictions) == 6 and r.mcd_lower[0] <= r.mcd_mean[0] <= r.mcd_upper[0] and abs(r.mcd_mean[0] - r.pred) < 1e-12 and abs(np.mean(r.mcd_predictions) - r.pred) < 1e-9 for r in passes)
    with pytest.raises(ValueError, match="confidence"):
        run.forward_passes(rows, confidence_level=2.0)


def test_bald_scores_of_a_fitted_network(spark, records_of, tmp_path):
    out = str(tmp_path / "run")
    pipeline.run(config.verified(GOOD | FAST | {"model_choice": "FNN", "dropout_rate": 0.4, "output_dir": out}), records_of)
    run = runs.open_run(spark, out)
    rows = run.forward_passes(embedded(records_of), n=12).collect()
    assert all(0 <= r.bald_score <= np.log(2) + 1e-9 and set(r.mcd_predictions) <= {"x", "y"} and r.pred in "xy" for r in rows)
    assert any(r.bald_score > 0 for r in rows)


def test_a_loop_over_splits_resumes_after_the_last_finished_one(spark, records_of, tmp_path, monkeypatch):
    options = GOOD | {"model_choice": "LogReg", "cross_validation_config": {"method": "k_fold", "k": 4, "choose_by": "accuracy"}}
    whole = pipeline.run(config.verified(options), records_of)
    options |= {"output_dir": str(tmp_path / "run"), "auto_resume": True}
    real, calls = training.fitted, []

    def lost(config, parameters, split):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(split.name)
        return real(config, parameters, split)

    monkeypatch.setattr(training, "fitted", lost)
    with pytest.raises(RuntimeError):
        pipeline.run(config.verified(options), records_of)
    with pytest.raises(config.ConfigError, match="no finished run"):
        runs.open_run(spark, options["output_dir"])
    monkeypatch.setattr(training, "fitted", lambda *a: calls.append(a[2].name) or real(*a))
    again = pipeline.run(config.verified(options), records_of)
    assert calls == ["k_fold-1", "k_fold-2", "k_fold-3", "k_fold-4"]
    assert sorted(map(tuple, again.results["splits"].collect())) == sorted(map(tuple, whole.results["splits"].collect())) and said(again.predictions) == said(whole.predictions)
    with pytest.raises(config.ConfigError, match="other options"):
        pipeline.run(config.verified(options | {"seed": 7}), records_of)


def test_joint_training_resumes_after_the_last_committed_epoch(spark, records_of, tmp_path, monkeypatch):
    options = GOOD | FAST | {"model_choice": "FNN", "num_epochs": 9, "cross_validation_config": {"method": "k_fold", "k": 3, "choose_by": "accuracy"}}
    whole = pipeline.run(config.verified(options), records_of)
    options |= {"output_dir": str(tmp_path / "run"), "auto_resume": True}
    monkeypatch.setattr(runs, "EVERY", 2)
    keep, epochs = runs.Folder.keep_states, []

    def lost(self, epoch, states):
        keep(self, epoch, states)
        epochs.append(epoch)
        if epoch == 3:
            raise RuntimeError("lost")

    monkeypatch.setattr(runs.Folder, "keep_states", lost)
    with pytest.raises(RuntimeError):
        pipeline.run(config.verified(options), records_of)
    assert runs.Folder(spark, options["output_dir"]).parts("states") == ["states/000003"]
    again = pipeline.run(config.verified(options), records_of)
    assert epochs == [1, 3, 5, 7]
    assert said(again.predictions) == said(whole.predictions) and again.results["epochs"] == whole.results["epochs"]
    third = pipeline.run(config.verified(options), records_of)  # all is there
    assert epochs == [1, 3, 5, 7] and said(third.predictions) == said(whole.predictions)


def test_pretrained_networks_go_on(spark, records_of, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    first = pipeline.run(config.verified(GOOD | FAST | {"model_choice": "FNN", "output_dir": a}), records_of)
    more = pipeline.run(config.verified(GOOD | FAST | {"model_choice": "FNN", "output_dir": b, "pretrained_model": a, "num_epochs": 2}), records_of)
    assert more.results["epochs"][0][2] <= first.results["epochs"][-1][2] + 0.1 < first.results["epochs"][0][2]
    with pytest.raises(config.ConfigError, match="another network"):
        pipeline.run(config.verified(GOOD | FAST | {"model_choice": "DeeperFNN", "pretrained_model": a}), records_of)


def test_fits_of_a_search_are_measured_together(spark, records_of, monkeypatch):
    """One evaluation for all inner fits, with the values that each has by itself; folds are dealt once for all uses."""
    tables = [spark.createDataFrame([(f"k{i}", a, b) for i, (a, b) in enumerate(x)], "seq_hash string, label string, pred string") for x in ([("a", "a"), ("b", "a"), (None, "a"), ("c", "c")], [("a", "b"), ("b", "b")])]
    for metric in ("accuracy", "macro_f1", "spearman"):
        want = [value(training.metrics.evaluated(t, "sequence_to_class"), metric) for t in tables]
        assert np.allclose(training._values(tables, "sequence_to_class", metric), want)
    numbers = [spark.createDataFrame([(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "seq_hash string, label double, pred double") for x in ([(1, 2), (3, 3), (5, 9)], [(4, 4), (2, 1), (0, 3)])]
    for metric in ("rmse", "spearman"):
        assert np.allclose(training._values(numbers, "sequence_to_value", metric), [value(training.metrics.evaluated(t, "sequence_to_value"), metric) for t in numbers])
    with pytest.raises(config.ConfigError, match="no metric"):
        training._values(tables, "sequence_to_class", "nonsense")
    samples = records_of.select(F.col("seq_id").alias("seq_hash"), F.col("set").alias("role"), F.col("target").alias("label"), F.array(F.length("seq").cast("double"), F.crc32("seq") / 2e9).alias("features")).cache()
    calls, real = [], training.metrics.evaluated
    monkeypatch.setattr(training.metrics, "evaluated", lambda *a, **o: calls.append(1) or real(*a, **o))
    done = training.train(config.verified(GOOD | FAST | {"model_choice": "FNN", "num_epochs": 1, "bottleneck_dim": [4, 8], "cross_validation_config": {
        "method": "k_fold", "k": 2, "nested": True, "nested_k": 2, "search_method": "grid_search", "choose_by": "accuracy"}}), samples)
    assert len(calls) == 1 + 2 and len(done.searched) == 4
