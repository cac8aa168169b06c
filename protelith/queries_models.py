"""Queries that train models on the driver's tables. SQL has no counterpart; tests compare the library beneath with numpy, differences and loops."""

from pyspark.sql import functions as F

from .functions import vectors as vec
from .operators import baselines, metrics
from .queries import query, r6, read, samples

FAST = {"input_data": True, "num_epochs": 8, "patience": 8, "batch_size": 32, "learning_rate": 0.01}


def vector_samples(spark, d, numeric):
    """``embeddings`` as samples of a run, with a value (or a class) that follows from the first two dimensions, as the table's own labels can't be told from the vectors."""
    s = samples(spark, d)
    one, two = (F.col("embedding")[i].cast("double") for i in (0, 1))
    label = 8 * one + 8 * F.abs(two) if numeric else F.when(one > 0.05, "high").when(one < -0.05, "low").otherwise("middle")
    return s.select(F.col("vec_id").cast("string").alias("seq_hash"), "vec_id", "role", label.alias("label"), vec.doubles(F.col("embedding")).alias("features"))


@query()
def gp_predictions(spark, d):
    """A Gaussian process on the training vectors, with its 95 per cent interval for the test vectors."""
    from .plans import gaussian

    s = vector_samples(spark, d, True)
    model = gaussian.fit(s.where("role = 'train'"), steps=2)
    found = model.predict(s.where("role = 'test'"))
    return found.select("vec_id", *[F.round(c, 4).alias(c) for c in ("pred", "std", "lower", "upper")])


@query()
def fnn_value_metrics(spark, d):
    """A network with one hidden layer for values, and the mean of the training labels, measured on the test vectors."""
    from .plans import config, training

    s = vector_samples(spark, d, True).persist()
    done = training.train(config.verified(FAST | {"protocol": "sequence_to_value", "model_choice": "FNN"}), s)
    test = s.where("role = 'test'")
    said = {"FNN": done.best.fitted.predict(test), "mean_only": baselines.mean_of_train(s.where("role = 'train'"), test)}
    every = None
    for name, p in said.items():
        rows = p.select(F.lit(name).alias("model"), "seq_hash", "label", "pred")
        every = rows if every is None else every.unionByName(rows)
    return metrics.regression(every, ["model"]).select("model", r6(F.col("mse"), 4).alias("mse"), r6(F.col("rmse"), 4).alias("rmse"))


@query()
def mc_dropout_predictions(spark, d):
    """Test vectors with the mean, spread and BALD score of thirty forward passes of a fitted network."""
    from .plans import config, training

    s = vector_samples(spark, d, False).persist()
    done = training.train(config.verified(FAST | {"protocol": "sequence_to_class", "model_choice": "FNN"}), s)
    found = done.best.fitted.model.passes(s.where("role = 'test'"))
    return found.select("vec_id", "pred", F.round(F.array_max("mcd_mean"), 4).alias("p"), F.round(F.get("mcd_std", F.array_position("mcd_mean", F.array_max("mcd_mean")).cast("int") - 1), 4).alias("std"),
                        F.round("bald_score", 4).alias("bald"), F.size(F.array_distinct("mcd_predictions")).alias("classes_seen"))


@query()
def joint_search(spark, d):
    """A nested search over two widths, all inner folds and parameters in one scan an epoch: the mean accuracy of each."""
    from .plans import config, training

    options = FAST | {"protocol": "sequence_to_class", "model_choice": "FNN", "num_epochs": 3, "bottleneck_dim": [8, 32], "cross_validation_config": {
        "method": "k_fold", "k": 2, "nested": True, "nested_k": 2, "search_method": "grid_search", "choose_by": "accuracy"}}
    done = training.train(config.verified(options), vector_samples(spark, d, False).persist())
    return spark.createDataFrame([(name, p["bottleneck_dim"], round(v, 4)) for name, p, v in done.searched], "split_name string, bottleneck_dim int, accuracy double")


def word_samples(spark, d):
    """Turns of ``conversations`` as sequences of word vectors (length, share of vowels, capital, end of sentence), dealt to roles of a run by hash."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    vowels = lambda w: F.length(w) - F.length(F.translate(w, "aeiouAEIOU", ""))
    vector = lambda w: F.array(F.length(w) / 10.0, vowels(w) / F.length(w), w.rlike(r"^\p{Lu}").cast("double"), w.rlike(r"[.!?]$").cast("double"))
    part = F.pmod(F.xxhash64("conv_id"), F.lit(10))
    rows = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("seq_hash"), "conv_id", "turn", F.col("role").alias("speaker"), words.alias("words"),
                                                  F.when(part < 7, "train").when(part < 8, "val").otherwise("test").alias("role"))
    return rows.where(F.size("words") > 0).withColumn("features", F.transform("words", vector))


@query()
def attention_speakers(spark, d):
    """An attention network over a turn's words that tells who speaks, and its share of right answers on the held-out conversations."""
    from .plans import config, training

    s = word_samples(spark, d).withColumn("label", F.col("speaker")).persist()
    done = training.train(config.verified(FAST | {"protocol": "residues_to_class", "model_choice": "LightAttention", "num_epochs": 5}), s)
    found = done.best.fitted.predict(s.where("role = 'test'"))
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 4).alias("right"))


@query()
def convolution_words(spark, d):
    """A convolution that tells of each word whether the next one begins a sentence, measured word by word on the held-out conversations."""
    from .plans import config, training

    s = word_samples(spark, d)
    label = F.transform("words", lambda w, i: F.when(F.get("words", i + 1).isNotNull(), F.get("words", i + 1).rlike(r"^\p{Lu}").cast("int").cast("string")))
    s = s.withColumn("label", label).drop("words").persist()
    done = training.train(config.verified(FAST | {"protocol": "residue_to_class", "model_choice": "CNN", "num_epochs": 5}), s)
    found = training.measured(done.best.fitted.predict(s.where("role = 'test'")), True).where("label is not null")
    return metrics.classification(metrics.confusion(found)).select(*[F.round(c, 4).alias(c) for c in ("accuracy",)])


_COUNTS = """c AS (SELECT substr(t, i, 1) AS l, substr(t, i + 1, 1) AS x, substr(t, i + 2, 1) AS r, count(*) AS n FROM
  (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', ' ', 'g') AS t FROM documents WHERE length(text) > 2)) GROUP BY ALL),
p AS (SELECT p_partkey, p_name, 1 + p_partkey % length(p_name) AS pos FROM part),
v AS (SELECT p_partkey, substr(' ' || p_name || ' ', pos, 1) AS l, substr(p_name, pos, 1) AS wt, substr(' ' || p_name || ' ', pos + 2, 1) AS r, chr(97 + (p_partkey % 26)::INTEGER) AS mt, pos FROM p)"""


@query(f"""WITH {_COUNTS}
SELECT v.p_partkey, wt || pos || mt AS variant, round(ln(coalesce(m.n, 0) + 1) - ln(coalesce(w.n, 0) + 1), 6) AS score FROM v
LEFT JOIN c m ON m.l = v.l AND m.r = v.r AND m.x = v.mt LEFT JOIN c w ON w.l = v.l AND w.r = v.r AND w.x = v.wt WHERE wt BETWEEN 'a' AND 'z'""")
def zero_shot_masked_marginals(spark, d):
    """One variant of each part name, scored with a model counted from ``documents`` by masking each place."""
    return _zero_shot(spark, d, True)


@query(f"""WITH {_COUNTS}
SELECT v.p_partkey, wt || pos || mt AS variant, round(ln(coalesce(m.n, 0) + 1) - ln(coalesce(w.n, 0) + 1), 6) AS score FROM v
LEFT JOIN c m ON m.l = v.l AND m.r = v.r AND m.x = v.mt LEFT JOIN c w ON w.l = v.l AND w.r = v.r AND w.x = v.wt WHERE wt BETWEEN 'a' AND 'z'""")
def zero_shot_wild_type_marginals(spark, d):
    """The same from one pass of each name without masks, which a model that looks at neighbours only can't tell apart."""
    return _zero_shot(spark, d, False)


def _zero_shot(spark, d, masked: bool):
    from .plans import zeroshot

    model = zeroshot.neighbour_model(zeroshot.neighbour_counts(read(spark, d, "documents")))
    names = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("seq"))
    at = (1 + F.col("p_partkey") % F.length("seq")).cast("int")
    wt = F.substring("seq", at, F.lit(1))
    assays = names.select("p_partkey", F.concat(wt, at, F.chr(97 + F.col("p_partkey") % 26)).alias("variant")).where(wt.between("a", "z"))
    found = (zeroshot.masked_log_probs if masked else zeroshot.log_probs)(names, model, "p_partkey", "seq", at=zeroshot.places(assays, "p_partkey"))
    return zeroshot.marginal_scores(assays, found, model, "p_partkey").select("p_partkey", "variant", r6(F.col("score")).alias("score"))


_PADDED = """g AS (SELECT p_partkey, substr(' ' || p_name || ' ', i, 1) AS l, substr(p_name, i, 1) AS x, substr(' ' || p_name || ' ', i + 2, 1) AS r FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
z AS (SELECT l, r, sum(n) + 27 AS total FROM c GROUP BY ALL)"""


@query(f"""WITH {_COUNTS}, {_PADDED}
SELECT p_partkey, count(*) AS n, round(exp(-sum(ln((coalesce(c.n, 0) + 1) / coalesce(total, 27))) / count(*)), 6) AS pseudo_perplexity
FROM g LEFT JOIN c ON c.l = g.l AND c.x = g.x AND c.r = g.r LEFT JOIN z ON z.l = g.l AND z.r = g.r GROUP BY p_partkey""")
def zero_shot_pseudo_perplexity(spark, d):
    """The pseudo-perplexity of each part name under that model."""
    from .plans import zeroshot

    model = zeroshot.neighbour_model(zeroshot.neighbour_counts(read(spark, d, "documents")))
    found = zeroshot.pseudo_perplexities(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("seq")), model, "p_partkey")
    return found.select("p_partkey", "n", r6(F.col("pseudo_perplexity")).alias("pseudo_perplexity"))
