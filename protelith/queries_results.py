"""Queries over results, splits, training and reports, with their SQL."""

from pyspark.sql import functions as F

from .functions.hashing import hash_int, hash_role, uniform
from .operators import baselines, leaderboard, metrics, results, splits, targets, uncertainty
from .queries import (DRAWS, EDGES, NODES, REGRESSION, SAMPLES, SCORES, _plain_edges, binary_rows, edges, query, r6, read, regression_rows, samples, scores, sql_hash, sql_role)
from .sources import tables

# --- ids and names -------------------------------------------------------------------------------------------------

IDS = f"ids AS (SELECT conv_id AS seq_id, {sql_hash('conv_id % 50')} AS seq_hash FROM (SELECT DISTINCT conv_id FROM conversations))"


def ids(spark, d):
    return read(spark, d, "conversations").select(F.col("conv_id").alias("seq_id")).distinct().withColumn("seq_hash", hash_int(F.col("seq_id") % 50))


@query(f"WITH {IDS} SELECT i.seq_id, i.seq_hash, p.n FROM ids i JOIN (SELECT seq_hash, count(*) AS n FROM ids GROUP BY 1) p USING (seq_hash)")
def predictions_by_input_id(spark, d):
    i = ids(spark, d)
    return results.by_input_id(i.groupBy("seq_hash").agg(F.count("*").alias("n")), i).select("seq_id", "seq_hash", "n")


@query(f"WITH {IDS} SELECT seq_hash::VARCHAR AS seq_hash, coalesce((SELECT min(x.seq_id)::VARCHAR FROM ids x WHERE x.seq_hash = i.seq_hash AND x.seq_id % 2 = 0), seq_hash::VARCHAR) AS seq_id FROM (SELECT DISTINCT seq_hash FROM ids) i")
def hashes_back_to_ids(spark, d):
    """Hashes without an id stand for themselves."""
    i = ids(spark, d).select(F.col("seq_hash").cast("string").alias("seq_hash"), "seq_id")
    known = i.where("seq_id % 2 = 0").groupBy("seq_hash").agg(F.min("seq_id").cast("string").alias("seq_id"))
    return targets.back_to_ids(i.select("seq_hash").distinct(), known).select("seq_hash", "seq_id")


@query("SELECT vec_id, label, label AS pred FROM embeddings")
def class_labels_back(spark, d):
    """Labels to indexes and back."""
    e = read(spark, d, "embeddings").select("vec_id", "label")
    classes = targets.class_index(e)
    indexed = e.join(F.broadcast(classes), "label").withColumnRenamed("index", "pred")
    return results.labels_of(indexed, classes).select("vec_id", "label", "pred")


@query("""SELECT p_partkey, 'bench-' || p_brand || CASE WHEN p_size % 2 = 0 THEN '-' || p_type ELSE '' END AS name, 'bench' AS framework, p_brand AS dataset,
CASE WHEN p_size % 2 = 0 THEN p_type END AS split FROM part""")
def task_names(spark, d):
    p = read(spark, d, "part")
    named = p.select("p_partkey", results.task_name(F.lit("bench"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("name"))
    return named.withColumn("t", results.task_parts(F.col("name"))).select("p_partkey", "name", "t.framework", "t.dataset", "t.split")


@query("""SELECT p_partkey, p_brand || chr(10) || '(' || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '' ELSE p_type || ' - ' END || 'scc)' AS label,
sha1(p_brand || '_' || p_type || '_' || p_size || '_' || p_partkey) AS uid FROM part""")
def task_labels(spark, d):
    test_set = F.when(F.col("p_size") % 3 == 1, "test").when(F.col("p_size") % 3 == 2, F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", leaderboard.task_label(F.col("p_brand"), test_set, F.lit("scc")).alias("label"),
                                         leaderboard.report_uid(F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.col("p_partkey")).alias("uid"))


@query("SELECT p_brand AS dataset, count(*) AS n, CASE WHEN right(p_brand, 1) = '1' THEN 'sequence_to_class' END AS protocol FROM part GROUP BY p_brand")
def task_configuration(spark, d):
    tasks = read(spark, d, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count("*").alias("n"))
    bank = tasks.where(F.col("dataset").endswith("1")).select("dataset", F.lit("sequence_to_class").alias("protocol"))
    return results.with_configuration(tasks, bank).select("dataset", "n", "protocol")


@query("SELECT 'k_fold-strat-rep-' || (c_custkey % 5 + 1) || '-' || (c_custkey % 3 + 1) AS name, 'k_fold-outer-hp-2-nested-' || (c_custkey % 5 + 1) AS nested, count(*) AS n FROM customer GROUP BY ALL")
def split_names(spark, d):
    fold, repeat = F.col("c_custkey") % 5, F.col("c_custkey") % 3
    return read(spark, d, "customer").groupBy(splits.split_name(fold, True, repeat).alias("name"), splits.split_name(fold, outer=True, hp=2, nested=True).alias("nested")).agg(F.count("*").alias("n"))


# --- losses, curves, sizes -----------------------------------------------------------------------------------------

@query("SELECT event_type, user_id AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY ALL")
def mean_loss_per_epoch(spark, d):
    e = read(spark, d, "events").select("event_type", F.col("user_id").alias("epoch"), F.col("value").alias("loss"))
    return results.mean_loss(e, ["event_type"]).select("event_type", "epoch", r6(F.col("loss")).alias("loss"))


@query("SELECT event_type, (user_id % 20)::INTEGER AS epoch, round(max(value), 6) AS loss FROM events GROUP BY ALL")
def curves_from_maps(spark, d):
    """Losses kept under epochs as text come back as rows in order."""
    e = read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 20).cast("string").alias("k")).agg(r6(F.max("value")).alias("v"))
    maps = e.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("losses"))
    return results.curve(maps, ["event_type"], "losses").select("event_type", "epoch", "loss")


@query("SELECT coalesce(source, 'total') AS set_name, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY GROUPING SETS ((source), ())")
def test_set_sizes(spark, d):
    r = read(spark, d, "documents").select(F.when(F.col("lang") == "en", "train").otherwise("test").alias("role"), F.col("source").alias("set_name"))
    return results.set_sizes(r)


@query("SELECT 'a' AS model, label, NULL::BIGINT AS n FROM embeddings UNION ALL SELECT 'b', label, count(*) FROM embeddings GROUP BY label")
def stacked_frames(spark, d):
    e = read(spark, d, "embeddings")
    return results.stacked([e.select(F.lit("a").alias("model"), "label"), e.groupBy("label").agg(F.count("*").alias("n")).withColumn("model", F.lit("b"))]).select("model", "label", "n")


@query("SELECT entry, metric, mean, least(abs(lo), abs(hi)) AS lower, greatest(abs(lo), abs(hi)) AS upper FROM (SELECT n_name AS entry, 'scc' AS metric, round(abs(n_nationkey / 12 - 1), 6) AS mean, round(n_nationkey / 12 - 1.25, 6) AS lo, round(n_nationkey / 12 - 0.75, 6) AS hi FROM nation)")
def absolute_metric(spark, d):
    n = read(spark, d, "nation").select(F.col("n_name").alias("entry"), F.lit("scc").alias("metric"), (F.col("n_nationkey") / 12 - 1).alias("m"))
    mean, lower, upper = leaderboard.absolute_interval(F.col("m"), F.round(F.col("m") - 0.25, 6), F.round(F.col("m") + 0.25, 6))
    return n.select("entry", "metric", r6(mean).alias("mean"), lower.alias("lower"), upper.alias("upper"))


@query("SELECT event_type, round(avg(value) - 1.959963984540054 * stddev_samp(value), 6) AS lower, round(avg(value) + 1.959963984540054 * stddev_samp(value), 6) AS upper FROM events GROUP BY 1")
def gaussian_intervals(spark, d):
    e = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    lower, upper = uncertainty.gaussian_interval(F.col("m"), F.col("s"))
    return e.select("event_type", r6(lower).alias("lower"), r6(upper).alias("upper"))


@query(f"WITH {SCORES}, k AS (SELECT * FROM sc WHERE length(entry) + length(category) <> 15) SELECT e.entry, c.category FROM (SELECT DISTINCT entry FROM k) e, (SELECT DISTINCT category FROM k) c WHERE (e.entry, c.category) NOT IN (SELECT entry, category FROM k)")
def missing_categories(spark, d):
    return leaderboard.missing_categories(scores(spark, d).where(F.length("entry") + F.length("category") != 15))


# --- taxa, subsets -------------------------------------------------------------------------------------------------

ASSAYS = """a AS (SELECT n_name AS assay, c_acctbal AS score FROM customer JOIN nation ON n_nationkey = c_nationkey), r AS (SELECT n_name AS assay, CASE WHEN n_regionkey = 1 THEN 'Virus' WHEN n_regionkey = 2 THEN 'virus' ELSE 'Human' END AS taxon FROM nation)"""


def assays(spark, d):
    n = read(spark, d, "nation")
    a = read(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("assay"), F.col("c_acctbal").alias("score"))
    taxon = F.when(F.col("n_regionkey") == 1, "Virus").when(F.col("n_regionkey") == 2, "virus").otherwise("Human")
    return a, n.select(F.col("n_name").alias("assay"), taxon.alias("taxon"))


@query(f"""WITH {ASSAYS} SELECT CASE WHEN grouping(g) = 1 THEN 'total' ELSE g END AS grp, count(*) AS n, round(avg(score), 4) AS mean
FROM (SELECT CASE WHEN lower(taxon) = 'virus' THEN 'virus' ELSE 'nonvirus' END AS g, score FROM a JOIN r USING (assay)) GROUP BY GROUPING SETS ((g), ())""")
def assays_by_taxon(spark, d):
    a, r = assays(spark, d)
    return results.by_taxon_group(results.with_taxon(a, r), "score").select("grp", "n", r6(F.col("mean"), 4).alias("mean"))


@query(f"""WITH {ASSAYS}, x AS (SELECT DISTINCT assay FROM a WHERE assay NOT LIKE '%7'), y AS (SELECT assay FROM r WHERE assay NOT LIKE '%3')
SELECT assay, 'no taxon' AS side FROM x WHERE assay NOT IN (SELECT assay FROM y) UNION ALL SELECT assay, 'no assay' FROM y WHERE assay NOT IN (SELECT assay FROM x)""")
def assays_unmatched(spark, d):
    a, r = assays(spark, d)
    return results.unmatched(a.where(~F.col("assay").endswith("7")), r.where(~F.col("assay").endswith("3")))


@query("SELECT text AS seq, lang AS target, CASE source WHEN 'src0' THEN 'train' WHEN 'src1' THEN 'val' WHEN 'src2' THEN 'test' ELSE 'test-extra' END AS set FROM documents")
def subsets_as_records(spark, d):
    docs = read(spark, d, "documents")
    own = {"Train_1": "src0", "validation": "src1", "TEST": "src2"}
    parts = {name: docs.where(F.col("source") == s) for name, s in own.items()} | {"extra": docs.where(~F.coalesce(F.col("source").isin(*own.values()), F.lit(False)))}
    return tables.union_subsets(parts, "text", "lang").select("seq", "target", "set")


# --- interactions --------------------------------------------------------------------------------------------------

@query(f"WITH {EDGES}, n AS (SELECT vec_id FROM embeddings), p AS (SELECT DISTINCT a, b FROM e) SELECT count(*) AS edges, count(*) FILTER (a IN (SELECT vec_id FROM n) AND b IN (SELECT vec_id FROM n)) AS complete FROM p")
def interactions_with_both_ends(spark, d):
    e = targets.canonical_edges(edges(spark, d), "l_partkey", "l_suppkey")
    known = read(spark, d, "embeddings").select("vec_id")
    both = targets.with_partner(targets.with_partner(e, known.withColumnRenamed("vec_id", "a"), "a"), known.withColumnRenamed("vec_id", "b"), "b")
    return e.agg(F.count("*").alias("edges")).join(both.agg(F.count("*").alias("complete")))


@query(f"WITH {NODES}, b AS (SELECT coalesce(covar_pop(pos, neg) / nullif(stddev_pop(pos) * stddev_pop(neg), 0), 0) AS r, count(*) AS n FROM deg) SELECT round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t, n AS n_nodes FROM b")
def bias_t_statistic(spark, d):
    """What the p of the bias is computed from; the p itself is tested apart."""
    r, _, n = baselines.bias_test(baselines.degrees(_plain_edges(spark, d)))
    return spark.createDataFrame([(round(r * ((n - 2) / (1 - r * r)) ** 0.5, 4), n)], "t double, n_nodes long")


# --- baselines with intervals --------------------------------------------------------------------------------------

@query(f"""WITH {SAMPLES}, t AS (SELECT vec_id, label, role FROM s), ends AS (SELECT min(label) AS a, max(label) AS b FROM t WHERE role = 'train')
SELECT vec_id, round(a + {sql_hash("'42'", 'vec_id')} / 4294967296.0 * (b - a), 6) AS pred FROM t, ends WHERE role = 'test'""")
def baseline_uniform(spark, d):
    s = samples(spark, d).select("vec_id", "label", "role")
    return baselines.uniform_between(s.where("role = 'train'"), s.where("role = 'test'"), "vec_id").select("vec_id", r6(F.col("pred")).alias("pred"))


@query(f"WITH {SAMPLES} SELECT vec_id, {sql_hash(repr('42m'), 'vec_id')} / 4294967296.0 >= 0.5 AS said_b FROM s WHERE role = 'test'")
def baseline_random_model(spark, d):
    s = samples(spark, d).where("role = 'test'").select("vec_id")
    return baselines.random_model(s, "vec_id", ["a", "b"]).select("vec_id", (F.col("pred") == "b").alias("said_b"))


@query(f"""WITH e AS (SELECT event_type, event_id, value AS label, {sql_role('event_id')} AS role FROM events), m AS (SELECT event_type, avg(label) AS pred FROM e WHERE role = 'train' GROUP BY 1),
ix AS (SELECT event_type, label, pred, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_ix FROM e JOIN m USING (event_type) WHERE role = 'test') {DRAWS % 'event_type,'},
a AS (SELECT event_type, iteration, avg((label - pred) * (label - pred)) AS mse FROM draws JOIN ix USING (event_type, row_ix) GROUP BY ALL)
SELECT event_type, round(avg(mse), 6) AS mean, round(quantile_cont(mse, 0.025), 6) AS lower, round(quantile_cont(mse, 0.975), 6) AS upper FROM a GROUP BY event_type""")
def baseline_mean_interval(spark, d):
    e = read(spark, d, "events").select("event_type", "event_id", F.col("value").alias("label"), hash_role(F.col("event_id")).alias("role"))
    p = baselines.mean_of_train(e.where("role = 'train'"), e.where("role = 'test'"), ["event_type"])
    drawn = uncertainty.resampled(splits._numbered(p, ["event_id"], ["event_type"]).withColumnRenamed("ordinal", "row_ix"), ["event_type"])
    per = metrics.regression(drawn, ["event_type", "iteration"])
    return uncertainty.interval(per, ["event_type"], "mse").select("event_type", *[r6(F.col(c)).alias(c) for c in ("mean", "lower", "upper")])


# --- suites and training -------------------------------------------------------------------------------------------

@query(f"""WITH {REGRESSION}, m AS (SELECT event_type, avg((pred - label) * (pred - label)) AS mse FROM g GROUP BY 1)
SELECT event_type, 'mse' AS metric, round(mse, 6) AS value FROM m UNION ALL SELECT event_type, 'rmse', round(sqrt(mse), 6) FROM m""")
def suite_of_protocol(spark, d):
    """The error metrics of the suite of residue_to_value; its correlation has a query of its own."""
    found = metrics.evaluated(regression_rows(spark, d), "residue_to_value", ["event_type"], "event_id")
    return found.where(F.col("metric") != "spearman").select("event_type", "metric", r6(F.col("value")).alias("value"))


FOLDS = f"""i AS (SELECT vec_id, label::VARCHAR AS label, embedding, ntile(4) OVER (ORDER BY vec_id) AS fold FROM (SELECT * FROM s WHERE role <> 'test')),
x AS (SELECT vec_id, label, fold, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM i), f AS (SELECT unnest(range(1, 5)) AS val),
c AS (SELECT val, label AS class, dim, avg(v) AS m FROM x, f WHERE fold <> val GROUP BY ALL),
dist AS (SELECT val, vec_id, label, class, round(sum((v - m) * (v - m)), 9) AS dd FROM x JOIN f ON fold = val JOIN c USING (val, dim) GROUP BY ALL),
p AS (SELECT val, vec_id, any_value(label) AS label, arg_min(class, (dd, class)) AS pred FROM dist GROUP BY ALL),
acc AS (SELECT 'k_fold-' || val AS split_name, avg((label = pred)::INTEGER) AS value FROM p GROUP BY val)"""


def trained_folds(spark, d):
    """Nearest centroids, cross-validated in four folds."""
    from .plans import config, training

    s = samples(spark, d).select(F.col("vec_id").alias("seq_hash"), "role", F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))
    options = {"protocol": "sequence_to_class", "input_data": True, "model_choice": "Centroid", "cross_validation_config": {"method": "k_fold", "k": 4, "choose_by": "accuracy"}}
    return training.train(config.verified(options), s)


@query(f"WITH {SAMPLES}, {FOLDS} SELECT split_name, round(value, 6) AS value FROM acc")
def training_splits(spark, d):
    return trained_folds(spark, d).metrics.where("metric = 'accuracy'").select("split_name", r6(F.col("value")).alias("value"))


@query(f"WITH {SAMPLES}, {FOLDS} SELECT 'accuracy' AS metric, round(avg(value), 6) AS value, count(*) AS n_splits FROM acc")
def training_average(spark, d):
    return trained_folds(spark, d).average.where("metric = 'accuracy'").select("metric", r6(F.col("value")).alias("value"), "n_splits")


@query(f"WITH {SAMPLES}, {FOLDS} SELECT split_name, round(value, 6) AS value FROM acc ORDER BY value DESC, split_name LIMIT 1")
def training_best_split(spark, d):
    return results.best_of(trained_folds(spark, d).metrics, "accuracy").select("split_name", r6(F.col("value")).alias("value"))


@query(f"WITH {SAMPLES} SELECT vec_id FROM s WHERE role = 'train' ORDER BY {sql_hash(repr('42'), 'vec_id')}, vec_id LIMIT 30")
def limited_training_sample(spark, d):
    return splits.random_rows(samples(spark, d).where("role = 'train'"), 30, "vec_id").select("vec_id")


@query("""SELECT 'leave_' || a.r_regionkey || '_' || b.r_regionkey || '_' || c.r_regionkey || '_' || e.r_regionkey AS split_name, a.r_regionkey AS id_1, b.r_regionkey AS id_2, c.r_regionkey AS id_3, e.r_regionkey AS id_4
FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey JOIN region c ON b.r_regionkey < c.r_regionkey JOIN region e ON c.r_regionkey < e.r_regionkey""")
def leave_four_out(spark, d):
    return splits.leave_p_out(read(spark, d, "region"), 4, "r_regionkey").select("split_name", "id_1", "id_2", "id_3", "id_4")
