"""Scaling, pooling, projection and nearest centroids of embedding vectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, square_distance

METHODS = ("standard", "minmax", "none")


def fit_scaler(train: DataFrame, method: str = "standard", vector: str = "embedding") -> DataFrame:
    """dim, shift and scale of each dimension; a zero spread scales by 1."""
    if method not in METHODS:
        raise ValueError(method)
    long = train.select(F.posexplode(doubles(F.col(vector))).alias("dim", "x"))
    shift, spread = (F.avg("x"), F.stddev_pop("x")) if method == "standard" else (F.min("x"), F.max("x") - F.min("x"))
    fitted = long.groupBy("dim").agg(shift.alias("shift"), spread.alias("spread"))
    if method == "none":
        fitted = fitted.withColumns({"shift": F.lit(0.0), "spread": F.lit(1.0)})
    return fitted.select("dim", "shift", F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread")).alias("scale"))


def scale(rows: DataFrame, scaler: DataFrame, vector: str = "embedding", out: str = "scaled") -> DataFrame:
    """The fitted scaler, a row per dimension, becomes one broadcast row of arrays."""
    one = scaler.agg(F.array_sort(F.collect_list(F.struct("dim", "shift", "scale"))).alias("_s"))
    return (rows.join(F.broadcast(one))
            .withColumn(out, F.zip_with(doubles(F.col(vector)), F.col("_s"), lambda x, s: (x - s["shift"]) / s["scale"])).drop("_s"))


def scale_sequences(rows: DataFrame, scaler: DataFrame, vector: str = "embedding", out: str = "scaled") -> DataFrame:
    """The same for arrays of vectors."""
    one = scaler.agg(F.array_sort(F.collect_list(F.struct("dim", "shift", "scale"))).alias("_s"))
    scaled = F.transform(F.col(vector).cast("array<array<double>>"), lambda v: F.zip_with(v, F.col("_s"), lambda x, s: (x - s["shift"]) / s["scale"]))
    return rows.join(F.broadcast(one)).withColumn(out, scaled).drop("_s")


def mean_by(rows: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The mean vector of each group, summed before the shuffle."""
    long = rows.select(*keys, F.posexplode(doubles(F.col(vector))).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("x"))
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias(out))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, vector: str = "scaled", out: str = "prediction") -> DataFrame:
    """The label of the nearest of ``centroids`` (label, centroid), which are few; ties go to the smaller label."""
    one = centroids.agg(F.collect_list(F.struct("label", "centroid")).alias("_c"))
    near = F.array_min(F.transform("_c", lambda c: F.struct(F.round(square_distance(F.col(vector), c["centroid"]), 9).alias("d"), c["label"].alias("label"))))
    return rows.join(F.broadcast(one)).withColumn(out, near["label"]).drop("_c")


def fit_pca(train: DataFrame, n: int, vector: str = "embedding") -> DataFrame:
    """component, weights, mean and explained: the projection on the first ``n`` principal components, centred by the training mean."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    width = train.select(F.size(vector).alias("w")).first()["w"]
    centre = fit_scaler(train, "standard", vector).withColumn("scale", F.lit(1.0))
    model = PCA(k=min(n, width), inputCol="_v", outputCol="_p").fit(scale(train, centre, vector, "_centred").withColumn("_v", array_to_vector("_centred")))
    mean = [float(r["shift"]) for r in centre.orderBy("dim").collect()]
    rows = [(i, w.tolist(), mean, float(e)) for i, (w, e) in enumerate(zip(model.pc.toArray().T, model.explainedVariance.toArray()))]
    return train.sparkSession.createDataFrame(rows, "component int, weights array<double>, mean array<double>, explained double")


def project(rows: DataFrame, projection: DataFrame, vector: str = "embedding", out: str = "projected") -> DataFrame:
    """``rows`` with their vectors on the components of a projection."""
    one = projection.agg(F.array_sort(F.collect_list(F.struct("component", "weights", "mean"))).alias("_c"))
    on = lambda c: F.aggregate(F.zip_with(F.zip_with(doubles(F.col(vector)), c["mean"], lambda x, m: x - m), c["weights"], lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return rows.join(F.broadcast(one)).withColumn(out, F.transform("_c", on)).drop("_c")


def pca(train: DataFrame, rows: DataFrame, n: int, vector: str = "embedding"):
    """(rows with ``projected``, explained variance); the vectors are centred by the training mean first."""
    projection = fit_pca(train, n, vector)
    return project(rows, projection, vector), [r["explained"] for r in projection.orderBy("component").collect()]


def append_values(embeddings: DataFrame, values: DataFrame, key: str, vector: str = "embedding", extra: str = "values") -> DataFrame:
    """Embeddings with further values of the same key appended."""
    return embeddings.join(values.select(key, F.col(extra).alias("_x")), key).withColumn(vector, F.concat(doubles(F.col(vector)), doubles(F.col("_x")))).drop("_x")
