"""Clusters and a map of embeddings as a stored model: fitted once, applied to rows that come later without a new fit."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.vectors import clusters_for
from casewright.sources.store import current_version, read_version, write_version

#: New rows from which a model is stale.
STALE = 10


def _wide(vector: str) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def fit_model(emb: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> None:
    """Fit clusters, two main axes and their scale on all rows of emb, and store them as a new version in `folder`.

    k-means and the covariance are sums over partitions; what is stored are a few vectors. Rows with a null vector take
    no part. The axes point where their largest component is positive, so that a map doesn't turn over between fits.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    spark = emb.sparkSession
    rows = emb.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, array_to_vector(_wide(vector)).alias("raw"))
    n, last = rows.agg(F.count(F.lit(1)), F.max(key)).first()
    model = KMeans(k=clusters_for(n), maxIter=150, tol=1e-6, seed=seed, featuresCol="raw").fit(rows)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(rows)
    axes = np.array(PCA(k=2, inputCol="features", outputCol="p").fit(scaler.transform(rows)).pc.toArray()).T
    axes = [a if a[np.abs(a).argmax()] > 0 else -a for a in axes]
    kinds = [("centre", i, c) for i, c in enumerate(model.clusterCenters())] + [("mean", 0, scaler.mean.toArray())] + [("axis", i, a) for i, a in enumerate(axes)]
    parts = spark.createDataFrame([(k, i, [float(x) for x in v]) for k, i, v in kinds], "part string, number int, vector array<double>")
    points = emb.where(F.col(vector).isNotNull()).select(_projected(vector, np.array(scaler.mean), axes[0]).alias("x"), _projected(vector, np.array(scaler.mean), axes[1]).alias("y"))
    lo_x, hi_x, lo_y, hi_y = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    write_version(parts.coalesce(1), folder, {"rows": str(n), "last": str(last), "scale": json.dumps([lo_x, hi_x, lo_y, hi_y])})


def _literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _projected(vector: str, mean, axis) -> Column:
    """The coordinate of a vector on an axis through the mean."""
    return F.aggregate(F.zip_with(_wide(vector), _literal(axis), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) - F.lit(float(np.dot(mean, axis)))


def assign(spark: SparkSession, folder: str, emb: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, x, y) of any rows by the stored model; rows with a null vector are left out.

    Equal distances go to the lower cluster. x and y are scaled by the fitted rows, so later ones can lie outside 0 to 1;
    a constant axis is 0.5. Nothing is fitted or shuffled.
    """
    parts = {(r["part"], r["number"]): np.array(r["vector"]) for r in read_version(spark, folder).collect()}
    lo_x, hi_x, lo_y, hi_y = json.loads(current_version(spark, folder)["about"]["scale"])
    mean = parts["mean", 0]
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(_wide(vector), _literal(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    centres = [v for (part, _), v in sorted(parts.items()) if part == "centre"]
    near = F.array_min(F.array(*(F.struct(gap(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres))))
    scaled = lambda value, lo, hi: F.when(F.lit(hi) > F.lit(lo), (value - lo) / (hi - lo) if hi > lo else F.lit(0.5)).otherwise(0.5)
    x, y = (scaled(_projected(vector, mean, parts["axis", i]), lo, hi) for i, (lo, hi) in enumerate(((lo_x, hi_x), (lo_y, hi_y))))
    placed = emb.where(F.col(vector).isNotNull()).select(key, near.alias("near"), x.alias("x"), y.alias("y"))
    return placed.select(key, F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance"), "x", "y")


def is_stale(spark: SparkSession, folder: str, emb: DataFrame, key: str = "vec_id", most: int = STALE) -> bool:
    """Whether there is no model, or `most` rows or more came after its last one."""
    known = current_version(spark, folder)
    return known is None or emb.where(F.col(key) > int(known["about"]["last"])).limit(most).count() >= most


def refreshed(spark: SparkSession, folder: str, emb: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The assignment of all rows, after a new fit if the stored model is stale."""
    if is_stale(spark, folder, emb, key):
        fit_model(emb, folder, key, vector)
    return assign(spark, folder, emb, key, vector)
