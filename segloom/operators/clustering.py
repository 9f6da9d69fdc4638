"""Weighted k-means on mark patterns."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .binarize import bits_of

RESTARTS, SEED = 10, 42


def kmeans_patterns(patterns: DataFrame, n_marks: int, k: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """code, n, label of the best of ``restarts`` weighted k-means runs over distinct patterns (code, n). k is at most the number of
    patterns; k of 0 or less, or no patterns, gives an empty result. Labels are 0, 1, ... by falling bins, then by least code."""
    vec = patterns.select("code", "n", array_to_vector(F.transform(bits_of(F.col("code"), n_marks), lambda x: x.cast("double"))).alias("features")).cache()
    count = vec.count()
    empty = patterns.select("code", "n", F.lit(0).alias("label")).where("false")
    if k <= 0 or not count:
        vec.unpersist()
        return empty
    runs = (KMeans(k=min(k, count), seed=seed + i, weightCol="n", maxIter=100).fit(vec) for i in range(restarts)) if min(k, count) > 1 else ()
    best = min(runs, key=lambda m: m.summary.trainingCost, default=None)
    rows = (best.transform(vec) if best else vec.withColumn("prediction", F.lit(0))).select("code", "n", "prediction")
    order = rows.groupBy("prediction").agg(F.sum("n").alias("bins"), F.min("code").alias("first"))
    named = order.withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bins"), "first")) - 1)
    return rows.join(F.broadcast(named.select("prediction", "label")), "prediction").select("code", "n", "label")


def label_bins(coded: DataFrame, labels: DataFrame) -> DataFrame:
    """Bins (.., code) with state E1, E2, ...; patterns are few beside bins, and the join broadcasts them if they are."""
    return coded.join(labels.select("code", "label"), "code").withColumn("state", F.concat(F.lit("E"), (F.col("label") + 1).cast("string"))).drop("label", "code")


def quality_sweep(patterns: DataFrame, n_marks: int, ks: list[int], restarts: int = RESTARTS, seed: int = SEED) -> list[dict]:
    """Per k: inertia over the total sum of squares, silhouette (squared Euclidean), entropy of the labels in bits, states in use. Stops
    at the first k above the number of patterns."""
    vec = patterns.select("code", "n", array_to_vector(F.transform(bits_of(F.col("code"), n_marks), lambda x: x.cast("double"))).alias("features"))
    count, out = patterns.count(), []
    bit = [F.sum(F.col("n") * F.get(bits_of(F.col("code"), n_marks), F.lit(j))) for j in range(n_marks)]
    whole, *ones = patterns.agg(F.sum("n"), *bit).first()
    one = sum(x - x * x / whole for x in ones) if whole else 0.0  # bits are their own squares
    for k in ks:
        if k < 2:
            raise ValueError("k of 2 or more")
        if k > count:
            break
        models = [KMeans(k=k, seed=seed + i, weightCol="n", maxIter=100).fit(vec) for i in range(restarts)]
        model = min(models, key=lambda m: m.summary.trainingCost)
        rows = model.transform(vec)
        sizes = [r.n for r in rows.groupBy("prediction").agg(F.sum("n").alias("n")).collect()]
        total = sum(sizes)
        silhouette = ClusteringEvaluator(weightCol="n").evaluate(rows) if len(sizes) > 1 else None
        out.append({
            "k": k, "inertia": model.summary.trainingCost / one if one else 0.0, "silhouette": silhouette,
            "entropy": -sum(n / total * math.log2(n / total) for n in sizes), "states": len(sizes),
        })
    return out
