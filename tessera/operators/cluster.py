"""Clustering of cells."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.small import SLICE_BYTES, along
from tessera.operators.stats import cells


def assign(df: DataFrame, key: str, array: str, centroids: DataFrame, digits: int = 6, limit: int = SLICE_BYTES) -> DataFrame:
    """Nearest centroid (cluster, center); ties go to the lowest. Centroids go to all tasks in slices of at most about `limit` bytes, so no cell is joined with them."""

    def distance(center):
        return F.aggregate(F.zip_with(F.col(array), center, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)

    nearest = F.array_min(F.transform("packed", lambda c: F.struct(F.round(distance(c["center"]), digits).alias("distance"), c["cluster"].alias("cluster"))))
    told = along(df, centroids, "cluster", "center", nearest, F.least, limit)
    return told.select(key, F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"), array)


def new_centroids(assigned: DataFrame, key: str, array: str) -> DataFrame:
    return cells(assigned, key, array, "cluster").groupBy("cluster", "ch").agg(F.avg("x").alias("center"))


def fit(df: DataFrame, array: str, k: int, seeds: list[int], rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """The best of several seeded runs by squared distance: cluster, center. Clusters are numbered in the order of their centers, whichever run is best.

    A run ends when no centre moves by more than the tolerance, or after so many rounds.
    """
    points = df.select(array_to_vector(F.col(array)).alias("features")).cache()
    best = min((KMeans(k=k, seed=s, maxIter=rounds, tol=tolerance).fit(points) for s in seeds), key=lambda m: m.summary.trainingCost)
    points.unpersist()
    return df.sparkSession.createDataFrame(list(enumerate(sorted([float(x) for x in c] for c in best.clusterCenters()))), "cluster int, center array<double>")


def merge_near(centers: list[float], sizes: list[int], distance: float) -> list[int]:
    """A new number for each centroid: near ones are merged to their weighted mean, chains included."""
    centers, sizes = [np.atleast_1d(np.asarray(c, float)) for c in centers], list(sizes)
    into = list(range(len(centers)))
    again = True
    while again:
        again = False
        alive = [i for i in range(len(centers)) if into[i] == i]
        for n, i in enumerate(alive):
            near = [(float(np.linalg.norm(centers[i] - centers[j])), j) for j in alive[n + 1 :]]
            if near and min(near)[0] < distance:
                j = min(near)[1]
                centers[i] = (centers[i] * sizes[i] + centers[j] * sizes[j]) / (sizes[i] + sizes[j])
                sizes[i] += sizes[j]
                into[j] = i
                again = True
                break

    def root(i: int) -> int:
        return i if into[i] == i else root(into[i])

    numbers = {r: n for n, r in enumerate(sorted({root(i) for i in range(len(into))}))}
    return [numbers[root(i)] for i in range(len(into))]


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """n and small: fewer than floor(total / 10)."""
    counts = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.join(F.broadcast(total)).select(cluster, "n", (F.col("n") < F.floor(F.col("t") / 10)).alias("small"))
