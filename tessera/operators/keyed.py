"""Learning of all classes at once.

A class is a value of a column, of any type, and every step is one plan for all classes:
clustering by Lloyd's rounds, sizes, means and discriminants by (class, cluster). The number
of jobs depends on clusters and rounds, never on classes. What is kept of a class are its
centres: they are a table, and go along with samples if it is measured to be small.
Means are partial sums by (class, cluster), so samples of a large class don't meet.

Samples whose class or array is null are left out; a class of fewer different samples than
clusters has fewer clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import cluster as single
from tessera.operators.tables import beside, held
from tessera.operators.toeplitz import Solvers
from tessera.sources.models import Background

DIGITS = 6


def _distance(one: Column, other: Column, digits: int) -> Column:
    """The squared distance of two arrays, rounded, so that ties are told alike everywhere."""
    return F.round(F.aggregate(F.zip_with(one, other, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x), digits)


def nearest(df: DataFrame, centers: DataFrame, cls: str, array: str, digits: int = DIGITS) -> DataFrame:
    """df with cluster and distance: the nearest of the class's centers (class, cluster, center); ties go to the lowest. Classes without centers are left out."""
    packed = held(centers.groupBy(cls).agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("_packed")))
    told = beside(df, packed, [cls], 64 + F.aggregate("_packed", F.lit(0), lambda n, c: n + 8 * F.size(c["center"])))
    best = F.array_min(F.transform("_packed", lambda c: F.struct(_distance(F.col(array), c["center"], digits).alias("distance"), c["cluster"].alias("cluster"))))
    return told.withColumn("_best", best).select(*(F.col(f"`{c}`") for c in df.columns), F.col("_best.cluster").alias("cluster"), F.col("_best.distance").alias("distance"))


def far_centers(df: DataFrame, cls: str, key: str, array: str, k: int, digits: int = DIGITS) -> DataFrame:
    """class, cluster, center: of each class the sample of the least key, then one after another the sample farthest from those before; ties go to the least key."""
    doubles = F.transform(array, lambda x: x.cast("double"))
    centers = held(df.groupBy(cls).agg(F.min_by(doubles, key).alias("center")).select(cls, F.lit(0).alias("cluster"), "center"))
    for number in range(1, k):
        far = nearest(df, centers, cls, array, digits).where("distance > 0").groupBy(cls).agg(F.min_by(doubles, F.struct(-F.col("distance"), key)).alias("center"))
        centers = held(centers.union(far.select(cls, F.lit(number).alias("cluster"), "center")))
    return centers


def mean_of(array: str) -> Column:
    """The mean array of a group, as a partial aggregate."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.transform(array, lambda x: x.cast("double")))))


def kmeans(df: DataFrame, cls: str, key: str, array: str, k: int, rounds: int = 30, tolerance: float | None = 1e-6, digits: int = DIGITS) -> DataFrame:
    """class, cluster, center of up to k clusters a class, after so many rounds, or when no center of any class moves more than the tolerance.

    Without a tolerance all rounds are done. A center without samples stays where it is.
    """
    df = df.where(F.col(cls).isNotNull() & F.col(array).isNotNull()).select(cls, key, array)
    centers = far_centers(df, cls, key, array, k, digits)
    for _ in range(rounds):
        means = nearest(df, centers, cls, array, digits).groupBy(cls, "cluster").agg(mean_of(array).alias("_mean"))
        both = held(centers.join(means, [cls, "cluster"], "left").select(cls, "cluster", F.col("center").alias("_before"), F.coalesce("_mean", "center").alias("center")))
        centers = both.select(cls, "cluster", "center")
        if tolerance is not None and both.where(_distance(F.col("center"), F.col("_before"), 15) > tolerance * tolerance).isEmpty():
            break
    return centers


def merged(centers: DataFrame, cls: str, distance: float) -> DataFrame:
    """class, cluster and into, a new number of the cluster, of class, cluster, center and n: near centers of a class are one, chains included.

    A group is a class's centers, so its size is the number of clusters.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        return pdf[["_cls", "cluster"]].assign(into=np.array(single.merge_near(list(pdf["center"]), pdf["n"].tolist(), distance), np.int32))

    named = centers.select(F.col(cls).alias("_cls"), "cluster", "center", "n")
    schema = T.StructType([named.schema["_cls"], named.schema["cluster"], T.StructField("into", T.IntegerType())])
    return named.groupBy("_cls").applyInPandas(merge, schema).withColumnRenamed("_cls", cls)


def large_enough(assigned: DataFrame, cls: str, share: int = 10) -> DataFrame:
    """class, cluster, into and n of clusters that have at least floor(samples of the class / share) samples; into numbers them anew, from 0."""
    counts = assigned.groupBy(cls, "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(cls))
    kept = counts.withColumn("_total", total).where(F.col("n") >= F.floor(F.col("_total") / share))
    return kept.select(cls, "cluster", (F.row_number().over(W.partitionBy(cls).orderBy("cluster")) - 1).alias("into"), "n")


def mapped(df: DataFrame, array: str, name: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with a column `name`: `of` applied to the arrays, a batch of rows as a matrix at a time."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: list(of(np.stack(pdf[array].to_numpy()).astype(float))) if len(pdf) else []})

    return df.mapInPandas(apply, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def learn_classes(df: DataFrame, cls: str, key: str, array: str, mean: np.ndarray, solve: Callable[[np.ndarray], np.ndarray], k: int = 3, rounds: int = 30, tolerance: float | None = 1e-6, strategy: Strategy | None = None) -> DataFrame:
    """class, cluster, n, weights, threshold and f of the templates of all classes.

    `solve` gives the background's covariance solved for each row of a matrix, `mean` is
    the background's. Samples less the mean, solved, are clustered by class; clusters of
    fewer than a tenth of their class go with their samples; each other one is a template:
    its centre by its largest weight f, and a threshold from both bias terms. Another
    strategy makes other templates of a cluster's mean.
    """
    samples = df.where(F.col(cls).isNotNull() & F.col(array).isNotNull()).select(cls, key, array)
    white = held(mapped(samples, array, "_white", lambda x: solve(x - mean)))
    assigned = held(nearest(white, kmeans(white, cls, key, "_white", k, rounds, tolerance), cls, "_white"))
    kept = held(large_enough(assigned, cls))
    means = beside(assigned.select(cls, "cluster", array), kept, [cls, "cluster"], F.lit(64)).groupBy(cls, F.col("into").alias("cluster")).agg(F.max("n").alias("n"), mean_of(array).alias("_mean"))
    return discriminants(means, "_mean", mean, solve, strategy).drop("_mean")


#: Makes templates of the means of clusters (rows), given the background's mean and its solver: weights, and a threshold of each before weights are divided by their largest.
Strategy = Callable[[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]], tuple[np.ndarray, np.ndarray]]


def by_discriminant(x: np.ndarray, mean: np.ndarray, solve: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Linear discriminants against the background, of equal prior."""
    none = solve(mean[None, :])[0]
    own = solve(x) if len(x) else x
    return own - none, (np.einsum("ij,ij->i", x, own) - mean @ none) / 2


def by_mean(x: np.ndarray, mean: np.ndarray, solve: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Plain differences of means, which take all cells for independent: the threshold is half way between both."""
    return x - mean, (np.einsum("ij,ij->i", x, x) - mean @ mean) / 2


def discriminants(means: DataFrame, array: str, mean: np.ndarray, solve: Callable[[np.ndarray], np.ndarray], strategy: Strategy | None = None) -> DataFrame:
    """means with weights, threshold and f: the discriminants of the arrays against the background, a batch of rows at a time."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _learned(pdf, array, mean, solve, strategy)

    return means.mapInPandas(learn, T.StructType([*means.schema.fields, *_LEARNED]))


def sized_discriminants(means: DataFrame, array: str, background: Background, ridge: float = 0.01, strategy: Strategy | None = None) -> DataFrame:
    """The same of arrays of several sizes, their columns rows and cols: the system of each size is made where it is met (toeplitz)."""
    sent = means.sparkSession.sparkContext.broadcast(Solvers(background, ridge))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (rows, cols), own in pdf.groupby(["rows", "cols"], sort=False):
                yield _learned(own, array, np.tile(sent.value.background.mean, rows * cols), sent.value(rows, cols), strategy)

    return means.mapInPandas(learn, T.StructType([*means.schema.fields, *_LEARNED]))


def sized_whitened(samples: DataFrame, array: str, name: str, background: Background, ridge: float = 0.01) -> DataFrame:
    """samples with a column `name`: arrays less the background's mean, solved for its covariance at their size, rows x cols."""
    sent = samples.sparkSession.sparkContext.broadcast(Solvers(background, ridge))

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (rows, cols), own in pdf.groupby(["rows", "cols"], sort=False):
                x = np.stack(own[array].to_numpy()).astype(float) - np.tile(sent.value.background.mean, rows * cols)
                yield own.assign(**{name: list(sent.value(rows, cols)(x))})

    return samples.mapInPandas(whiten, T.StructType([*samples.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


_LEARNED = [T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("threshold", T.DoubleType()), T.StructField("f", T.DoubleType())]


def _learned(pdf: pd.DataFrame, array: str, mean: np.ndarray, solve: Callable[[np.ndarray], np.ndarray], strategy: Strategy | None) -> pd.DataFrame:
    x = np.stack(pdf[array].to_numpy()).astype(float) if len(pdf) else np.empty((0, len(mean)))
    w, threshold = (strategy or by_discriminant)(x, mean, solve)
    f = np.abs(w).max(1) if len(w) else np.empty(0)
    f[f == 0] = 1.0
    return pdf.assign(weights=list(w / f[:, None]), threshold=threshold / f, f=f)
