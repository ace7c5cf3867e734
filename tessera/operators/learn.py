"""Training of templates: discriminants from moments, thresholds, leave-one-out."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.score import dot
from tessera.operators.stats import cells


def diagonal_discriminant(df: DataFrame, key: str, array: str, label: str, ridge: float = 0.01) -> DataFrame:
    """Per label and channel: weight (mean of the label less that of all) / (variance + ridge), by the label's largest; threshold and scale f.

    Moments by channel are all that leaves the cells.
    """
    c = cells(df, key, array, label)
    overall = c.groupBy("ch").agg(F.avg("x").alias("m0"), F.var_pop("x").alias("var"))
    own = c.groupBy(label, "ch").agg(F.avg("x").alias("m1"))
    w = own.join(overall, "ch").withColumn("w", (F.col("m1") - F.col("m0")) / (F.col("var") + ridge))
    part = (F.col("m0") * F.col("m0") - F.col("m1") * F.col("m1")) / (F.col("var") + ridge) / 2
    totals = w.groupBy(label).agg(F.max(F.abs("w")).alias("f"), F.sum(part).alias("bias"))
    return w.join(totals, label).select(label, "ch", (F.col("w") / F.col("f")).alias("weight"), "f", (-F.col("bias") / F.col("f")).alias("threshold"))


def moments(df: DataFrame, array: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population covariance by one tree aggregation of outer products; their size is that of a cell, not of the data."""
    row = df.select(F.size(array).alias("n")).first()
    n = row["n"]
    sums = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(array, i).cast("double") * F.get(array, j).cast("double")))
    wide = df.select(array_to_vector(F.transform(array, lambda x: x.cast("double"))).alias("v"), array_to_vector(F.flatten(sums)).alias("p"))
    told = wide.agg(Summarizer.mean(F.col("v")).alias("m"), Summarizer.mean(F.col("p")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    mean = told["m"].toArray()
    return mean, told["s"].toArray().reshape(n, n) - np.outer(mean, mean), told["n"]


def factor(cov: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """The lower Cholesky factor, adding to the diagonal until there is one."""
    cov = (cov + cov.T) / 2
    while True:
        try:
            return np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            cov = cov + ridge * np.eye(len(cov))


def discriminant(positive: np.ndarray, mean: np.ndarray, cov: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, float, float]:
    """Weights, threshold and scale f by Cholesky."""
    lower = factor(cov, ridge)
    both = np.linalg.solve(lower.T, np.linalg.solve(lower, np.stack([positive, mean], 1)))
    w = both[:, 0] - both[:, 1]
    bias = (mean @ both[:, 1] - positive @ both[:, 0]) / 2
    f = float(np.abs(w).max()) or 1.0
    return w / f, float(-bias / f), f


def full_discriminants(df: DataFrame, array: str, label: str, ridge: float = 0.01) -> DataFrame:
    mean, cov, _ = moments(df, array)
    cov = cov + ridge * np.eye(len(cov))
    own = df.groupBy(label).agg(Summarizer.mean(array_to_vector(F.transform(array, lambda x: x.cast("double")))).alias("m")).orderBy(label).collect()
    rows = []
    for r in own:
        w, threshold, f = discriminant(r["m"].toArray(), mean, cov)
        rows.append((r[label], [float(x) for x in w], threshold, f))
    return df.sparkSession.createDataFrame(rows, f"{label} {df.schema[label].dataType.simpleString()}, weights array<double>, threshold double, f double")


def leave_one_out(df: DataFrame, key: str, array: str, label: str) -> DataFrame:
    """Score of each cell against the mean of its label without itself; labels of one cell give none."""
    sums = cells(df, key, array, label).groupBy(label, "ch").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    packed = sums.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "s"))), lambda p: p["s"]).alias("sums"), F.max("n").alias("n"))
    joined = df.join(packed, label).where("n > 1")
    own = F.col(array)
    return joined.select(key, label, ((dot(own, F.col("sums")) - dot(own, own)) / (F.col("n") - 1)).alias("score"))


def project_pca(df: DataFrame, key: str, array: str, k: int) -> DataFrame:
    """Centred cells on the leading components; each component's largest entry is made positive."""
    vectors = df.select(key, array_to_vector(F.transform(array, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    axes = model.pc.toArray()
    signs = [float(np.sign(axes[np.abs(axes[:, i]).argmax(), i]) or 1) for i in range(k)]
    shift = [float(x) for x in df.agg(Summarizer.mean(array_to_vector(F.transform(array, lambda x: x.cast("double")))).alias("m")).first()["m"].toArray() @ axes]
    p = vector_to_array("p")
    return model.transform(vectors).select(key, F.array(*((p[i] - shift[i]) * signs[i] for i in range(k))).alias("projected"))
