"""Leave-one-out evaluation: a sample is judged by its class's templates without itself.

The weights of a template are the mean of its n whitened samples by their largest, f. Without
m of its samples, whose whitened sum is s, they are (n f w - s) / ((n - m) f): a change of
rank one, which travels with the sample. f and the bias stay, so scores remain on one
scale. Where a template has no other samples it stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import evaluate
from tessera.operators.keyed import mapped, mean_of
from tessera.operators.score import dot
from tessera.operators.small import SLICE_BYTES
from tessera.operators.tables import beside, held


def without(array: Column, left_out: Column, n: Column, m: Column, f: Column) -> Column:
    """Weights of a template of n samples without m of them, whose whitened sum is left_out; the same weights if there are no others."""
    changed = F.zip_with(array, left_out, lambda w, s: (w * n * f - s) / ((n - m) * f))
    return F.when(n > m, changed).otherwise(array)


def changed_models(models: DataFrame, samples: DataFrame, image: str) -> DataFrame:
    """image, class, component and weights of the templates that lose samples of an image, as engine.candidates takes them.

    models has class, component, n, weights and f; samples image, class, component and white.
    All samples of an image that belong to a template are left out together.
    """
    on = ["class", "component"]
    sums = samples.groupBy(image, *on).agg(mean_of("white").alias("_mean"), F.count(F.lit(1)).alias("m")).withColumn("_sum", F.transform("_mean", lambda x: x * F.col("m")))
    joined = beside(sums, held(models.select(*on, "n", "weights", "f")), on, 64 + 8 * F.size("weights"))
    return joined.where("n > m").select(image, *on, without(F.col("weights"), F.col("_sum"), F.col("n"), F.col("m"), F.col("f")).alias("weights"))


#: From a sample's score by the whole template, its product with its own whitened self, and the template's n and f, the score by the template that it is judged by.
LeftOut = Callable[[Column, Column, Column, Column], Column]


def one_left_out(whole: Column, own: Column, n: Column, f: Column) -> Column:
    """The score without the sample; the whole template's if it has no others."""
    return F.when(n > 1, (whole * n * f - own) / ((n - 1) * f)).otherwise(whole)


def none_left_out(whole: Column, own: Column, n: Column, f: Column) -> Column:
    return whole


def own_scores(samples: DataFrame, models: DataFrame, key: str, cls: str, array: str, white: str, left_out: LeftOut = one_left_out) -> DataFrame:
    """key, class and score of each sample against the template of its class without it, or as left_out says. samples has key, class, array and white; models class, n, weights and f.

    Only products of the sample with the weights and with itself are needed.
    """
    joined = beside(samples.select(key, cls, array, white), held(models.select(cls, "n", "weights", "f")), [cls], 64 + 8 * F.size("weights"))
    return joined.select(key, cls, left_out(dot(F.col(array), F.col("weights")), dot(F.col(array), F.col(white)), F.col("n"), F.col("f")).alias("score"))


def other_scores(samples: DataFrame, models: DataFrame, key: str, cls: str, array: str, least: float, limit: int = SLICE_BYTES) -> DataFrame:
    """key, class and score of samples against the templates of all other classes, of at least `least`.

    Templates go along in slices of about `limit` bytes, one pass over the samples each; what
    scores less never leaves the task.
    """
    told = models.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("size")).first()
    number = max(1, -(-told["n"] * 8 * (told["size"] or 0) // limit))
    kind = samples.schema[cls].dataType
    schema = T.StructType([samples.schema[key], T.StructField(cls, kind), T.StructField("score", T.DoubleType())])
    out = None
    for i in range(number):
        rows = models.where(F.pmod(F.xxhash64(cls), F.lit(number)) == i).select(cls, "weights").collect()
        names, weights = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        sent = samples.sparkSession.sparkContext.broadcast((names, weights))

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, weights = sent.value
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                scores = np.stack(pdf[array].to_numpy()).astype(float) @ weights.T
                own = {c: k for k, c in enumerate(names)}
                at = np.array([own.get(c, -1) for c in pdf[cls]])
                mine = np.flatnonzero(at >= 0)
                scores[mine, at[mine]] = -np.inf
                row, col = np.nonzero(scores >= least)
                yield pd.DataFrame({key: pdf[key].to_numpy()[row], cls: pd.Series([names[c] for c in col], dtype=pdf[cls].dtype), "score": scores[row, col]})

        part = samples.select(key, cls, array).mapInPandas(score, schema)
        out = part if out is None else out.unionByName(part)
    return out


def best_thresholds(samples: DataFrame, models: DataFrame, key: str, cls: str, array: str, solve: Callable[[np.ndarray], np.ndarray], mean: np.ndarray, least: float = 0.0, granularity: int = 100, b: float = 1.0, left_out: LeftOut = one_left_out) -> DataFrame:
    """class, threshold and f_measure of the template of each class, all at once: samples of a class are its positives, each scored without itself, those of others its negatives.

    Scores below `least` are no detections. A class no sample of which scores enough has no row.
    """
    white = held(mapped(samples.where(F.col(cls).isNotNull() & F.col(array).isNotNull()).select(key, cls, array), array, "_white", lambda x: solve(x - mean)))
    own = own_scores(white, models, key, cls, array, "_white", left_out).where(F.col("score") >= least).select(cls, "score", F.lit(True).alias("hit"))
    others = other_scores(white, models, key, cls, array, least).select(cls, "score", F.lit(False).alias("hit"))
    positives = white.groupBy(cls).agg(F.count(F.lit(1)).alias("np"))
    return evaluate.max_f_measure(evaluate.sweep(own.unionByName(others), positives, granularity, (cls,)), b, (cls,))
