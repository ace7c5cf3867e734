"""Evaluation of detectors against annotated objects.

Rules: a detection is a hit if it overlaps (IoU) its best object enough, and no higher
detection claims that object; all other detections are false. Thresholds are those that
occur among the scores on a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import iou
from tessera.operators.detect import TILE, touching


def claims(detections: DataFrame, truth: DataFrame, image: str, key: str, overlap: float = 0.5, tile: int = TILE, levels: int = 0) -> DataFrame:
    """key of each detection that claims an object, and the object's: its best by IoU, which no higher detection claims.

    Boxes meet by image and tile (detect.touching, whose levels help where sizes differ much); boxes without common area never match.
    """
    cols = ["x", "y", "w", "h"]
    d = detections.select(image, F.col(key).alias("d_key"), "score", *(F.col(c).alias(f"a_{c}") for c in cols))
    t = truth.select(image, F.col(key).alias("t_key"), *(F.col(c).alias(f"b_{c}") for c in cols))
    pairs = touching(d, t, [image], tile, levels).withColumn("iou", F.round(iou("a_", "b_"), 9)).where(F.col("iou") >= overlap)
    best = pairs.groupBy("d_key", "score").agg(F.max(F.struct("iou", (-F.col("t_key")).alias("neg")))["neg"].alias("neg"))
    first = W.partitionBy("neg").orderBy(F.desc("score"), "d_key")
    return best.withColumn("claim", F.row_number().over(first)).where("claim = 1").select(F.col("d_key").alias(key), (-F.col("neg")).alias("object"))


def match(detections: DataFrame, truth: DataFrame, image: str, key: str, overlap: float = 0.5, tile: int = TILE) -> DataFrame:
    """key, score and hit of each detection; those that claim no object are false."""
    hits = claims(detections, truth, image, key, overlap, tile).select(key, F.lit(True).alias("hit"))
    return detections.select(key, "score").join(hits, key, "left").select(key, "score", F.coalesce("hit", F.lit(False)).alias("hit"))


def evaluate_classes(detections: DataFrame, truth: DataFrame, image: str, cls: str, key: str, overlap: float = 0.5, granularity: int = 100, tile: int = TILE) -> DataFrame:
    """class, threshold, tp, fp and np of all classes at once: detections meet objects of their image and class only, and each class has a sweep and a number of objects of its own.

    A detection in an image without objects of its class is false. Classes without detections have no rows.
    """
    place = F.struct(F.col(image).alias("i"), F.col(cls).alias("c"))
    hits = claims(detections.withColumn("_place", place), truth.withColumn("_place", place), "_place", key, overlap, tile).select(key, F.lit(True).alias("hit"))
    scored = detections.select(key, cls, "score").join(hits, key, "left").select(cls, "score", F.coalesce("hit", F.lit(False)).alias("hit"))
    positives = truth.groupBy(cls).agg(F.count(F.lit(1)).alias("np"))
    return sweep(scored, positives, granularity, (cls,))


def sweep(scored: DataFrame, positives: Column | int | DataFrame, granularity: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """threshold, tp, fp, np for each grid value that occurs among the scores; of each group of `by`, all groups at once.

    Scores are counted by grid value first, so the running sums go over at most as many
    rows of a group as the grid has values. positives are a number, a column, or a table
    of the groups' own numbers (by, np); groups without any there have 0.
    """
    grid = F.floor(F.col("score") * granularity) / F.lit(float(granularity))
    counts = scored.groupBy(*by, grid.alias("threshold")).agg(F.sum(F.col("hit").cast("long")).alias("t"), F.sum((~F.col("hit")).cast("long")).alias("f"))
    down = (W.partitionBy(*by) if by else W).orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    if isinstance(positives, DataFrame):
        counts = counts.join(positives.select(*by, F.col("np").alias("_np")), list(by), "left")
        positives = F.coalesce("_np", F.lit(0))
    return counts.select(*by, "threshold", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"), (F.lit(positives) if isinstance(positives, int) else positives).cast("long").alias("np"))


def precision() -> Column:
    return F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))


def recall() -> Column:
    return F.when(F.col("np") > 0, F.col("tp") / F.col("np"))


def f_measure(b: float = 1.0) -> Column:
    p, r = precision(), recall()
    bottom = F.lit(b * b) * p + r
    return F.when(bottom > 0, F.lit(1 + b * b) * p * r / bottom).when(bottom == 0, F.lit(0.0))


def max_f_measure(results: DataFrame, b: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The best value and the lowest threshold that gives it, of each group of `by`."""
    best = results.select(*by, "threshold", F.round(f_measure(b), 9).alias("f")).groupBy(*by).agg(F.max(F.struct("f", (-F.col("threshold")).alias("neg"))).alias("_best"))
    return best.select(*by, (-F.col("_best.neg")).alias("threshold"), F.col("_best.f").alias("f_measure"))


def f_measure_at(results: DataFrame, threshold: float, b: float = 1.0) -> DataFrame:
    """The value of the first result at or above a threshold."""
    return results.where(F.col("threshold") >= threshold).select("threshold", f_measure(b).alias("f_measure")).orderBy("threshold").limit(1)


def interpolated(results: DataFrame) -> DataFrame:
    """recall and the highest precision at that recall or above."""
    points = results.select(F.round(recall(), 9).alias("recall"), precision().alias("p")).groupBy("recall").agg(F.max("p").alias("p"))
    up = W.orderBy(F.desc("recall")).rowsBetween(W.unboundedPreceding, 0)
    return points.select("recall", F.max("p").over(up).alias("precision"))


def average_precision(results: DataFrame, as_shown: bool = False) -> DataFrame:
    """Area under the interpolated curve. as_shown: each step by the precision at its lower end, as in the graphical front end."""
    curve = interpolated(results)
    w = W.orderBy("recall")
    step = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    height = F.coalesce(F.lag("precision").over(w), F.col("precision")) if as_shown else F.col("precision")
    return curve.select((step * height).alias("a")).agg(F.sum("a").alias("average_precision"))
