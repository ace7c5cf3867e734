"""From scores to detections: local maxima, projection, overlap, suppression, top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import area, intersection, iou, project
from tessera.operators.runs import in_runs
from tessera.operators.tables import held

#: Side of the tiles in which boxes meet, about that of a usual box: a box enters every tile that it touches.
TILE = 64


def local_maxima(grid: DataFrame) -> DataFrame:
    """Cells strictly above their neighbours (those that exist); a plateau has none.

    Each cell sends its value to the eight places around it, so the comparison is one
    grouped maximum and a hash join.
    """
    around = F.array(*(F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx))
    near = grid.select(F.explode(around).alias("o"), "y", "x", "v").groupBy((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.max("v").alias("near"))
    return grid.join(near, ["y", "x"], "left").where("near IS NULL OR v > near").select("y", "x", "v")


def candidates(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("score") > threshold)


def project_boxes(boxes: DataFrame, scale: str, width: int, height: int, cell: int = 8, border: int = 0) -> DataFrame:
    out = boxes
    for name, column in project(F.col(scale), cell, border, F.lit(width), F.lit(height)).items():
        out = out.withColumn(name, column)
    return out.where("pw > 0 AND ph > 0")


def tiles(x: str, y: str, w: str, h: str, tile) -> Column:
    """The tiles that a box touches, as structs ty, tx; none for a box of no area. tile is a number or a column."""

    def along(c: str, size: str) -> Column:
        first = F.floor(F.col(c) / tile)
        return F.sequence(first, F.greatest(first, F.ceil((F.col(c) + F.col(size)) / tile) - 1))

    both = F.flatten(F.transform(along(y, h), lambda ty: F.transform(along(x, w), lambda tx: F.struct(ty.alias("ty"), tx.alias("tx")))))
    return F.when((F.col(w) > 0) & (F.col(h) > 0), both)


def touching(a: DataFrame, b: DataFrame, by: list[str], tile: int, levels: int = 0) -> DataFrame:
    """Pairs of boxes with an area in common, a_x, a_y, a_w, a_h and b_x to b_h, of equal `by`; each pair once.

    Boxes meet by image and tile, not by image alone, and a pair counts in the tile where
    its common area begins. So a crowded image is as many keys as it has tiles. With levels,
    tiles of level k are 4**k as wide: a box enters those of its own size, at most 25, and of
    each level above, and a pair meets on the level of the larger one. Take as many levels
    as boxes need (levels_of) where their sizes differ much.
    """

    def placed(df: DataFrame, s: str) -> DataFrame:
        if not levels:
            return df.withColumn("_level", F.lit(0)).withColumn("_tile", F.explode(tiles(f"{s}_x", f"{s}_y", f"{s}_w", f"{s}_h", tile)))
        every = df.withColumn("_own", _level(f"{s}_w", f"{s}_h", tile, levels)).withColumn("_level", F.explode(F.sequence("_own", F.lit(levels))))
        return every.withColumn("_tile", F.explode(tiles(f"{s}_x", f"{s}_y", f"{s}_w", f"{s}_h", tile * F.pow(F.lit(4.0), F.col("_level"))))).withColumnRenamed("_own", f"_own_{s}")

    pairs = placed(a, "a").join(placed(b, "b"), [*by, "_level", "_tile"])
    side = tile * F.pow(F.lit(4.0), F.col("_level")) if levels else F.lit(tile)
    own = (F.floor(F.greatest("a_x", "b_x") / side) == F.col("_tile.tx")) & (F.floor(F.greatest("a_y", "b_y") / side) == F.col("_tile.ty"))
    if levels:
        own = own & (F.greatest("_own_a", "_own_b") == F.col("_level"))
    return pairs.where(own).drop("_tile", "_level", "_own_a", "_own_b").withColumn("inter", intersection("a_", "b_")).where("inter > 0")


def _level(w: str, h: str, tile: int, levels: int) -> Column:
    """The lowest level whose tiles are no narrower than a quarter of the box."""
    size = F.greatest(w, h).cast("double") / (4 * tile)
    return F.greatest(F.lit(0), F.least(F.lit(levels), F.ceil(F.log(4.0, F.greatest(size, F.lit(1e-9)))).cast("int")))


def levels_of(boxes: DataFrame, tile: int = TILE, most: int = 24) -> int:
    """How many levels the largest of the boxes (w, h) needs."""
    return boxes.agg(F.max(_level("w", "h", tile, most))).first()[0] or 0


def overlaps(boxes: DataFrame, by: list[str], key: str, tile: int = TILE, levels: int = 0) -> DataFrame:
    """Pairs of overlapping boxes of an image: a is the higher one (score, then key). levels as for touching()."""
    cols = [key, "x", "y", "w", "h", "score"]
    a, b = (boxes.select(*by, *(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in "ab")
    higher = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    pairs = touching(a, b, by, tile, levels).where(higher)
    return pairs.select(*by, f"a_{key}", f"b_{key}", "inter", (F.col("inter") / area("b_")).alias("covered"), iou("a_", "b_").alias("iou"))


def suppress_spread(boxes: DataFrame, by: list[str], key: str, overlap: float = 0.5, tile: int = TILE) -> DataFrame:
    """The same as suppress(), for images of so many boxes that one task shouldn't hold them; overlap is above 0 and key unique within `by`.

    Boxes meet by tile. In each round, of the boxes that are left those that no other one
    that is left covers stay, and what they cover goes. A round needs no order within an
    image, and the best box that is left always stays, so rounds are as many as the
    longest chain of boxes that cover each other, whatever the number of images.
    """
    own = [*by, key]
    left = held(boxes)
    levels = levels_of(left, tile)
    lower = [*by, F.col(f"b_{key}").alias(key)]
    # A box of no area is covered wholly by the best one of its image, as in suppress().
    edges = held(overlaps(left, by, key, tile, levels).where(F.col("covered") >= overlap).select(*by, f"a_{key}", f"b_{key}"))
    first = left.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("neg"), key))[key].alias("_best"))
    flat = left.where("NOT (w > 0 AND h > 0)").join(first, by).where(F.col(key) != F.col("_best")).select(*own)
    open_ = held(left.select(*own).join(flat, own, "left_anti"))
    edges = held(edges.join(flat.withColumnRenamed(key, f"a_{key}"), [*by, f"a_{key}"], "left_anti"))
    kept = None
    while not open_.isEmpty():
        stays = held(open_.join(edges.select(*lower).distinct(), own, "left_anti"))
        kept = stays if kept is None else kept.union(stays)
        gone = held(edges.join(stays.withColumnRenamed(key, f"a_{key}"), [*by, f"a_{key}"]).select(*lower).distinct())
        open_ = held(open_.join(stays, own, "left_anti").join(gone, own, "left_anti"))
        done = stays.union(gone)
        edges = held(edges.join(done.withColumnRenamed(key, f"a_{key}"), [*by, f"a_{key}"], "left_anti").join(done.withColumnRenamed(key, f"b_{key}"), [*by, f"b_{key}"], "left_anti"))
    return left.join(kept, own, "left_semi") if kept is not None else left


def suppress(boxes: DataFrame, by: list[str], key: str, overlap: float = 0.5) -> DataFrame:
    """Greedy: the best box stays, and drops lower ones that it covers by at least `overlap` of their own area.

    Suppression is sequential within an image and class, which is the group; boxes of
    different images never meet.
    """
    names = boxes.columns

    def greedy(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        """Round by round every group keeps its best box that is left, and drops what this covers; all groups at once."""
        x, y, w, h = (table.column(c).to_numpy().astype(float) for c in ("x", "y", "w", "h"))
        size = np.clip(w, 0, None) * np.clip(h, 0, None)
        kept = np.zeros(len(x), bool)
        left = np.arange(len(x))
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        while len(left):
            head = np.ones(len(left), bool)
            head[1:] = group[left[1:]] != group[left[:-1]]
            best = left[head][np.cumsum(head) - 1]
            kept[left[head]] = True
            side = np.minimum(x[left] + w[left], x[best] + w[best]) - np.maximum(x[left], x[best])
            tall = np.minimum(y[left] + h[left], y[best] + h[best]) - np.maximum(y[left], y[best])
            shared = np.clip(side, 0, None) * np.clip(tall, 0, None)
            left = left[~head & (size[left] > 0) & (shared < overlap * size[left])]
        return table.select(names).filter(pa.array(kept)).combine_chunks().to_batches(max_chunksize=None)[0] if kept.any() else pa.RecordBatch.from_pylist([], table.select(names).schema)

    return in_runs(boxes, by, [F.desc("score"), key], greedy, boxes.schema)


def top_k(detections: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("score"), key)
    return detections.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def global_best(detections: DataFrame, by: str, key: str) -> DataFrame:
    """The best detection of each class, whatever the thresholds."""
    best = F.max(F.struct("score", (-F.col(key)).alias("neg")))
    return detections.groupBy(by).agg(best.alias("b")).select(by, (-F.col("b.neg")).alias(key), F.col("b.score").alias("score"))
