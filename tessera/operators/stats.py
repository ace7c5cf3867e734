"""Statistics of feature cells: moments, covariance, spatial autocorrelation, size selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile of a grid.
TILE = 64


def cells(df: DataFrame, key: str, array: str, *others: str) -> DataFrame:
    """A row per channel: key, others, ch, x."""
    return df.select(key, *others, F.posexplode(array).alias("ch", "x")).withColumn("x", F.col("x").cast("double"))


def channel_mean(c: DataFrame) -> DataFrame:
    return c.groupBy("ch").agg(F.avg("x").alias("mean"))


def channel_absmax(c: DataFrame) -> DataFrame:
    return c.groupBy("ch").agg(F.max(F.abs("x")).alias("absmax"))


def channel_cov(df: DataFrame, array: str) -> DataFrame:
    """Population covariance of all pairs of channels, i <= j, each over the cells that have both.

    Only sums leave a task, a row a pair; they are taken around the channels' means.
    """
    told = df.select(F.posexplode(array).alias("ch", "x")).groupBy("ch").agg(F.avg(F.col("x").cast("double")).alias("mean")).orderBy("ch").collect()
    mean = np.nan_to_num(np.array([r["mean"] or 0.0 for r in told], float))
    k = len(mean)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, left, both = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(size)), size)
            ch = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            x, has = np.zeros((len(size), k)), np.zeros((len(size), k))
            x[row, ch] = np.where(known, flat.fill_null(0.0).to_numpy(zero_copy_only=False) - mean[ch], 0.0)
            has[row, ch] = known
            n += has.T @ has
            left += x.T @ has
            both += x.T @ x
        i, j = np.triu_indices(k)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j]), pa.array(left[i, j]), pa.array(left[j, i]), pa.array(both[i, j])], ["i", "j", "n", "a", "b", "ab"])

    parts = df.select(F.col(array).cast("array<double>").alias("x")).mapInArrow(sums, "i int, j int, n double, a double, b double, ab double")
    total = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "ab")))
    return total.select("i", "j", F.when(F.col("n") > 0, F.col("ab") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")).alias("cov"))


def offsets(spark, m: int) -> DataFrame:
    """Half plane of offsets: dx from 0, dy from -m; of dx = 0 only dy >= 0."""
    return spark.range(m + 1).select(F.col("id").alias("dx"), F.explode(F.sequence(F.lit(-m).cast("long"), F.lit(m).cast("long"))).alias("dy")).where("dx > 0 OR dy >= 0")


def autocorrelation(grid: DataFrame, m: int, mean: float, size: tuple[int, int] | None = None) -> DataFrame:
    """Mean product of centred values at each offset; columns y, x, v.

    size: rows and columns of a grid that wraps around, in which missing cells are 0
    before centring; without it, only pairs of cells that exist count. The grid is cut
    into tiles; a cell goes to its own and, as a neighbour, to all that are within
    reach, so a group is a tile with its margin, and only sums by offset leave it.
    """
    cell = grid.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.col("v") - F.lit(mean)).cast("double").alias("v"))
    own, near = cell, cell
    if size:  # a neighbour has an image at each turn that is within reach
        rows, columns = size
        own = cell.withColumn("y", F.pmod("y", F.lit(rows))).withColumn("x", F.pmod("x", F.lit(columns)))
        near = cell.where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns))
        near = near.withColumn("y", F.explode(F.transform(F.sequence(F.lit(-(m // rows) - 1), F.lit(m // rows + 1)), lambda k: F.col("y") + k * rows))).where((F.col("y") >= -m) & (F.col("y") < rows + m))
        near = near.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m // columns + 1)), lambda k: F.col("x") + k * columns))).where(F.col("x") < columns + m)

    def tile(c):
        return F.floor(c / F.lit(float(TILE)))

    own = own.select("y", "x", "v", tile(F.col("y")).alias("ty"), tile(F.col("x")).alias("tx"), F.lit(True).alias("own"))
    near = near.withColumn("ty", F.explode(F.sequence(tile(F.col("y") - m), tile(F.col("y") + m)))).withColumn("tx", F.explode(F.sequence(tile(F.col("x") - m), tile(F.col("x"))))).select("y", "x", "v", "ty", "tx", F.lit(False).alias("own"))

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[(pdf.y >= key[0] * TILE - m) & (pdf.y < (key[0] + 1) * TILE + m) & (pdf.x < (key[1] + 1) * TILE + m)]
        mine, other = pdf[pdf.own], pdf[~pdf.own]
        v, u = np.zeros((2, TILE, TILE)), np.zeros((2, TILE + 2 * m, TILE + m))
        for to, of, edge in ((v, mine, 0), (u, other, m)):
            at = (of.y.to_numpy() - key[0] * TILE + edge, of.x.to_numpy() - key[1] * TILE)
            np.add.at(to[0], at, of.v.to_numpy())
            np.add.at(to[1], at, 1.0)
        out = []
        for dx in range(m + 1):
            for dy in range(-m, m + 1):
                if dx or dy >= 0:
                    part = u[:, m + dy : m + dy + TILE, dx : dx + TILE]
                    if n := int((v[1] * part[1]).sum()):
                        out.append((dx, dy, float((v[0] * part[0]).sum()), n))
        return pd.DataFrame(out, columns=["dx", "dy", "s", "n"])

    pairs = own.unionByName(near).groupBy("ty", "tx").applyInPandas(products, "dx long, dy long, s double, n long")
    total = F.sum("s")
    return pairs.groupBy("dx", "dy").agg((total / F.lit(float(size[0] * size[1])) if size else total / F.sum("n")).alias("cov"), F.sum("n").alias("n"))


def reconstructed(cov: DataFrame, rows: int, cols: int, channels: int) -> DataFrame:
    """p, q, i, j, cov: the covariance of a template's cells p and q (line by line) in channels i and j, from dx, dy, i, j, cov by offset.

    An offset and its opposite have transposed blocks. Channels that cov lacks have zeros;
    an offset that it lacks is an error. Covariances by offset are fewer than the template's
    entries, which are what is made here; to solve such a system without them see toeplitz.
    """
    spark, n = cov.sparkSession, rows * cols
    cell = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pairs = spark.range(n).select(F.col("id").alias("p"), cell.alias("q")).select("p", "q", (F.col("q") % cols - F.col("p") % cols).alias("dx"), (F.floor(F.col("q") / cols) - F.floor(F.col("p") / cols)).alias("dy"))
    both = cov.select("dx", "dy", "i", "j", "cov").union(cov.where("dx <> 0 OR dy <> 0").select(-F.col("dx"), -F.col("dy"), "j", "i", "cov")).dropDuplicates(["dx", "dy", "i", "j"])
    if pairs.join(both, ["dx", "dy"], "left_anti").limit(1).count():
        raise ValueError("the template is larger than the offsets allow")
    channel = F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))
    every = pairs.withColumn("i", channel).withColumn("j", channel)
    return every.join(both, ["dx", "dy", "i", "j"], "left").select("p", "q", "i", "j", F.coalesce("cov", F.lit(0.0)).alias("cov"))


def samples_by_offset(levels: DataFrame, m: int) -> DataFrame:
    """dx, dy and n: how many pairs of cells the levels (rows, cols) have at each offset of the half plane."""
    shapes = levels.groupBy("rows", "cols").agg(F.count(F.lit(1)).alias("times"))
    offset = F.explode(F.sequence(F.lit(-m).cast("long"), F.lit(m).cast("long")))
    half = shapes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m).cast("long"))).alias("dx")).select("*", offset.alias("dy")).where("dx > 0 OR dy >= 0")
    pairs = F.greatest(F.lit(0), F.col("rows") - F.abs("dy")) * F.greatest(F.lit(0), F.col("cols") - F.col("dx")) * F.col("times")
    return half.groupBy("dx", "dy").agg(F.sum(pairs).cast("long").alias("n"))


def normalized_cells(df: DataFrame, key: str, array: str, label: str) -> DataFrame:
    """Each cell less the mean of its label, by the channel's absolute maximum."""
    c = cells(df, key, array, label)
    means = c.groupBy(label, "ch").agg(F.avg("x").alias("m"))
    tops = channel_absmax(c)
    return c.join(means, [label, "ch"]).join(tops, "ch").select(key, "ch", ((F.col("x") - F.col("m")) / F.col("absmax")).alias("x"))


def aspect_bins(sizes: DataFrame, w: str, h: str) -> DataFrame:
    """How many sizes fall into each of 201 bins of the logarithm of h / w."""
    number = F.round(50 * F.log(F.col(h) / F.col(w)) + 100).cast("int")
    return sizes.where((F.col(w) > 0) & (F.col(h) > 0)).groupBy(F.greatest(F.lit(0), F.least(F.lit(200), number)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def aspect_weights(bins: DataFrame) -> DataFrame:
    """Each bin's count smoothed by a Gaussian over distances from -100 to 99; bin 200 gives nothing."""
    spread = bins.where("bin < 200").select("bin", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - 99), F.least(F.lit(200), F.col("bin") + 100))).alias("center"))
    d = F.col("bin") - F.col("center")
    weights = spread.groupBy("center").agg(F.sum(F.col("n") * F.exp(-(d * d) / 400)).alias("weight"))
    every = bins.sparkSession.range(201).select(F.col("id").cast("int").alias("center"))
    return every.join(weights, "center", "left").select("center", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def common_aspect(bins: DataFrame) -> float:
    """The aspect ratio of the heaviest bin, the first on ties; 201 rows at most are looked at."""
    best = aspect_weights(bins).agg(F.max_by("center", F.struct(F.round("weight", 9), -F.col("center"))).alias("c")).first()["c"]
    return math.exp(0.02 * best - 2)


def aspect_modes(sizes: DataFrame, w: str, h: str, by: list[str]) -> DataFrame:
    """The commonest aspect ratio of each group, as common_aspect gives it; a group is at most 201 bins."""
    number = F.round(50 * F.log(F.col(h) / F.col(w)) + 100).cast("int")
    bins = sizes.where((F.col(w) > 0) & (F.col(h) > 0)).groupBy(*by, F.greatest(F.lit(0), F.least(F.lit(200), number)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = bins.select(*by, "bin", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - 99), F.least(F.lit(200), F.col("bin") + 100))).alias("center"))
    d = F.col("bin") - F.col("center")
    # Bin 200 gives nothing; a group of it alone has the first center, as all weigh 0.
    weight = F.when(F.col("bin") < 200, F.col("n") * F.exp(-(d * d) / 400)).otherwise(F.lit(0.0))
    weights = spread.groupBy(*by, F.when(F.col("bin") < 200, F.col("center")).otherwise(F.lit(0)).alias("center")).agg(F.sum(weight).alias("weight"))
    best = weights.groupBy(*by).agg(F.max_by("center", F.struct(F.round("weight", 9), -F.col("center"))).alias("best"))
    return best.select(*by, F.exp(0.02 * F.col("best") - 2).alias("aspect"))


def area_quantile(sizes: DataFrame, area, by: list[str], share: float = 0.2) -> DataFrame:
    """The element number floor(share * n) of each group's sorted areas, not interpolated.

    Areas are counted first, so a group is as many rows as it has distinct areas.
    """
    from pyspark.sql import Window as W

    counts = sizes.groupBy(*by, area.alias("area")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by).orderBy("area")
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    return ranked.where((F.col("upto") > F.floor(F.col("total") * share)) & (F.col("upto") - F.col("n") <= F.floor(F.col("total") * share))).select(*by, "area")


def model_size(aspect: float, area: float, cell: int = 8, most: int = 20, least: int = 0) -> tuple[int, int]:
    """Width and height of a template in cells from an aspect ratio and an area in pixels.

    With `least`, the rule of extractors other than histograms of gradients: both sides
    have at least so many pixels (2), and areas have no range of their own.
    """
    area = float(int(area))
    if least > 0:
        area = float(int(max(area, least * least * aspect, least * least / aspect)))
    elif (cell, most) == (8, 20):
        area = min(max(area, 5000.0), 7000.0)
    if most > 0:
        over = max(area / (aspect * most * most * cell * cell), area * aspect / (most * most * cell * cell))
        if over > 1:
            area = float(int(area / over))
    width = (area / aspect) ** 0.5
    height = width * aspect
    return max(int(width / cell + 0.5), 1), max(int(height / cell + 0.5), 1)
