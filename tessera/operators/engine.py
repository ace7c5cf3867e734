"""Detection from feature pyramids, and learning of templates and background statistics.

Levels of pyramids are rows; a task scores the levels of an Arrow batch against all
templates. Templates go to all tasks, so their size is checked; more of them are scored
in slices, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import detect as boxes_of
from tessera.operators import toeplitz
from tessera.operators.score import envelope
from tessera.sources.models import Background, Component, Model, Part

#: Bytes of templates that are sent to all tasks at once.
SLICE_BYTES = 64 << 20


def correlation(cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of products at every place of a level; what lies beyond the level is 0."""
    rows, cols, channels = cells.shape
    out = np.zeros((rows, cols))
    for dy in range(min(weights.shape[0], rows)):
        for dx in range(min(weights.shape[1], cols)):
            out[: rows - dy, : cols - dx] += cells[dy:, dx:, : weights.shape[2]] @ weights[dy, dx, :channels].astype(float)
    return out


def spread_2d(scores: np.ndarray, deformation: tuple[float, float, float, float]) -> np.ndarray:
    """Best score around each place less the cost of the way: a x^2 + b x + c y^2 + d y, with a, c < 0; both zero: no way at all."""
    a, b, c, d = deformation
    out = scores
    if a < 0:
        at = np.arange(float(out.shape[1]))
        out = np.stack([envelope(row, at, at, a, b) for row in out])
    if c < 0:
        at = np.arange(float(out.shape[0]))
        out = np.stack([envelope(col, at, at, c, d) for col in out.T], 1)
    return out


def component_scores(levels: dict[int, np.ndarray], component: Component, interval: int) -> dict[int, np.ndarray]:
    """Of each level that has a level one octave finer, if the component has parts; without parts, of all."""
    out = {}
    for k, cells in levels.items():
        score = correlation(cells, component.parts[0].weights) + component.bias
        if len(component.parts) > 1:
            fine = levels.get(k - interval)
            if fine is None:
                continue
            for part in component.parts[1:]:
                best = spread_2d(correlation(fine, part.weights), part.deformation)
                y, x = 2 * np.arange(score.shape[0]) + part.offset[1], 2 * np.arange(score.shape[1]) + part.offset[0]
                inside = np.outer((y >= 0) & (y < best.shape[0]), (x >= 0) & (x < best.shape[1]))
                score = np.where(inside, score + best[np.clip(y, 0, best.shape[0] - 1)][:, np.clip(x, 0, best.shape[1] - 1)], -np.inf)
        out[k] = score
    return out


def _peaks(score: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    padded = np.pad(score, 1, constant_values=-np.inf)
    near = np.max([padded[1 + dy : 1 + dy + score.shape[0], 1 + dx : 1 + dx + score.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
    return np.nonzero((score > threshold) & (score > near))


def slices(models: dict[str, Model], limit: int = SLICE_BYTES) -> Iterator[dict[str, Model]]:
    now: dict[str, Model] = {}
    size = 0
    for name in sorted(models):
        now[name] = models[name]
        size += sum(p.weights.nbytes for c in models[name].components for p in c.parts)
        if size >= limit:
            yield now
            now, size = {}, 0
    if now:
        yield now


def _changed(models: dict[str, Model], changes) -> dict[str, Model]:
    """The models with the root filters that an image has of its own."""
    if changes is None or not len(changes):
        return models
    out = dict(models)
    for c in changes:
        if c["class"] in out:
            model = out[c["class"]]
            components = list(model.components)
            root, *parts = components[c["component"]].parts
            weights = np.asarray(c["weights"], np.float32).reshape(root.weights.shape)
            components[c["component"]] = Component([Part(weights, root.offset, root.deformation), *parts], components[c["component"]].bias)
            out[c["class"]] = Model(components, model.extractor, model.parameters)
    return out


def candidates(pyramids: DataFrame, key: str, models: dict[str, Model], thresholds: dict[str, float], interval: int = 10, changes: DataFrame | None = None) -> DataFrame:
    """key, class, component, score, level, scale, x, y, w, h in cells: local maxima above the class's threshold.

    Levels of an image meet only if a model has parts; then an image's pyramid is one group.
    changes has key, class, component and weights of root filters that stand in for those
    of the models in that image alone (held_out.changed_models); they travel with its levels.
    """
    kind = pyramids.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, class string, component int, score double, level int, scale double, x int, y int, w int, h int"

    def of(one: dict[str, Model], name, levels: dict[int, np.ndarray], scales: dict[int, float]) -> list[tuple]:
        rows = []
        for cls, model in one.items():
            scored = [component_scores(levels, c, interval) for c in model.components]
            for k in levels:
                here = [(i, s[k]) for i, s in enumerate(scored) if k in s]
                if not here:
                    continue
                stack = np.stack([s for _, s in here])
                best = stack.argmax(0)  # ties: the lowest
                top = stack.max(0)
                for y, x in zip(*_peaks(top, thresholds.get(cls, 0.0)), strict=True):
                    i = here[best[y, x]][0]
                    h, w = model.components[i].parts[0].weights.shape[:2]
                    rows.append((name, cls, i, float(top[y, x]), k, scales[k], int(x), int(y), w, h))
        return rows

    columns = [c.split(" ")[0] for c in schema.split(", ")]
    out = None
    for one in slices(models):
        sent = pyramids.sparkSession.sparkContext.broadcast(one)

        def single(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    cells = np.asarray(r[6], float).reshape(r[3], r[4], r[5])
                    rows += of(_changed(sent.value, r[7]), r[0], {r[1]: cells}, {r[1]: r[2]})
                yield pd.DataFrame(rows, columns=columns)

        def grouped(pdf: pd.DataFrame, sent=sent) -> pd.DataFrame:
            levels = {r[1]: np.asarray(r[6], float).reshape(r[3], r[4], r[5]) for r in pdf.itertuples(index=False)}
            return pd.DataFrame(of(_changed(sent.value, pdf["changes"].iloc[0]), pdf.iloc[0, 0], levels, dict(zip(pdf["level"], pdf["scale"], strict=True))), columns=columns)

        needed = pyramids.select(key, "level", "scale", "rows", "cols", "channels", "data")
        if changes is None:
            needed = needed.withColumn("changes", F.lit(None).cast("array<struct<class:string,component:int,weights:array<double>>>"))
        else:
            own = changes.groupBy(key).agg(F.collect_list(F.struct(F.col("class").cast("string").alias("class"), F.col("component").cast("int").alias("component"), F.col("weights").cast("array<double>").alias("weights"))).alias("changes"))
            needed = needed.join(own, key, "left")
        parts = any(len(c.parts) > 1 for m in one.values() for c in m.components)
        found = needed.groupBy(key).applyInPandas(grouped, schema) if parts else needed.mapInPandas(single, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else pyramids.sparkSession.createDataFrame([], schema)


def detect(pyramids: DataFrame, images: DataFrame, key: str, models: dict[str, Model], thresholds: dict[str, float], interval: int = 10, overlap: float = 0.5, cell: int = 8, border: int = 0, changes: DataFrame | None = None) -> DataFrame:
    """key, class, component, score, level, x, y, w, h in pixels: after projection, cutting and suppression. images has key, width and height; changes as for candidates()."""
    found = candidates(pyramids, key, models, thresholds, interval, changes).join(images.select(key, "width", "height"), key)
    left, top = ((F.col(c) / F.col("scale") + 0.5).cast("int") * cell + border for c in ("x", "y"))
    w, h = ((F.col(c) / F.col("scale") + 0.5).cast("int") * cell for c in ("w", "h"))
    placed = found.select(key, "class", "component", "score", "level", F.greatest(F.lit(0), left).alias("x"), F.greatest(F.lit(0), top).alias("y"), (F.least("width", left + w) - F.greatest(F.lit(0), left)).alias("w"), (F.least("height", top + h) - F.greatest(F.lit(0), top)).alias("h"))
    placed = placed.where("w > 0 AND h > 0").withColumn("n", F.struct("level", "y", "x", "component"))  # the order of equal scores
    return boxes_of.suppress(placed, [key, "class"], "n", overlap).drop("n")


def learn_background(pyramids: DataFrame, cell: tuple[int, int] = (8, 8), most: int = 19) -> Background:
    """Mean and autocorrelation of cells over all levels: two passes, of each only sums leave the tasks. Without any level: no channels."""
    one = pyramids.select("channels").first()
    channels = one["channels"] if one else 0

    offsets = [(dx, dy) for dx in range(most + 1) for dy in range(-most, most + 1) if dx or dy >= 0]

    def level(r) -> np.ndarray:
        return np.asarray(r.data, float).reshape(r.rows, r.cols, r.channels)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(channels), 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                total += level(r).sum((0, 1))
                n += r.rows * r.cols
        yield pd.DataFrame({"i": np.arange(channels), "s": total, "n": n})

    if not channels:
        return Background(cell, np.empty(0), np.empty((len(offsets), 0, 0)), np.array(offsets))
    needed = pyramids.select("rows", "cols", "channels", "data")
    told = needed.mapInPandas(sums, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("i").collect()
    mean = np.array([r["m"] or 0.0 for r in told])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(offsets), channels, channels)), np.zeros(len(offsets), np.int64)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = level(r) - mean
                for o, (dx, dy) in enumerate(offsets):
                    if abs(dy) < r.rows and dx < r.cols:
                        a = x[max(0, -dy) : r.rows - max(0, dy), : r.cols - dx].reshape(-1, channels)
                        b = x[max(0, dy) : r.rows - max(0, -dy), dx:].reshape(-1, channels)
                        total[o] += a.T @ b
                        n[o] += len(a)
        yield pd.DataFrame({"o": np.arange(len(offsets)), "s": [t.ravel() for t in total], "n": n})

    part = needed.mapInPandas(products, "o int, s array<double>, n long")
    summed = part.groupBy("o").agg(F.array(*(F.sum(F.col("s")[k]) for k in range(channels * channels))).alias("s"), F.sum("n").alias("n")) if channels <= 8 else part.select("o", "n", F.posexplode("s").alias("k", "v")).groupBy("o", "k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).groupBy("o").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("s"), F.max("n").alias("n"))
    cov = np.zeros((len(offsets), channels, channels))
    for r in summed.collect():
        if r["n"]:
            cov[r["o"]] = np.array(r["s"]).reshape(channels, channels) / r["n"]
    return Background(cell, mean, cov, np.array(offsets))


def learn_background_cyclic(pyramids: DataFrame, cell: tuple[int, int] = (8, 8), most: int = 19) -> Background:
    """Mean and autocorrelation of cells over all levels, each of which wraps around, by Fourier transforms.

    Levels of one size are transformed together, the spectra of each pair of channels are
    summed over them, and transformed back once. An offset counts a level's cells if it
    reaches no further than half of the level; an offset that no level counts has zeros.
    Of the two passes only sums leave the tasks.
    """
    offsets = np.array([(dx, dy) for dx in range(most + 1) for dy in range(-most, most + 1) if dx or dy >= 0])
    needed = pyramids.select("rows", "cols", "channels", "data").where("rows * cols > 0")
    moments = needed.select("channels", F.posexplode("data").alias("i", "v")).groupBy((F.col("i") % F.col("channels")).alias("c")).agg(F.avg(F.col("v").cast("double")).alias("m")).orderBy("c").collect()
    mean = np.array([r["m"] for r in moments])
    channels = len(mean)

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(offsets), channels, channels)), np.zeros(len(offsets), np.int64)
        for batch in batches:
            rows, cols = (batch.column(c).to_numpy() for c in (0, 1))
            data = batch.column(3)
            values, at = data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy()
            shapes, of = np.unique(np.stack([rows, cols], 1), axis=0, return_inverse=True)
            for k, (r, c) in enumerate(shapes.tolist()):
                here = np.flatnonzero(of.ravel() == k)
                x = np.stack([values[at[i] : at[i + 1]] for i in here]).reshape(-1, r, c, channels) - mean
                spectra = np.fft.rfft2(x, axes=(1, 2))
                fits = np.flatnonzero((r // 2 + offsets[:, 1] >= 0) & (r // 2 + offsets[:, 1] < r) & (c // 2 + offsets[:, 0] < c))
                n[fits] += r * c * len(here)
                for p in range(channels):
                    crossed = np.einsum("kyx,kyxq->yxq", spectra[..., p].conj(), spectra)
                    wrapped = np.fft.irfft2(crossed, (r, c), axes=(0, 1))
                    total[fits, p] += wrapped[offsets[fits, 1] % r, offsets[fits, 0] % c]
        o, k = np.divmod(np.arange(total.size), channels * channels)
        yield pa.record_batch([pa.array(o), pa.array(k), pa.array(total.ravel()), pa.array(n[o])], ["o", "k", "s", "n"])

    cov = np.zeros((len(offsets), channels * channels))
    if channels:
        for row in needed.mapInArrow(correlate, "o long, k long, s double, n long").groupBy("o", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").collect():
            cov[row["o"], row["k"]] = row["s"] / row["n"]
    return Background(cell, mean, cov.reshape(len(offsets), channels, channels), offsets)


def covariances(spark, background: Background) -> DataFrame:
    """The background's covariances as rows: dx, dy, i, j, cov."""
    n = len(background.mean)
    rows = [(int(dx), int(dy), i, j, float(c[i, j])) for (dx, dy), c in zip(background.offsets, background.cov, strict=True) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "dx long, dy long, i int, j int, cov double")


def whitened(levels: DataFrame, key: str, background: Background, least: float = 0.01, ridge: float = 0.01, unit: bool = True) -> DataFrame:
    """key, rows, cols, channels and white: whole levels less the background's mean, their covariance solved; unit: by the largest entry.

    The covariance has `least` more on its diagonal, and `ridge` more again until it is
    positive definite. Nothing of a level's square is made (toeplitz); only the
    background's blocks by offset are sent.
    """
    sent = levels.sparkSession.sparkContext.broadcast(toeplitz.Solvers(background, ridge, least))

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            white: list = [None] * len(pdf)
            for (rows, cols), at in pdf.groupby(["rows", "cols"], sort=False).indices.items():
                x = np.stack(pdf["data"].to_numpy()[at]).astype(float) - np.tile(sent.value.background.mean, rows * cols)
                y = sent.value(rows, cols)(x)
                if unit:
                    y = y / np.maximum(np.abs(y).max(1, keepdims=True), np.finfo(float).tiny)
                for i, row in zip(at, y, strict=True):
                    white[i] = row
            yield pdf.drop(columns="data").assign(white=white)

    kind = levels.schema[key].dataType.simpleString()
    return levels.select(key, "rows", "cols", "channels", "data").where("rows * cols > 0").mapInPandas(whiten, f"{key} {kind}, rows int, cols int, channels int, white array<double>")


def learn(positives: DataFrame, background: Background, rows: int, cols: int) -> tuple[Model, list[float]]:
    """A model with a template per cluster, and the clusters' thresholds: positives has cluster and data (rows x cols x channels).

    Means by cluster are a grouped aggregation; their systems are solved by conjugate
    gradients, so nothing larger than a template reaches the driver.
    """
    n = len(background.mean)
    c = positives.select("cluster", F.posexplode("data").alias("i", "v")).groupBy("cluster", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    told = c.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m")).orderBy("cluster").collect()
    solve, mean = toeplitz.Solver(background, rows, cols), np.tile(background.mean, rows * cols)
    components, thresholds = [], []
    for r in told:
        positive = np.array(r["m"])
        own, none = solve(np.stack([positive, mean]))
        w = own - none
        f = float(np.abs(w).max()) or 1.0
        threshold = float((positive @ own - mean @ none) / 2 / f)
        components.append(Component([Part((w / f).reshape(rows, cols, n).astype(np.float32))], -threshold))
        thresholds.append(threshold)
    return Model(components), thresholds
