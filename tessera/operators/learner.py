"""From annotated images to a model, and from images to detections and their evaluation.

Images have height, width, depth and data; boxes have a key of their image, a numeric
box_id, x, y, w and h. Images, crops and features are rows; what the driver holds is of
the size of a template: cluster centres, counts, moments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import cluster, engine, evaluate, harmony, held_out, hog, keyed, stats
from tessera.operators.tables import beside, held
from tessera.sources.models import Background, Component, Model, Part

_IMAGE = "height int, width int, depth int, data binary"
#: Score that a detection needs where no threshold is given for its class.
THRESHOLD = 0.8
#: Boxes that an image is sent along with, and crops of a batch; bytes of a batch of crops, or of packs and their images unless the session says how many.
PACK, BATCH_BYTES = 4096, 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _packed(boxes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key and lists of names: packs of up to PACK boxes of one image, in no order.

    Tasks take ranges of (key, box_id), so an image of many boxes is the work of several,
    none of which holds more than an Arrow batch of them.
    """
    own = boxes.where("w > 0 AND h > 0").where(F.col(key).isNotNull()).select(key, *(F.col(c).cast("long").alias(c) for c in names))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whose, at = batch.column(0), np.arange(batch.num_rows)
                other = np.concatenate([[True], pc.not_equal(whose[1:], whose[:-1]).to_numpy(zero_copy_only=False)])
                first = np.flatnonzero((at - np.maximum.accumulate(np.where(other, at, 0))) % PACK == 0)
                offsets = pa.array(np.append(first, len(at)), pa.int32())
                yield pa.record_batch([whose.take(pa.array(first)), *(pa.ListArray.from_arrays(offsets, c) for c in batch.columns[1:])], batch.schema.names)

    kinds = ", ".join(f"{c} array<long>" for c in names)
    return own.repartitionByRange(key, "box_id").sortWithinPartitions(key).mapInArrow(pack, f"{key} {own.schema[key].dataType.simpleString()}, {kinds}")


def crops(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """key, box_id and the image of each box: height, width, depth, data.

    Boxes that also have to_w and to_h are cut out whole, with reflected edges, and
    resized to that. Otherwise what lies in the image is cut out. Boxes of no area, boxes
    beside the image and images without data give nothing.
    """
    if not images.sparkSession._jsparkSession.sessionState().conf().contains(_SETTING):
        images.sparkSession.conf.set(_SETTING, str(BATCH_BYTES))
    fitted = {"to_w", "to_h"} <= set(boxes.columns)
    names = ["box_id", "x", "y", "w", "h", *(("to_w", "to_h") if fitted else ())]
    # An image goes to its boxes once a pack. The images are on the right: a merge join keeps in memory what it finds there for a key.
    joined = _packed(boxes, key, names).join(images.where("data IS NOT NULL").select(key, "height", "width", "depth", "data"), key)
    joined = joined.withColumn(key, F.col(key).cast(images.schema[key].dataType))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def table(whose: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows, strict=True)
        return pa.record_batch([whose.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [key, "box_id", "height", "width", "depth", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                height, width, depth, data = (c[i].as_py() for c in batch.columns[-4:])
                image = hog.image_of(data, height, width, depth)
                for box_id, x, y, w, h, *to in zip(*(c[i].as_py() for c in batch.columns[1:-4]), strict=True) if image.size else ():
                    part = hog.crop(image, x, y, w, h, padded=fitted)
                    if part.size:
                        part = hog.resize(part, *to) if fitted else part
                        rows.append((i, box_id, *part.shape, part.tobytes()))
                        size += part.nbytes
                        if len(rows) >= PACK or size >= BATCH_BYTES:
                            yield table(batch.column(0), rows)
                            rows, size = [], 0
            if rows:
                yield table(batch.column(0), rows)

    return joined.mapInArrow(cut, f"{key} {joined.schema[key].dataType.simpleString()}, box_id long, {_IMAGE}")


def aspect_clusters(boxes: DataFrame, key: str, k: int, seeds: tuple[int, ...] = (1, 2, 3), distance: float = 0.2) -> DataFrame:
    """key, box_id, x, y, w, h and cluster: boxes of area by aspect ratio, in up to k clusters; centres nearer than distance are one."""
    sample = F.struct(key, "box_id", "x", "y", "w", "h").alias("sample")
    ratios = boxes.where("w > 0 AND h > 0").select(sample, F.array(F.col("h") / F.col("w")).alias("aspect"))
    if k < 2 or ratios.isEmpty():
        return ratios.select("sample.*", F.lit(0).alias("cluster"))
    assigned = cluster.assign(ratios, "sample", "aspect", cluster.fit(ratios, "aspect", k, list(seeds)))
    told = assigned.groupBy("cluster").agg(F.avg(F.col("aspect")[0]).alias("center"), F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()
    merged = cluster.merge_near([[r["center"]] for r in told], [r["n"] for r in told], distance)
    return assigned.select("sample.*", _renumbered([r["cluster"] for r in told], merged))


def _renumbered(old: list[int], new: list[int]):
    return F.create_map(*(F.lit(int(x)) for pair in zip(old, new, strict=True) for x in pair))[F.col("cluster")].alias("cluster")


def template_sizes(clustered: DataFrame, cell: int = 8, most: int = 20) -> dict[int, tuple[int, int]]:
    """Columns and rows of the template of each cluster, from its commonest aspect ratio and the 20th percentile of its areas."""
    boxes = clustered.select("cluster", F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    areas = stats.area_quantile(boxes, F.col("w") * F.col("h"), ["cluster"]).orderBy("cluster").collect()
    return {r["cluster"]: stats.model_size(stats.common_aspect(stats.aspect_bins(boxes.where(F.col("cluster") == r["cluster"]), "w", "h")), r["area"], cell, most) for r in areas}


def whitened(samples: DataFrame, background: Background, rows: int, cols: int) -> DataFrame:
    """Samples with a column white: data (rows x cols x channels) less the background's mean, its covariance solved (toeplitz)."""
    sized = samples.withColumn("rows", F.lit(rows)).withColumn("cols", F.lit(cols))
    return keyed.sized_whitened(sized, "data", "white", background).select(*samples.columns, "white")


def sub_clusters(samples: DataFrame, background: Background, rows: int, cols: int, most: int, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """box_id, data and cluster of samples (box_id, data): up to `most` clusters of the whitened samples.

    Clusters smaller than floor(n / 10) are left out with their samples, and the others
    numbered anew.
    """
    samples = samples.select("box_id", "data")
    n = samples.count()
    k = min(most, n)
    if k < 2:
        return samples.withColumn("cluster", F.lit(0))
    white = whitened(samples, background, rows, cols).select(F.struct("box_id", "data").alias("sample"), "white")
    assigned = cluster.assign(white, "sample", "white", cluster.fit(white, "white", k, list(seeds)))
    sizes = {r["cluster"]: r["count"] for r in assigned.groupBy("cluster").count().collect()}
    kept = sorted(c for c, size in sizes.items() if size >= n // 10)
    return assigned.where(F.col("cluster").isin(kept)).select("sample.*", _renumbered(kept, list(range(len(kept)))))


def learn_images(images: DataFrame, boxes: DataFrame, key: str, background: Background, aspects: int = 2, features: int = 3, most: int = 20, seeds: tuple[int, ...] = (1, 2, 3), progress: Callable[[int, int], bool] | None = None) -> tuple[Model, list[float], list[int]]:
    """A model, the thresholds and the numbers of samples of its components, from images and the boxes of objects.

    Boxes are clustered by aspect ratio, each cluster gets a template size, its boxes
    become histograms of gradients of that size, these are clustered once whitened, and
    each cluster gives a component. Without boxes: a model of no components. progress is
    told how many clusters of how many are done, and ends the work by False; the model
    then has the components so far.
    """
    extractor = hog.EXTRACTORS["HOG"].set(cell=background.cell[0])
    cell = background.cell[0]
    clustered = aspect_clusters(boxes, key, aspects, seeds)
    components: list[Component] = []
    thresholds: list[float] = []
    counts: list[int] = []
    wanted = template_sizes(clustered, cell, most)
    for done, (number, (cols, rows)) in enumerate(wanted.items()):
        if progress and progress(done, len(wanted)) is False:
            break
        own = clustered.where(F.col("cluster") == number).withColumn("to_w", F.lit(cols * cell)).withColumn("to_h", F.lit(rows * cell))
        samples = sub_clusters(features_of(crops(images, own, key), "box_id", extractor), background, rows, cols, features, seeds)
        model, found = engine.learn(samples, background, rows, cols)
        sizes = {r["cluster"]: r["count"] for r in samples.groupBy("cluster").count().collect()}
        components += model.components
        thresholds += found
        counts += [sizes[c] for c in sorted(sizes)]
    return Model(components, extractor.name, {k: str(v) for k, v in extractor.parameters}), thresholds, counts


def template_sizes_of(boxes: DataFrame, by: list[str], cell: int = 8, most: int = 20) -> DataFrame:
    """by, cols and rows of the template of each group of boxes: as template_sizes, of all groups at once."""
    doubles = boxes.select(*by, F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h")).where("w > 0 AND h > 0")
    both = stats.aspect_modes(doubles, "w", "h", by).join(stats.area_quantile(doubles, F.col("w") * F.col("h"), by), by)

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [stats.model_size(a, q, cell, most) for a, q in zip(pdf["aspect"], pdf["area"], strict=True)]
            yield pdf[by].assign(cols=[c for c, _ in found], rows=[r for _, r in found]).astype({"cols": "int32", "rows": "int32"})

    kinds = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in by)
    return both.mapInPandas(size, f"{kinds}, cols int, rows int")


def learn_image_classes(images: DataFrame, boxes: DataFrame, key: str, cls: str, background: Background, aspects: int = 2, features: int = 3, most: int = 20, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Templates of all classes of boxes at once, and the samples that they are made of.

    The first has class, component, rows, cols, channels, n, weights, threshold and f; the
    second key, box_id, class, component and white, as held_out takes them. boxes has key,
    box_id (unique), the class, x, y, w and h. Each step of learn_images is one plan for
    all classes: clusters by aspect ratio, sizes of templates, crops and features, clusters
    of whitened samples of one (class, shape), and a discriminant for each cluster.
    """
    cell = background.cell[0]
    extractor = hog.EXTRACTORS["HOG"].set(cell=cell)
    sized = boxes.where((F.col("w") > 0) & (F.col("h") > 0) & F.col(cls).isNotNull()).select(key, "box_id", F.col(cls).alias("class"), "x", "y", "w", "h", F.array(F.col("h") / F.col("w")).alias("aspect"))
    near = keyed.nearest(sized, keyed.kmeans(sized, "class", "box_id", "aspect", aspects, rounds), "class", "aspect")
    centers = near.groupBy("class", "cluster").agg(F.array(F.avg(F.col("aspect")[0])).alias("center"), F.count(F.lit(1)).alias("n"))
    into = held(keyed.merged(centers, "class", 0.2).withColumnRenamed("into", "shape"))
    shaped = held(beside(near, into, ["class", "cluster"], F.lit(64)).drop("cluster", "distance", "aspect"))
    sizes = held(template_sizes_of(shaped, ["class", "shape"], cell, most))
    wanted = beside(shaped, sizes, ["class", "shape"], F.lit(64)).withColumn("to_w", F.col("cols") * cell).withColumn("to_h", F.col("rows") * cell)
    data = features_of(crops(images, wanted, key), "box_id", extractor)
    named = data.join(shaped.select("box_id", key, F.struct("class", "shape").alias("kind")).hint("merge"), "box_id")
    white = held(keyed.sized_whitened(named, "data", "white", background))
    found = held(keyed.nearest(white, keyed.kmeans(white, "kind", "box_id", "white", features, rounds), "kind", "white"))
    kept = keyed.large_enough(found, "kind").withColumn("component", F.row_number().over(W.partitionBy("kind.class").orderBy("kind.shape", "into")) - 1)
    kept = held(kept.select("kind", "cluster", "component", "n"))
    samples = held(beside(found, kept, ["kind", "cluster"], F.lit(64)))
    by = [F.col("kind.class").alias("class"), "component", "rows", "cols", "channels", "n"]
    means = samples.groupBy(*by).agg(keyed.mean_of("data").alias("mean"))
    models = keyed.sized_discriminants(means, "mean", background).drop("mean")
    return models, samples.select(key, "box_id", F.col("kind.class").alias("class"), "component", "white")


def models_of(learned: DataFrame, classes: list | None = None) -> tuple[dict[str, Model], dict[str, list[float]]]:
    """Models of classes, by name, and the thresholds of their components, from a table of templates; classes names those that are wanted."""
    rows = (learned if classes is None else learned.where(F.col("class").isin(classes))).orderBy("class", "component").collect()
    models: dict[str, Model] = {}
    thresholds: dict[str, list[float]] = {}
    for r in rows:
        part = Part(np.array(r["weights"], np.float32).reshape(r["rows"], r["cols"], r["channels"]))
        models.setdefault(str(r["class"]), Model([])).components.append(Component([part], -r["threshold"]))
        thresholds.setdefault(str(r["class"]), []).append(r["threshold"])
    return models, thresholds


def left_out_changes(learned: DataFrame, samples: DataFrame, key: str, cls: str) -> DataFrame:
    """What optimize_thresholds takes as `changes` for the model of one class: its components, numbered as there, without the samples of each image."""
    own = [df.where(F.col("class") == cls).withColumn("class", F.col("component").cast("string")).withColumn("component", F.lit(0)) for df in (learned, samples)]
    return held_out.changed_models(*own, key)


def optimize_thresholds(images: DataFrame, boxes: DataFrame, key: str, model: Model, interval: int = 10, overlap: float = 0.5, granularity: int = 100, b: float = 1.0, seed: int = 1, changes: DataFrame | None = None) -> list[float]:
    """The thresholds of a model's components, without their biases, that give the best F together; images without boxes are negatives.

    changes (left_out_changes) judge each image by templates without its own samples. The detector runs once over all images. One component takes the best of its sweep;
    several go through the search over the grid.
    """
    if not model.components:
        return []
    own = {str(i): Model([Component(c.parts, 0.0)], model.extractor, model.parameters) for i, c in enumerate(model.components)}
    found = detect_images(images, key, own, dict.fromkeys(own, 0.0), interval, changes=changes).withColumn("box_id", F.xxhash64(key, "class", "x", "y", "w", "h")).persist()
    try:
        if len(own) == 1:
            best = evaluate.max_f_measure(evaluate.sweep(evaluate.match(found, boxes, key, "box_id", overlap), boxes.count(), granularity), b).first()
            return [best["threshold"] or 0.0]
        hits = found.select("box_id", F.col("class").cast("int").alias("model"), F.floor(F.col("score") * granularity).cast("int").alias("bin"))
        claimed = None
        for name in own:
            one = evaluate.claims(found.where(F.col("class") == name), boxes, key, "box_id", overlap)
            claimed = one if claimed is None else claimed.unionByName(one)
        top = {r["model"]: r["top"] for r in hits.groupBy("model").agg(F.max("bin").alias("top")).collect()}
        # A bin beyond a model's highest stands for no detections of it at all.
        best = harmony.search(boxes.select(F.col("box_id").alias("object")), hits.join(claimed, "box_id", "left"), ["object"], [top.get(i, 0) + 2 for i in range(len(own))], seed, b=b).first()
        return [i / granularity for i in best["thresholds"]]
    finally:
        found.unpersist()


def features_of(images: DataFrame, key: str, extractor: hog.Extractor) -> DataFrame:
    """key, rows, cols, channels and data: the features of each image at its own resolution."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(row[0], extractor(hog.image_of(row[4], row[1], row[2], row[3]))) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame([(k, *f.shape, f.astype(np.float32).ravel()) for k, f in found], columns=[key, "rows", "cols", "channels", "data"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "depth", "data").mapInPandas(extract, f"{key} {kind}, rows int, cols int, channels int, data array<float>")


def extractor_of(model: Model) -> hog.Extractor:
    """The registered extractor of a model, with its parameters as numbers where they are some."""

    def value(text: str):
        try:
            return int(text)
        except ValueError:
            return float(text)

    return hog.EXTRACTORS[model.extractor].set(**{k: value(v) for k, v in model.parameters.items()})


def detect_images(images: DataFrame, key: str, models: dict[str, Model], thresholds: dict[str, float] | None = None, interval: int = 10, overlap: float = 0.5, changes: DataFrame | None = None) -> DataFrame:
    """key, class, component, score, level, x, y, w, h in pixels: what the models find in the images.

    Models of equal extractors share one pyramid of an image, and meet no other. Classes
    without a threshold take THRESHOLD. changes are those of engine.candidates.
    """
    given = {c: (thresholds or {}).get(c, THRESHOLD) for c in models}
    shared: dict[hog.Extractor, dict[str, Model]] = {}
    for name, model in models.items():
        shared.setdefault(extractor_of(model), {})[name] = model
    found = None
    for extractor, own in (shared or {hog.EXTRACTORS["HOG"]: {}}).items():
        cell = dict(extractor.parameters).get("cell", 1)
        levels = hog.pyramids(images, key, extractor, interval, cell=cell)
        boxes = engine.detect(levels, images, key, own, given, interval, overlap, cell, changes=changes)
        found = boxes if found is None else found.unionByName(boxes)
    return found


def evaluate_images(images: DataFrame, objects: DataFrame, key: str, models: dict[str, Model], name: str, least: float = 0.0, interval: int = 10, overlap: float = 0.5, granularity: int = 100) -> DataFrame:
    """threshold, tp, fp, np of one class over images: those without objects are negatives. objects are boxes whose box_id is unique.

    The detector runs at the threshold `least`, so that the sweep sees all scores above it.
    """
    found = detect_images(images, key, {name: models[name]}, {name: least}, interval)
    # After suppression no two boxes of an image are equal.
    numbered = found.withColumn("box_id", F.xxhash64(key, "x", "y", "w", "h"))
    return evaluate.sweep(evaluate.match(numbered, objects, key, "box_id", overlap), objects.count(), granularity)


def evaluate_classes(images: DataFrame, objects: DataFrame, key: str, models: dict[str, Model], least: float = 0.0, interval: int = 10, overlap: float = 0.5, granularity: int = 100) -> DataFrame:
    """class, threshold, tp, fp and np of all models, from one pass of the detector. objects have key, class, box_id (unique), x, y, w and h.

    A class is judged on all images: those without objects of it are its negatives.
    """
    found = detect_images(images, key, models, dict.fromkeys(models, least), interval)
    numbered = found.withColumn("box_id", F.xxhash64(key, "class", "x", "y", "w", "h"))
    return evaluate.evaluate_classes(numbered, objects.where(F.col("class").isin(list(models))), key, "class", "box_id", overlap, granularity)


def size_range(templates: DataFrame, by: str) -> DataFrame:
    """Least and largest rows and cols of the templates of each class, side by side: the least of both may be of different templates."""
    return templates.groupBy(by).agg(*(of(c).alias(f"{n}_{c}") for n, of in (("min", F.min), ("max", F.max)) for c in ("rows", "cols")))
