"""From boxes to a model and from images to detections, against arrays worked by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine, evaluate, hog, learner
from tessera.operators.learn import discriminant
from tessera.sources.models import Background, Component, Model, Part, read_model, reconstruct, with_thresholds, write_model

IMAGES = "id long, height int, width int, depth int, data binary"
BOXES = "id long, box_id long, x long, y long, w long, h long"


def frame(spark, images):
    return spark.createDataFrame([(k, *(i.shape if i is not None else (1, 1, 1)), bytearray(i.tobytes()) if i is not None else None) for k, i in images.items()], IMAGES)


def arrays(df, key="box_id"):
    return {r[key]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.depth) for r in df.collect()}


def identity(n=2, most=3):
    """Background of mean 0 whose cells are independent."""
    offsets = [(dx, dy) for dx in range(most + 1) for dy in range(-most, most + 1) if dx or dy >= 0]
    cov = np.array([np.eye(n) if o == (0, 0) else np.zeros((n, n)) for o in offsets])
    return Background((8, 8), np.full(n, 0.25), cov, np.array(offsets))


def test_crops(spark):
    rng = np.random.default_rng(1)
    images = {1: rng.integers(0, 256, (20, 30, 3), dtype=np.uint8), 2: None, 3: rng.integers(0, 256, (9, 9, 1), dtype=np.uint8)}
    boxes = [(1, 10, 2, 3, 5, 4), (1, 11, 28, 18, 10, 10), (1, 12, 40, 0, 5, 5), (1, 13, 1, 1, 0, 5), (2, 14, 0, 0, 1, 1), (3, 15, -2, -2, 5, 5), (4, 16, 0, 0, 5, 5)]
    df = spark.createDataFrame(boxes, BOXES)
    got = arrays(learner.crops(frame(spark, images), df, "id"))
    assert set(got) == {10, 11, 15}
    assert (got[10] == images[1][3:7, 2:7]).all() and (got[11] == images[1][18:, 28:]).all() and (got[15] == images[3][:3, :3]).all()
    fitted = arrays(learner.crops(frame(spark, images), df.withColumn("to_w", F.lit(8)).withColumn("to_h", F.lit(6)), "id"))
    assert all(i.shape[:2] == (6, 8) for i in fitted.values()) and set(fitted) == {10, 11, 12, 15}
    assert (fitted[15] == hog.resize(hog.crop(images[3], -2, -2, 5, 5, padded=True), 8, 6)).all()
    assert learner.crops(frame(spark, images), df.limit(0), "id").count() == 0


def test_aspect_clusters(spark):
    wide, tall, taller = [(100, 50)] * 6, [(50, 100)] * 5, [(50, 105)] * 4
    rows = [(i % 3, i, 0, 0, w, h) for i, (w, h) in enumerate([*wide, *tall, *taller])] + [(0, 99, 0, 0, 0, 5)]
    df = spark.createDataFrame(rows, BOXES)
    got = {r.box_id: r.cluster for r in learner.aspect_clusters(df, "id", 3).collect()}
    assert set(got) == set(range(15))  # the box of no area is left out
    groups = [{got[i] for i in range(a, b)} for a, b in ((0, 6), (6, 15))]  # 2.0 and 2.1 are one
    assert [len(g) for g in groups] == [1, 1] and groups[0] != groups[1] and groups[0] | groups[1] == {0, 1}
    assert {r.cluster for r in learner.aspect_clusters(df, "id", 1).collect()} == {0}
    assert learner.aspect_clusters(df.limit(0), "id", 3).count() == 0
    sizes = learner.template_sizes(learner.aspect_clusters(df, "id", 3))
    assert len(sizes) == 2 and {w > h for w, h in sizes.values()} == {True, False}


def test_whitened_samples_and_their_clusters(spark):
    rng = np.random.default_rng(2)
    pyramids = spark.createDataFrame([(6, 7, 2, rng.normal(size=84).tolist()) for _ in range(8)], "rows int, cols int, channels int, data array<double>")
    b = engine.learn_background(pyramids, most=1)
    cov, mean = reconstruct(b, 2, 2), np.tile(b.mean, 4)
    centres = [np.full(8, 4.0), np.full(8, -4.0)]
    points = [(i, (centres[i % 2] + rng.normal(size=8) * 0.01).tolist()) for i in range(30)] + [(30, [40.0, -40.0] * 4)]
    df = spark.createDataFrame(points, "box_id long, data array<double>")
    white = {r.box_id: np.array(r.white) for r in learner.whitened(df, b, 2, 2).collect()}
    assert all(np.allclose(white[i], np.linalg.solve(cov, np.array(p) - mean)) for i, p in points)
    got = {r.box_id: r.cluster for r in learner.sub_clusters(df, b, 2, 2, 3).collect()}
    assert set(got) == set(range(30))  # the one of its own is fewer than floor(31 / 10)
    assert {got[0], got[1]} == {0, 1} and all(got[i] == got[i % 2] for i in range(30))
    # The weights of a cluster are the centre of its whitened samples, by the largest.
    model, _ = engine.learn(learner.sub_clusters(df, b, 2, 2, 3), b, 2, 2)
    for c in (0, 1):
        centre = np.mean([white[i] for i in got if got[i] == c], 0)
        assert np.allclose(model.components[c].parts[0].weights.ravel(), centre / abs(centre).max(), atol=1e-5)
    assert {r.cluster for r in learner.sub_clusters(df.limit(1), b, 2, 2, 3).collect()} == {0}
    assert learner.sub_clusters(df.limit(0), b, 2, 2, 3).count() == 0


def scene(rng, x=None, y=None, size=48):
    """Noise, with a cross in a box of 48 pixels."""
    image = rng.integers(110, 140, (144, 160, 1), dtype=np.uint8)
    if x is not None:
        image[y + size // 2 - 4 : y + size // 2 + 4, x : x + size] = 250
        image[y : y + size, x + size // 2 - 4 : x + size // 2 + 4] = 250
    return image


def test_from_images_to_a_model_to_detections_to_average_precision(spark):
    rng = np.random.default_rng(3)
    places = {i: (8 * int(rng.integers(1, 12)), 8 * int(rng.integers(1, 11))) for i in range(8)}
    images = {i: scene(rng, *at) for i, at in places.items()} | {i: scene(rng) for i in range(8, 11)}
    df = frame(spark, images).repartition(3)
    boxes = spark.createDataFrame([(i, 100 + i, x, y, 48, 48) for i, (x, y) in places.items()], BOXES)
    negatives = hog.pyramids(df.where("id >= 8"), "id", hog.EXTRACTORS["HOG"], 4)
    b = engine.learn_background(negatives, most=10)
    model, thresholds, counts = learner.learn_images(df, boxes, "id", b, aspects=2, features=1)
    assert model.extractor == "HOG" and counts == [8] and len(thresholds) == len(model.components) == 1
    assert learner.extractor_of(model) == hog.EXTRACTORS["HOG"]
    crop = hog.crop(images[0], *places[0], 48, 48)
    rows, cols = model.components[0].parts[0].weights.shape[:2]
    features = [hog.hog(hog.resize(hog.crop(images[i], *at, 48, 48), cols * 8, rows * 8)).ravel() for i, at in places.items()]
    w, threshold, _ = discriminant(np.mean(features, 0), np.tile(b.mean, rows * cols), reconstruct(b, rows, cols))
    assert crop.shape == (48, 48, 1) and thresholds[0] == pytest.approx(threshold, abs=1e-4)
    assert np.allclose(model.components[0].parts[0].weights.ravel(), w, atol=1e-4)
    found = learner.detect_images(df, "id", {"cross": model}, {"cross": 0.0}, 4).collect()
    best = {i: max((r for r in found if r.id == i), key=lambda r: r.score) for i in places}
    for i, (x, y) in places.items():
        assert abs(best[i].x + best[i].w / 2 - x - 24) <= 12 and abs(best[i].y + best[i].h / 2 - y - 24) <= 12
    swept = learner.evaluate_images(df, boxes, "id", {"cross": model}, "cross", 0.0, 4, 0.3).collect()
    assert max(r.tp for r in swept) == 8 and all(r.np == 8 for r in swept)
    top = max(swept, key=lambda r: r.threshold)
    assert top.fp == 0


def test_models_meet_pyramids_of_their_extractor_only(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (48, 48, 1), dtype=np.uint8)
    df = frame(spark, {1: image})
    patch = image[10:14, 20:24].astype(np.float32) / 255
    own = patch - patch.mean()
    raw = Model([Component([Part(own)], 0.0)], "raw")
    score = float((own * patch).sum())
    found = learner.detect_images(df, "id", {"raw": raw, "hog": Model([Component([Part(np.zeros((2, 2, 32), np.float32))], -1.0)])}, {"raw": score - 1e-3}, 2, overlap=2.0).collect()
    assert {r["class"] for r in found} == {"raw"}  # a bias of -1 stays below the default threshold
    assert (20, 10, 4, 4) in {(r.x, r.y, r.w, r.h) for r in found}
    assert learner.detect_images(df, "id", {}).count() == 0


def test_learning_from_nothing(spark):
    images, boxes = frame(spark, {1: None}), spark.createDataFrame([], BOXES)
    model, thresholds, counts = learner.learn_images(images, boxes, "id", identity(32))
    assert (model.components, thresholds, counts) == ([], [], [])


def test_size_range(spark):
    df = spark.createDataFrame([("a", 3, 9), ("a", 5, 2), ("b", 1, 1)], "class string, rows int, cols int")
    got = {tuple(r) for r in learner.size_range(df, "class").select("class", "min_rows", "min_cols", "max_rows", "max_cols").collect()}
    assert got == {("a", 3, 2, 5, 9), ("b", 1, 1, 1, 1)}


def test_thresholds_of_components_found_together(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.integers(100, 120, (64, 64, 1), dtype=np.uint8)
    spots = {1: (rng.integers(0, 256, (4, 4, 1), dtype=np.uint8), (8, 8)), 2: (rng.integers(0, 256, (4, 4, 1), dtype=np.uint8), (40, 20))}
    images = {}
    for i, (patch, (x, y)) in spots.items():
        images[i] = base.copy()
        images[i][y : y + 4, x : x + 4] = patch
    images[3] = base
    df = frame(spark, images)
    boxes = spark.createDataFrame([(i, 100 + i, x, y, 4, 4) for i, (_, (x, y)) in spots.items()], BOXES)
    parts = [Part((p.astype(np.float32) / 255) - p.mean() / 255) for p, _ in spots.values()]
    model = Model([Component([p], 0.0) for p in parts], "raw")
    found = learner.optimize_thresholds(df, boxes, "id", model, 2)
    learned = with_thresholds(model, found)
    assert [c.bias for c in learned.components] == [-t for t in found]
    scores = [float((p.weights * s[0].astype(np.float32) / 255).sum()) for p, s in zip(parts, spots.values(), strict=True)]
    assert all(0 < t <= s for t, s in zip(found, scores, strict=True))
    hits = learner.detect_images(df, "id", {"spot": learned}, {"spot": 0.0}, 2).collect()
    assert {(r.id, r.x, r.y) for r in hits} == {(1, 8, 8), (2, 40, 20)}
    one = learner.optimize_thresholds(df, boxes.where("id = 1"), "id", Model(model.components[:1], "raw"), 2)
    assert len(one) == 1 and 0 < one[0] <= scores[0]
    assert learner.optimize_thresholds(df, boxes, "id", Model([], "raw")) == []
    write_model(spark, learned, f"{tmp_path}/m.txt")
    again = read_model(spark, f"{tmp_path}/m.txt")
    assert [c.bias for c in again.components] == [c.bias for c in learned.components] and again.extractor == "raw"


def test_progress_ends_learning(spark):
    told = []
    boxes = spark.createDataFrame([(1, 1, 0, 0, 8, 8)], BOXES)
    model, _, _ = learner.learn_images(frame(spark, {1: None}), boxes, "id", identity(32), progress=lambda i, n: told.append((i, n)) or False)
    assert told == [(0, 1)] and model.components == []


def two_classes(rng):
    """Images with a cross, a bar or nothing, and the boxes of objects with their class."""
    images, boxes = {}, []
    for i in range(14):
        image = rng.integers(110, 140, (144, 160, 1), dtype=np.uint8)
        x, y = 8 * int(rng.integers(1, 8)), 8 * int(rng.integers(1, 10))
        if i < 6:
            image[y + 20 : y + 28, x : x + 48] = 250
            image[y : y + 48, x + 20 : x + 28] = 250
            boxes.append((i, 100 + i, "cross", x, y, 48, 48))
        elif i < 11:
            image[y : y + 32, x : x + 80 : 8] = 250
            boxes.append((i, 100 + i, "bar", x, y, 80, 32))
        images[i] = image
    return images, boxes


CLASSED = "id long, box_id long, cls string, x long, y long, w long, h long"


def test_classes_of_images_learned_at_once_equal_those_learned_alone(spark):
    images, boxes = two_classes(np.random.default_rng(12))
    df, b = frame(spark, images).repartition(3), None
    b = engine.learn_background(hog.pyramids(df.where("id >= 11"), "id", hog.EXTRACTORS["HOG"], 4), most=14)
    rows = spark.createDataFrame([*boxes, (0, 900, None, 1, 1, 9, 9), (0, 901, "flat", 1, 1, 9, 0)], CLASSED)
    learned, samples = learner.learn_image_classes(df, rows, "id", "cls", b, aspects=2, features=1)
    models, thresholds = learner.models_of(learned)
    assert set(models) == {"cross", "bar"} and samples.count() == 11
    for c in models:
        one, found, counts = learner.learn_images(df, rows.where(f"cls = '{c}'").drop("cls"), "id", b, aspects=2, features=1)
        assert len(one.components) == len(models[c].components) == 1 and [r.n for r in learned.where(f"class = '{c}'").collect()] == counts
        assert np.allclose(one.components[0].parts[0].weights, models[c].components[0].parts[0].weights, atol=1e-4)
        assert thresholds[c] == pytest.approx(found, abs=1e-4)
    assert set(learner.models_of(learned, ["bar"])[0]) == {"bar"}
    # All classes are detected and evaluated in one pass.
    objects = rows.where("cls IS NOT NULL AND h > 0").withColumnRenamed("cls", "class")
    swept = learner.evaluate_classes(df, objects, "id", models, 0.0, 4, 0.3)
    best = {r["class"]: r.f_measure for r in evaluate.max_f_measure(swept, by=("class",)).collect()}
    assert set(best) == {"cross", "bar"} and min(best.values()) > 0.7
    assert {(r["class"], r.np) for r in swept.collect()} == {("cross", 6), ("bar", 5)}
    # Thresholds with each image judged by templates without its own samples.
    changes = learner.left_out_changes(learned, samples, "id", "cross")
    assert changes.count() == 6
    own = rows.where("cls = 'cross'").drop("cls")
    model = models["cross"]
    got = learner.optimize_thresholds(df, own, "id", model, 4, 0.3, changes=changes)
    # The same by hand: each image with a model learned without it, on the scale of the model of all.
    f, found = learned.where("class = 'cross'").first().f, None
    for i in range(14):
        here = df.where(f"id = {i}")
        if i < 6:
            x = np.array([r.white for r in samples.where(f"class = 'cross' AND id <> {i}").collect()]).mean(0) / f
            part = Part(x.reshape(model.components[0].parts[0].weights.shape).astype(np.float32))
            mine = Model([Component([part], 0.0)], model.extractor, model.parameters)
        else:
            mine = Model([Component(model.components[0].parts, 0.0)], model.extractor, model.parameters)
        one = learner.detect_images(here, "id", {"0": mine}, {"0": 0.0}, 4)
        found = one if found is None else found.unionByName(one)
    numbered = found.withColumn("box_id", F.xxhash64("id", "class", "x", "y", "w", "h"))
    wanted = evaluate.max_f_measure(evaluate.sweep(evaluate.match(numbered, own, "id", "box_id", 0.3), 6, 100)).first()
    assert got == [pytest.approx(wanted.threshold)]


def test_no_classes(spark):
    images, _ = two_classes(np.random.default_rng(13))
    df = frame(spark, images)
    learned, samples = learner.learn_image_classes(df, spark.createDataFrame([], CLASSED), "id", "cls", identity(32), 2, 2)
    assert learned.count() == 0 and samples.count() == 0 and learner.models_of(learned) == ({}, {})
