"""From images to detections, and learning, on small arrays."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.geometry import aspect_ratio, cell_to_pixel, cells_to_pixels, pixels_to_cells
from tessera.operators import engine
from tessera.sources.models import Component, Model, Part


def test_correlation_is_the_sum_of_products():
    rng = np.random.default_rng(0)
    cells, w = rng.normal(size=(5, 6, 3)), rng.normal(size=(2, 3, 3))
    padded = np.pad(cells, ((0, 2), (0, 3), (0, 0)))
    want = [[(padded[y : y + 2, x : x + 3] * w).sum() for x in range(6)] for y in range(5)]
    assert np.allclose(engine.correlation(cells, w), want)


def test_parts_follow_their_root():
    levels = {0: np.zeros((8, 8, 1)), 2: np.ones((4, 4, 1))}
    levels[0][5, 4] = 10
    root, part = Part(np.ones((1, 1, 1), np.float32)), Part(np.ones((1, 1, 1), np.float32), (0, 1), (-1.0, 0.0, -1.0, 0.0))
    scores = engine.component_scores(levels, Component([root, part], 0.5), 2)
    assert set(scores) == {2} and scores[2][2, 2] == 11.5 and scores[2][2, 1] == 1.5 + 10 - 4
    assert scores[2].argmax() == 2 * 4 + 2


def test_a_template_is_found_where_it_was_cut_out(spark):
    rng = np.random.default_rng(4)
    grids = {(i, k): rng.normal(size=(12, 12, 4)) for i in (1, 2) for k in (1, 2)}
    levels = spark.createDataFrame([(i, k, 2.0 ** (1 - k / 2), 12, 12, 4, g.ravel().tolist()) for (i, k), g in grids.items()], "id long, level int, scale double, rows int, cols int, channels int, data array<double>")
    df = spark.createDataFrame([(1, 96, 96), (2, 96, 96)], "id long, width int, height int")
    cells = grids[1, 2]
    w = cells[4:7, 3:6]
    model = Model([Component([Part(w.astype(np.float32))], 0.0)])
    score = float((w * cells[4:7, 3:6]).sum())
    found = engine.candidates(levels, "id", {"x": model}, {"x": 0.9 * score}, interval=2)
    (here,) = found.where("id = 1 AND level = 2 AND x = 3 AND y = 4").collect()
    assert abs(here.score - score) < 1e-3 and (here.w, here.h, here.component) == (3, 3, 0)
    boxes = engine.detect(levels, df, "id", {"x": model}, {"x": 0.9 * score}, interval=2, overlap=2.0).collect()
    assert (1, "x", 24, 32, 24, 24) in {(r.id, r["class"], r.x, r.y, r.w, r.h) for r in boxes}
    assert all(r.x + r.w <= 96 and r.y + r.h <= 96 for r in boxes)
    assert engine.detect(levels, df, "id", {}, {}).count() == 0


def test_background_and_learning(spark):
    rng = np.random.default_rng(5)
    grids = [rng.normal(size=(9, 8, 2)) for _ in range(6)]
    df = spark.createDataFrame([(*g.shape, g.ravel().tolist()) for g in grids], "rows int, cols int, channels int, data array<double>").repartition(3)
    b = engine.learn_background(df, most=1)
    mean = np.mean([g.reshape(-1, 2).mean(0) for g in grids], 0)
    assert np.allclose(b.mean, mean)
    at = [tuple(o) for o in b.offsets.tolist()].index((1, -1))
    pairs = np.concatenate([((g - mean)[1:, :-1].reshape(-1, 2)[:, :, None] * (g - mean)[:-1, 1:].reshape(-1, 2)[:, None, :]) for g in grids])
    assert np.allclose(b.cov[at], pairs.mean(0))
    shape = np.array([3.0, 0, 0, 3.0, 1, 1, 0, 0])
    samples = spark.createDataFrame([(i % 2, (shape * (1 if i % 2 else -1) + rng.normal(size=8) * 0.01).tolist()) for i in range(20)], "cluster int, data array<double>")
    model, thresholds = engine.learn(samples, b, 2, 2)
    assert len(model.components) == 2 and all(abs(abs(c.parts[0].weights).max() - 1) < 1e-6 for c in model.components)
    for c, sign, t in zip(model.components, (-1, 1), thresholds, strict=True):
        own, other = ((shape * s).reshape(2, 2, 2) for s in (sign, -sign))
        assert (c.parts[0].weights * own).sum() > t > (c.parts[0].weights * other).sum()


def test_cells_and_pixels(spark):
    r = spark.range(1).select(cells_to_pixels(F.lit(5), 8, 2).alias("p"), pixels_to_cells(F.lit(44), 8, 2).alias("c"), pixels_to_cells(F.lit(45), 8, 0, nearest=True).alias("n"), cell_to_pixel(F.lit(3), 8, 2).alias("x"), aspect_ratio(F.lit(4), F.lit(2)).alias("a")).first()
    assert tuple(r) == (44, 5, 6, 26, 0.5)
