"""Cases worked out by hand, and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.geometry import boxes_or_whole, intersection, iou
from tessera.functions.text import class_name, token_overlap
from tessera.operators import cluster, detect, evaluate, harmony, learn, sampling, score, stats
from tessera.sources import annotations, model_list
from tessera.streaming import frames


def test_overlap_of_two_boxes(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 10, 10)], "a_x int, a_y int, a_w int, a_h int, b_x int, b_y int, b_w int, b_h int")
    r = df.select(intersection("a_", "b_").alias("i"), iou("a_", "b_").alias("u")).first()
    assert r["i"] == 25 and r["u"] == pytest.approx(25 / 175)


def test_suppression(spark):
    rows = [(1, 1, 3.0, 0, 0, 10, 10), (1, 2, 2.0, 1, 1, 8, 8), (1, 3, 1.0, 20, 20, 5, 5)]
    df = spark.createDataFrame(rows, "image int, id int, score double, x int, y int, w int, h int")
    assert sorted(r["id"] for r in detect.suppress(df, ["image"], "id").collect()) == [1, 3]


def test_local_maximum_and_plateau(spark):
    def grid(value):
        return spark.createDataFrame([(y, x, float(value(y, x))) for y in range(3) for x in range(3)], "y long, x long, v double")

    assert [tuple(r) for r in detect.local_maxima(grid(lambda y, x: y == x == 1)).collect()] == [(1, 1, 1.0)]
    assert detect.local_maxima(grid(lambda y, x: 1)).count() == 0


def test_offsets(spark):
    assert sorted(tuple(r) for r in stats.offsets(spark, 1).collect()) == [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def test_pyramid_scales(spark):
    df = spark.createDataFrame([(1, 160, 160), (2, 60, 60)], "id int, w int, h int")
    got = [(r["id"], r["scale"]) for r in score.pyramid_scales(df, "id", "w", "h", interval=2).orderBy("level").collect()]
    assert [s for i, s in got if i == 1] == pytest.approx([2, 2**0.5, 1, 2**-0.5, 0.5])
    assert [s for i, s in got if i == 2] == pytest.approx([2, 2**0.5, 1])


def test_distance_transform_case():
    at = np.arange(3.0)
    assert score.envelope(np.array([0.0, 4, 0]), at, at, -1, 0).tolist() == [3, 4, 3]


@settings(deadline=None, max_examples=50)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20), st.floats(-3, -0.1), st.floats(-2, 2))
def test_distance_transform_is_the_maximum(values, a, b):
    at = np.arange(float(len(values)))
    got = score.envelope(np.array(values), at, at, a, b)
    want = [max(v + a * (i - j) ** 2 + b * (i - j) for j, v in enumerate(values)) for i in range(len(values))]
    assert np.allclose(got, want)


def test_box_from_markup(spark):
    xml = "<annotation><filename>f</filename><size><width>100</width><height>100</height><depth>3</depth></size><object><name>cat big</name><bndbox><xmin>11</xmin><ymin>21</ymin><xmax>20</xmax><ymax>40</ymax></bndbox></object><object><name>dog</name><bndbox><xmin>0</xmin><ymin>5</ymin><xmax>9</xmax><ymax>9</ymax></bndbox></object></annotation>"
    got = annotations.objects(spark.createDataFrame([(1, xml)], "id int, xml string"), "id", "xml").collect()
    assert [(r["name"], r["x"], r["y"], r["w"], r["h"]) for r in got] == [("cat", 11, 21, 10, 20)]


def test_f_measure_and_precision(spark):
    r = spark.createDataFrame([(0.0, 6, 2, 8), (1.0, 0, 0, 8)], "threshold double, tp long, fp long, np long").select(evaluate.precision().alias("p"), evaluate.recall().alias("r"), evaluate.f_measure().alias("f")).collect()
    assert tuple(r[0]) == (0.75, 0.75, 0.75)
    assert r[1]["p"] is None


def test_average_precision(spark):
    scored = spark.createDataFrame([(3.0, True), (2.0, False), (1.0, True)], "score double, hit boolean")
    assert evaluate.average_precision(evaluate.sweep(scored, 2)).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    results = spark.createDataFrame([(1.0, 2, 2, 2), (2.0, 1, 0, 2)], "threshold double, tp long, fp long, np long")
    assert evaluate.average_precision(results).first()[0] == pytest.approx(0.75)
    assert evaluate.average_precision(results, as_shown=True).first()[0] == pytest.approx(1.0)


def test_token_search_counts_duplicates(spark):
    df = spark.createDataFrame([("red, widget", "my_red-car.txt")], "d string, f string")
    r = df.select(token_overlap("red widget widget", F.col("d")).alias("n"), class_name(F.col("f")).alias("c")).first()
    assert tuple(r) == (3, "My Red Car")


def test_round_robin_is_fair(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, id int")
    assert [r["id"] for r in sampling.round_robin(df, "g", "id", 1, 10).collect()] == [1, 4, 2, 3]


def test_area_quantile(spark):
    df = spark.range(1, 11).select(F.lit("k").alias("k"), F.col("id").alias("a"))
    assert stats.area_quantile(df, F.col("a"), ["k"]).first()["area"] == 3


def test_leave_one_out_of_equal_cells(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], "id long, v array<float>, label int")
    assert {r["score"] for r in learn.leave_one_out(df, "id", "v", "label").collect()} == {5.0}


def test_whole_image_when_a_box_is_empty(spark):
    df = spark.createDataFrame([([],), (None,), ([(1, 1, 0, 2)],), ([(1, 1, 2, 2)],)], "b array<struct<x: long, y: long, w: long, h: long>>")
    got = [r[0][0].w for r in df.select(boxes_or_whole(F.col("b"), F.lit(9), F.lit(8))).collect()]
    assert got == [9, 9, 9, 2]


def test_discriminant_solves(spark, data):
    mean, cov, n = learn.moments(spark.read.parquet(f"{data}/embeddings.parquet").select("embedding"), "embedding")
    x = np.array([r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("embedding").collect()])
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    w, threshold, f = learn.discriminant(x[0], mean, cov + 0.01 * np.eye(64))
    raw = np.linalg.solve(cov + 0.01 * np.eye(64), x[0] - mean)
    assert np.allclose(w * f, raw) and np.abs(w).max() == pytest.approx(1)
    assert threshold == pytest.approx((x[0] @ np.linalg.solve(cov + 0.01 * np.eye(64), x[0]) - mean @ np.linalg.solve(cov + 0.01 * np.eye(64), mean)) / 2 / f)


def test_merge_follows_chains():
    assert cluster.merge_near([0.0, 0.15, 0.3, 2.0], [1, 1, 1, 1], 0.2) in ([0, 0, 1, 2], [0, 0, 0, 1])
    assert cluster.merge_near([0.0, 5.0], [1, 1], 0.2) == [0, 1]


def test_model_size():
    w, h = stats.model_size(1.0, 6400.0)
    assert (w, h) == (10, 10)
    w, h = stats.model_size(4.0, 10.0)
    assert max(w, h) <= 20 and h > w


def test_harmony_finds_a_good_pair():
    best, value = harmony.harmony(lambda p: -((p[0] - 3) ** 2) - (p[1] - 9) ** 2, [17, 17], seed=3)
    assert value >= -2


def test_boxes_meet_once_whatever_the_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), i, *(int(v) for v in rng.integers(-20, 60, 2)), *(int(v) for v in rng.integers(-1, 40, 2)), float(rng.integers(5))) for i in range(60)]
    df = spark.createDataFrame(rows, "image int, id long, x long, y long, w long, h long, score double")
    told = [sorted(map(tuple, detect.overlaps(df, ["image"], "id", tile).collect())) for tile in (3, 64, 1000)]
    assert told[0] == told[1] == told[2]

    def shared(a, b):
        side = [min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]) for i in (2, 3)]
        return side[0] * side[1] if min(side) > 0 and min(a[4], a[5], b[4], b[5]) > 0 else 0

    wanted = {(a[1], b[1], shared(a, b)) for a in rows for b in rows if a[0] == b[0] and (a[6], -a[1]) > (b[6], -b[1]) and shared(a, b)}
    assert {t[1:4] for t in told[0]} == wanted


def test_small_tables_in_slices(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    centers = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center")).withColumnRenamed("label", "cluster")
    whole, cut = ({tuple(r) for r in cluster.assign(e, "vec_id", "embedding", centers, limit=n).select("vec_id", "cluster", "distance").collect()} for n in (1 << 20, 1500))
    assert whole == cut and len(whole) == e.count()
    models = centers.selectExpr("cluster AS component", "center AS weights")
    whole, cut = ({tuple(r) for r in score.best_component(e, "vec_id", "embedding", models, limit=n).collect()} for n in (1 << 20, 1500))
    assert whole == cut and len(whole) == e.count()


def test_joint_thresholds_equal_the_best_of_the_grid(spark):
    rng = np.random.default_rng(7)
    objects = spark.createDataFrame([(i,) for i in range(40)], "o long")
    hits = spark.createDataFrame([(int(rng.integers(2)), int(rng.integers(60)), int(rng.integers(9))) for _ in range(150)], "model int, o long, bin int")
    best = harmony.joint_f_grid(objects, hits, ["o"], 9).agg(F.max("f_measure")).first()[0]
    assert harmony.search(objects, hits, ["o"], [9, 9], 1, runs=4, rounds=3000).first()["f_measure"] == pytest.approx(best)


def test_clusters_are_at_rest_and_axes_equal_numpy(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    x = np.array([r[0] for r in e.orderBy("vec_id").select("embedding").collect()], float)
    centers = np.array([r.center for r in cluster.fit(e, "embedding", 4, [1, 2]).orderBy("cluster").collect()])
    near = ((x[:, None] - centers) ** 2).sum(-1).argmin(1)
    assert np.allclose(centers, [x[near == i].mean(0) for i in range(4)], atol=1e-6) and np.all(np.diff(centers[:, 0]) >= 0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    wanted = (x - x.mean(0)) @ axes[:, np.argsort(-values)[:4]]
    told = np.array([r.projected for r in learn.project_pca(e, "vec_id", "embedding", 4).orderBy("vec_id").collect()])
    assert told.shape == wanted.shape and np.allclose(abs(told), abs(wanted), atol=1e-5)


def test_generic_sizes_have_two_pixels_a_side():
    assert stats.model_size(1.0, 1.0, cell=1, most=0, least=2) == (2, 2)
    assert stats.model_size(4.0, 100.0, cell=1, most=0, least=2) == (5, 20)
    assert stats.model_size(4.0, 100.0, cell=1, most=10, least=2) == (3, 10)


def test_components_are_numbered_on(spark):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "class string, component int")
    new = spark.createDataFrame([("a", 0), ("c", 0), ("c", 1)], "class string, component int")
    both = sampling.append_components(old, new, "class", "component")
    assert sorted(map(tuple, both.collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1)]
    assert sorted(map(tuple, sampling.without_component(both, "component", 1, "class").collect())) == [("a", 0), ("a", 1), ("b", 0), ("c", 0)]


def test_exact_and_cyclic_autocorrelation_agree_on_constant_rows(spark):
    g = spark.createDataFrame([(y, x, 1.0) for y in range(4) for x in range(4)], "y long, x long, v double")
    assert {r["cov"] for r in stats.autocorrelation(g, 1, 0.0).collect()} == {1.0}
    assert {r["cov"] for r in stats.autocorrelation(g, 1, 0.0, (4, 4)).collect()} == {1.0}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "image int, id int, score double, x int, y int, w int, h int")
    assert detect.suppress(empty, ["image"], "id").count() == 0
    assert detect.overlaps(empty, ["image"], "id").count() == 0
    assert evaluate.sweep(spark.createDataFrame([], "score double, hit boolean"), 0).count() == 0


def test_model_list_round_trip(spark, tmp_path):
    file = tmp_path / "models.txt"
    file.write_text('"red car" a.txt 0.5 n1\n# "old one" b.txt -1e-1\n# just a remark\nplain "c d.txt" 2\n')
    rows = {r["classname"]: r for r in model_list.read(spark, str(file)).collect()}
    assert set(rows) == {"red car", "old one", "plain"}
    assert rows["old one"]["disabled"] and rows["old one"]["threshold"] == -0.1 and rows["plain"]["synset"] is None
    assert rows["plain"]["modelfile"] == f"{tmp_path}/c d.txt"
    model_list.write(model_list.read(spark, str(file)), str(tmp_path / "out"))
    again = {r["classname"]: tuple(r) for r in model_list.read(spark, str(tmp_path / "out")).collect()}
    assert {k: v[2:] for k, v in again.items()} == {k: tuple(r)[2:] for k, r in rows.items()}


def test_stream_of_frames(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = frames.watch(stream, ["user_id"], "ts", "event_id").outputMode("complete").format("memory").queryName("frames").start()
    q.processAllAvailable()
    q.stop()
    wanted = {tuple(r) for r in frames.latest(events, ["user_id"], "ts", "event_id").collect()}
    assert {tuple(r) for r in spark.table("frames").collect()} == wanted
    assert math.isfinite(len(wanted))
