"""Formats: round trips and values worked out by hand."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine, hog
from tessera.sources import archives, models, repositories


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(data), 1234567
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_tar_index_and_entries(spark):
    files = {"a.jpg": b"x" * 700, "d/" * 60 + "deep.xml": b"", "b.jpg": b"yy"}
    df = spark.createDataFrame([("p/n1.tar", tar(files)), ("p/n2.tar", b""), ("p/n3.tar", None)], "path string, content binary")
    got = archives.extract(df).orderBy("index").collect()
    assert [(r.name, r.type, r.size, r.mtime, bytes(r.data)) for r in got] == [(k, "file", len(v), 1234567, v) for k, v in files.items()]
    assert archives.index(df).columns == ["path", "index", "name", "type", "size", "mtime", "offset"]
    assert archives.find(archives.index(df), "b.png", any_extension=True).first()["name"] == "b.jpg"


def test_repository_of_archives(spark, tmp_path):
    for d in ("Images", "Annotation"):
        (tmp_path / d).mkdir()
    assert repositories.problems(spark, str(tmp_path)) == ["synset_wordlist.txt", "Images/*.tar"]
    (tmp_path / "synset_wordlist.txt").write_text("n1 red car, auto\n\nn2\n")
    (tmp_path / "Images/n1.tar").write_bytes(tar({"i1.jpg": b"1", "i2.jpg": b"2"}))
    (tmp_path / "Annotation/n1.tar").write_bytes(tar({"i2.xml": b"<annotation/>"}))
    assert repositories.problems(spark, str(tmp_path)) == []
    assert [tuple(r) for r in repositories.synsets(spark, f"{tmp_path}/synset_wordlist.txt").collect()] == [("n1", "red car, auto"), ("n2", "")]
    images, notes = repositories.archive_images(spark, str(tmp_path)), repositories.archive_annotations(spark, str(tmp_path))
    assert [(r.synset_id, r.stem) for r in images.join(notes, ["synset_id", "stem"], "left_semi").collect()] == [("n1", "i2")]
    assert [r.name for r in repositories.export(images, 1, ["stem"]).collect()] == ["i1.jpg"]


def test_repository_of_directories(spark, tmp_path):
    (tmp_path / "cats/deep").mkdir(parents=True)
    (tmp_path / "cats/deep/x.JPG").write_bytes(b"1")
    (tmp_path / "cats/y.txt").write_bytes(b"2")
    assert [(r.synset_id, r.stem) for r in repositories.directory_images(spark, str(tmp_path)).collect()] == [("cats", "x")]


def test_model_file_round_trip_and_first_version():
    part = models.Part(np.arange(12, dtype=np.float32).reshape(2, 3, 2), (1, -1), (0.5, 1.0, -0.25, 2.0))
    root = models.Part(np.ones((1, 1, 2), np.float32))
    m = models.Model([models.Component([root, part], -0.75)], "HOG", {"cellSize": "8", "name": "a b"})
    again = models.parse_model(models.format_model(m))
    assert (again.extractor, again.parameters) == ("HOG", m.parameters) and again.components[0].bias == -0.75
    assert np.array_equal(again.components[0].parts[1].weights, part.weights) and again.components[0].parts[1].deformation == part.deformation
    first = models.parse_model("1\n1 0.5\n1 1 2 0 0 9 9 9 9\n3 4\n")
    assert first.extractor == "HOG" and first.components[0].parts[0].deformation == (0.0,) * 4
    assert len(models.joined(again, again).components) == 2 and not models.without_component(again, 0).components
    with pytest.raises(ValueError):
        models.joined(again, first)


def test_models_as_a_table(spark):
    m = models.parse_model("1\n1 0.5\n1 1 2 0 0 0 0 0 0\n3 4\n")
    assert models.components_table(spark, {"cat": m}).first()["weights"] == [3.0, 4.0]


def test_background_and_reconstruction():
    offsets = np.array([(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])
    rng = np.random.default_rng(0)
    cov = rng.normal(size=(5, 2, 2)).astype(np.float32)
    cov[0] = cov[0] + cov[0].T
    b = models.Background((8, 8), np.array([1, 2], np.float32), cov, offsets)
    again = models.read_background(models.write_background(b))
    assert again.cell == (8, 8) and np.array_equal(again.cov, cov) and np.array_equal(again.offsets, offsets)
    full = models.reconstruct(again, 2, 2)
    assert np.allclose(full, full.T) and np.allclose(full[0:2, 2:4], (cov[3]), atol=1e-6)
    with pytest.raises(ValueError):
        models.reconstruct(again, 3, 3)
    old = np.array([8, 2, 0], "<u4").tobytes() + np.array([1, 2], "<f4").tobytes()
    assert models.read_background(old).cell == (8, 8)


def test_pyramids_projections_and_scales():
    levels = [(2.0, np.arange(6, dtype=np.float32).reshape(1, 2, 3)), (1.0, np.zeros((1, 1, 3), np.float32))]
    interval, again = models.read_pyramid(models.write_pyramid(5, levels))
    assert interval == 5 and all(a[0] == b[0] and np.array_equal(a[1], b[1]) for a, b in zip(levels, again, strict=True))
    mean, axes = models.read_projection(models.write_projection(np.ones(3), np.arange(6).reshape(3, 2)))
    assert mean.tolist() == [1, 1, 1] and axes.tolist() == [[0, 1], [2, 3], [4, 5]]
    assert models.read_scales("1 2.5\n3").tolist() == [1, 2.5, 3]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 6, 2, 8), ("a", 0.75, 0, 0, 8)], "class string, threshold double, tp long, fp long, np long")
    models.write_results(df, str(tmp_path / "r"), "class")
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    assert "Model;Threshold;TP;FP;NP;Precision;Recall;F-Measure" in text and "a;0.5;6;2;8;0.750000;0.750000;0.750000" in text
    assert sorted(tuple(r) for r in models.read_results(spark, str(tmp_path / "r")).collect()) == [("a", 0.5, 6, 2, 8), ("a", 0.75, 0, 0, 8)]


def test_resize_and_crop():
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert np.array_equal(hog.resize(image, 4, 4), image)
    assert hog.resize(np.full((9, 7, 1), 77, np.uint8), 3, 2).tolist() == np.full((2, 3, 1), 77).tolist()
    assert hog.crop(image, -1, 2, 3, 9).shape == (2, 2, 3)
    assert np.array_equal(hog.crop(image, -1, -1, 2, 2, padded=True)[0, 0], image[0, 0])


def test_hog_of_an_edge_and_its_mirror():
    image = np.zeros((32, 32, 1), np.uint8)
    image[:, 16:] = 200
    f = hog.hog(image)
    assert f.shape == (4, 4, 32) and np.allclose(f[:, :, 31], 0)
    assert f[1, 1, :18].argmax() == 0 and f[1, 1, 18:27].argmax() == 0
    noise = np.random.default_rng(1).integers(0, 255, (40, 48, 3)).astype(np.uint8)
    assert np.allclose(hog.flip(hog.hog(noise)), hog.hog(noise[:, ::-1]), atol=1e-9)
    assert hog.hog(np.full((16, 16, 1), 9, np.uint8)).sum() == 0
    with pytest.raises(ValueError):
        hog.hog(image, 3)


def test_pyramid_of_images(spark):
    data = np.random.default_rng(2).integers(0, 255, 80 * 80).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(1, 80, 80, 1, data), (2, 20, 20, 1, data[:400]), (3, 80, 80, 1, None)], "id long, height int, width int, depth int, data binary")
    got = hog.pyramids(df, "id", hog.EXTRACTORS["HOG"], interval=2).orderBy("level").collect()
    assert [(r.id, r.level) for r in got] == [(1, 0), (1, 1), (1, 2)] and got[0].rows == 20 and got[2].rows == 10
    with pytest.raises(KeyError):
        hog.EXTRACTORS["HOG"].set(size=3)


def test_scaled_and_projected_cells(spark):
    df = spark.createDataFrame([([2.0, 4.0],)], "c array<float>")
    r = df.select(hog.scaled(F.col("c"), [2, 8]).alias("s"), hog.projected(F.col("c"), [1, 1], [[1, 0], [1, 1]]).alias("p")).first()
    assert r.s == [1.0, 0.5] and r.p == [1.0, 4.0]


def test_resize_halves_while_both_sides_stay_large_enough():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (32, 64, 3)).astype(np.uint8)
    half = hog.resize(image, 32, 16)
    assert np.array_equal(hog.resize(image, 10, 9), hog.resize(half, 10, 9))
    assert np.array_equal(hog.resize(image, 16, 8), hog.resize(half, 16, 8))
    once = (np.arange(20, dtype=np.uint8) * 10).reshape(1, 20, 1).repeat(4, 0)
    assert hog.resize(once, 5, 4)[0, :, 0].tolist() == [15, 55, 95, 135, 175]  # the height can't be halved: one step, between the second and third of four pixels


def test_flat_cells_are_normalized_by_the_float_epsilon():
    image = np.full((24, 24, 1), 100, np.uint8)
    image[:, 12:] = 101
    assert hog.hog(image).max() > 0.15


def test_scores_of_a_mirrored_image_are_mirrored():
    rng = np.random.default_rng(8)
    coarse, fine = rng.normal(size=(9, 11, 32)), rng.normal(size=(18, 22, 32))
    root = models.Part(rng.normal(size=(3, 4, 32)), (0, 0))
    part = models.Part(rng.normal(size=(2, 3, 32)), (1, 2), (-0.5, 0.2, -0.4, 0.1))
    component = models.Component([root, part], 0.5)
    seen = models.mirrored(component, hog.MIRROR)
    plain = engine.component_scores({0: fine, 5: coarse}, component, 5)[5]
    other = engine.component_scores({0: hog.flip(fine), 5: hog.flip(coarse)}, seen, 5)[5]
    # Columns at which the root, and the part wherever it may go, lie within the level.
    assert np.allclose(plain[1:5, 2:6], other[1:5][:, [11 - 4 - x for x in range(2, 6)]], atol=1e-9)
    assert models.mirrored(seen, hog.MIRROR).parts[1].offset == part.offset


def test_background_of_no_levels(spark):
    none = spark.createDataFrame([], "rows int, cols int, channels int, data array<float>")
    b = engine.learn_background(none, most=2)
    assert b.mean.shape == (0,) and b.cov.shape == (len(b.offsets), 0, 0)
