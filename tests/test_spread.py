"""Suppression by rounds, boxes of very different sizes, files of mixed images."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import detect
from tessera.sources import repositories


def boxes(spark, seed, n=150, size=40):
    rng = random.Random(seed)
    rows = [(i % 3, i, float(rng.randrange(12)), rng.randrange(120), rng.randrange(120), rng.randrange(size), rng.randrange(size)) for i in range(n)]
    return spark.createDataFrame(rows, "image long, id long, score double, x long, y long, w long, h long")


@pytest.mark.parametrize("overlap", [0.2, 0.5, 1.0])
def test_suppression_by_rounds_equals_greedy(spark, overlap):
    df = boxes(spark, int(overlap * 10))
    wanted = sorted(map(tuple, detect.suppress(df, ["image"], "id", overlap).collect()))
    assert sorted(map(tuple, detect.suppress_spread(df, ["image"], "id", overlap, tile=16).collect())) == wanted
    assert detect.suppress_spread(df.limit(0), ["image"], "id", overlap).count() == 0


def test_boxes_of_very_different_sizes_meet_once(spark):
    rng = random.Random(4)
    rows = [(0, i, 1.0, rng.randrange(-2000, 2000), rng.randrange(-2000, 2000), int(2 ** rng.uniform(0, 13)), int(2 ** rng.uniform(0, 13))) for i in range(80)]
    rows += [(0, 900, 1.0, -(10**6), -(10**6), 3 * 10**6, 3 * 10**6), (0, 901, 1.0, 5, 5, 10**6, 1)]
    df = spark.createDataFrame(rows, "image long, id long, score double, x long, y long, w long, h long")
    a, b = (df.select("image", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y", "w", "h"))) for s in "ab")
    levels = detect.levels_of(df)
    assert levels == 7
    got = sorted((r.a_id, r.b_id, r.inter) for r in detect.touching(a, b, ["image"], 64, levels).collect())

    def common(p, q):
        return max(0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])) * max(0, min(p[4] + p[6], q[4] + q[6]) - max(p[4], q[4]))

    assert got == sorted((p[1], q[1], common(p, q)) for p in rows for q in rows if common(p, q) > 0)


def test_mixed_images_are_written(spark, tmp_path):
    rows = [("ab"[i % 2] if i < 6 else "a", i, f"s/{i}", bytearray([i] * 6), 2, 3, 1) for i in range(9)] + [("b", 20, "none", None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "g string, id long, stem string, content binary, height int, width int, depth int")
    told = sorted(map(tuple, repositories.export_mixed(df, str(tmp_path / "out"), "g", "id", 1).collect()))
    order = [0, 1, 2, 3, 4, 5, 6, None, 7, 8]  # a and b in turn; that of no content has its place, but no file
    assert [(p, n.split("_")[-1]) for p, n, _ in told] == [(p, f"{i}.pgm") for p, i in enumerate(order) if i is not None]
    for _, name, size in told:
        data = (tmp_path / "out" / name).read_bytes()
        assert len(data) == size and data == b"P5\n3 2\n255\n" + bytes([int(name.split("_")[-1][:-4])] * 6)
    assert len(list((tmp_path / "out").iterdir())) == 9
    first = repositories.export_mixed(df.drop("height", "width", "depth"), str(tmp_path / "some"), "g", "id", 2, 3).collect()
    assert sorted(r.name for r in first) == ["00000000_s_0.jpg", "00000001_s_2.jpg", "00000002_s_1.jpg"]
