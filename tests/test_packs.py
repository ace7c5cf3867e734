"""Crops of images of many boxes: no row that a task works on has all of them, and each box is cut out of its image once."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tessera.operators import hog, learner

BOXES = 60


@pytest.fixture
def few(spark, monkeypatch):
    """Packs of 7 boxes, Arrow batches of 16 rows, ranges that stay apart; the tables that go to Python workers, as they come."""
    monkeypatch.setattr(learner, "PACK", 7, raising=False)
    given = []
    kind = type(spark.range(1))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(kind, name, lambda df, *a, _run=getattr(kind, name), **k: (given.append(df), _run(df, *a, **k))[1])
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield given
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("fitted", [False, True])
def test_no_row_has_all_boxes_of_an_image(spark, few, fitted):
    rng = np.random.default_rng(7)
    images = [("a", rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)), ("b", rng.integers(0, 256, (9, 9, 1), dtype=np.uint8)), ("b", rng.integers(0, 256, (8, 12, 1), dtype=np.uint8)), ("none", None), (None, np.zeros((5, 5, 1), np.uint8))]
    boxes = [(str(rng.choice(["a", "b"], p=[0.9, 0.1])), int(i), *map(int, rng.integers(-4, 25, 2)), *map(int, rng.integers(0, 9, 2))) for i in range(BOXES)]
    boxes += [boxes[3], ("a", None, 1, 2, 3, 4), (None, 900, 0, 0, 2, 2), ("none", 901, 0, 0, 2, 2), ("other", 902, 0, 0, 2, 2)]
    df = spark.createDataFrame(boxes, "id string, box_id long, x long, y long, w long, h long")
    df = df.withColumn("to_w", F.lit(6)).withColumn("to_h", F.lit(4)) if fitted else df
    table = spark.createDataFrame([(k, *(i.shape if i is not None else (1, 1, 1)), bytearray(i.tobytes()) if i is not None else None) for k, i in images], "id string, height int, width int, depth int, data binary")
    wanted = []
    for name, box, x, y, w, h in boxes:
        for key, image in images:
            if key == name is not None and image is not None and w > 0 and h > 0:
                part = hog.crop(image, x, y, w, h, padded=fitted)
                if part.size:
                    part = hog.resize(part, 6, 4) if fitted else part
                    wanted.append((name, -1 if box is None else box, *part.shape, part.tobytes()))
    found = learner.crops(table, df, "id")
    got = [(r.id, -1 if r.box_id is None else r.box_id, r.height, r.width, r.depth, bytes(r.data)) for r in found.collect()]
    assert sorted(got) == sorted(wanted) and len(wanted) > BOXES / 2
    lists = [(t, f.name) for t in few for f in t.schema.fields if isinstance(f.dataType, ArrayType)]
    assert lists and max(t.agg(F.max(F.size(c))).first()[0] for t, c in lists) <= 7
    # Boxes of one image come from several tasks.
    assert few[0].where("id = 'a'").select(F.spark_partition_id()).distinct().count() > 1
