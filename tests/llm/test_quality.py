import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    low = [got[r.doc_id] for r in labels if r.quality == 0]
    toxic = [got[r.doc_id] for r in labels if r.toxic == 1]
    clean = [got[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    assert len(got) == 1000
    assert np.mean([not r.kept for r in low]) > 0.95
    assert np.mean([not r.kept for r in toxic]) > 0.7
    assert np.mean([r.kept for r in clean]) > 0.97


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled rows, judged on the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.kept for r in quality.classify(docs, half).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([not got[r.doc_id] for r in rest if r.quality == 0]) > 0.97
    assert np.mean([not got[r.doc_id] for r in rest if r.toxic == 1]) > 0.9
    assert np.mean([got[r.doc_id] for r in rest if r.quality == 1 and r.toxic == 0]) > 0.98


def test_odd_texts_and_no_labels(spark, odd, odd_texts, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, None), (9, 1, 0), (None, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, none).where("kept").count() == len(odd_texts)
    assert quality.classify(odd, some).count() == len(odd_texts)
    assert quality.good(odd, some).columns == odd.columns
    assert quality.good(empty, some).count() == 0


def test_sparse_sites_are_drawn_to_the_rate_of_all(spark):
    rows = [(i, ("GOOD!! BAD!! " * 20) if i % 2 and i < 600 else "plain words are here " * 10, "en", "big" if i < 600 else f"small{i}") for i in range(620)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0 if i % 2 and i < 600 else 1, 0) for i in range(620)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    overall = np.mean([r.low for r in got.values()])
    assert abs(got[610].low_site - overall) < 0.2
    assert not got[1].kept and got[0].kept and got[610].kept


def test_sample_is_of_labelled_documents_that_are_there_and_has_both_values(spark):
    """Labels of 2,000 ids without documents, one toxic document in 300, and an id that repeats."""
    rows = [(i, "vile words here " * 9 if i == 299 else "BAD!! " * 20 if i % 2 else "plain words are here " * 9) for i in range(300)]
    docs = spark.createDataFrame([*rows, *[(0, f"again {i}") for i in range(50)]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 2 and i != 299 else 1, int(i == 299)) for i in range(2300)], "doc_id long, quality int, toxic int")
    models = quality.fitted(docs, labels.where("doc_id < 300 OR doc_id % 2 = 0"), 40)
    assert models["low"] is not None and models["toxic"] is not None


def test_scores_and_weights_equal_those_of_whole_rows():
    """Markers as pairs and conjugate gradients against dense rows and a solved matrix."""
    rng = np.random.default_rng(3)
    n, k = 300, 40
    dense = (rng.random((n, k)) < 0.1).astype(float)
    rows, marks = np.nonzero(dense)
    shapes = rng.normal(size=(n, 3))
    y = (dense[:, 0] + shapes[:, 0] + rng.normal(size=n) > 0.5).astype(float)
    x = np.concatenate([dense, shapes, np.ones((n, 1))], 1)
    ridge, w = np.full(k + 4, 0.1), np.zeros(k + 4)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    got = quality._solved(rows, marks, shapes, k, y)
    assert np.allclose(got, w, atol=1e-8) and np.allclose(quality._scores(rows, marks, shapes, got), x @ w, atol=1e-7)


def test_texts_of_the_fit_stay_off_the_driver(spark):
    """12 MB of labelled texts are counted and marked in tasks; the driver's Python holds markers, shapes and places only."""
    words = F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda x: F.concat(F.lit("word"), F.col("doc_id") * 1500 + x))
    docs = spark.range(800).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "mark"), words).alias("text"))
    labels = spark.range(800).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert docs.agg(F.sum(F.length("text"))).first()[0] > 10 << 20
    tracemalloc.start()
    try:
        models = quality.fitted(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert models["toxic"] is None and len(models["low"].markers) == 1 and peak < 8 << 20
