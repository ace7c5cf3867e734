import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam
from tests.llm import brute
from tests.llm.conftest import alnum


def digest(told):
    items = F.sort_array(F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string"))))
    return sorted((tuple(r) for r in told.select("doc_id", "n_words", "n_hit", F.size(items), F.sha2(F.array_join(items, ",").cast("binary"), 256), F.col("n_hit") > 0).collect()), key=repr)


def test_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in decontam.query(spark, data).collect()), key=repr) == brute.contamination(docs, items)


ITEMS = [(7, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11 b12"), (8, "ONE"), (9, "B3, b4"), (None, "q q q q q q q q q q q"), (10, None), (11, "?!"), (7, "b3 b4"), (12, "ü ß 日本")]


def test_odd_texts_in_one_slice_and_in_many(spark, odd, odd_texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1 << 20, 1):
        assert digest(decontam.contamination(odd, items, limit=limit)) == brute.contamination(odd_texts, ITEMS)


def test_longest_match_and_its_place(spark):
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"b{i}" for i in range(3, 20)) + " z")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(f"b{i}" for i in range(18)))], "item_id long, text string")
    (m,) = decontam.contamination(docs, items).first().matches
    assert tuple(m) == (5, 3, 2, 15)


def test_clean_documents_stay_with_all_columns(spark, odd, odd_texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.clean(odd, items)
    assert out.columns == odd.columns
    wanted = [r[0] for r in brute.contamination(odd_texts, ITEMS) if not r[5]]
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(wanted, key=repr)


def test_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(odd, none).count() == odd.count()
    assert decontam.clean(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def brute_longest(rows, items, window=10):
    """Of each document and item with hits: words, first words in document and item of the longest match."""
    out = {}
    for d, t in rows:
        w = alnum(t)
        for i, text in items:
            v, best = alnum(text), None
            least = min(window, len(v))
            for p in range(len(w)):
                for q in range(len(v)):
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= least > 0 and (best is None or -n < best[0]) and (len(v) >= window or n == len(v)):
                        best = (-n, p, q)
            if best:
                out[d, i] = (-best[0], best[1], best[2])
    return out


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
@pytest.mark.parametrize("block", [3, 1 << 18])
def test_longest_matches_equal_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    rng = random.Random(limit)
    unit = ["a b", "a", "a a b", "c d e f g h i j k l m", "x"]
    docs = [(i, " ".join(rng.choice(unit) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    items = [(100 + i, " ".join(rng.choice(unit) for _ in range(rng.randrange(1, 14)))) for i in range(9)]
    told = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    got = {(r.doc_id, m.item_id): (m.n_words, m.doc_word, m.item_word) for r in told.collect() for m in r.matches}
    assert got == brute_longest(docs, items)
    assert digest(told) == brute.contamination(docs, items)


def test_repetitive_texts_take_no_longer_than_their_length():
    index = decontam.Slice([(1, "a " * 2000), (2, "a b " * 500)], 10)
    for text in ("a " * 500_000, "a b " * 250_000):
        (words,) = decontam.runs(pa.array([text]), decontam.ALNUM, lower=True, run_bytes=1 << 40)
        began = time.time()
        kind, word = index.hits(words)
        doc, item, at, item_at, n = index.longest(words, kind, word)
        assert time.time() - began < 20
        assert sorted(zip(item.tolist(), n.tolist(), strict=True)) == ([(0, 2000)] if text[2] == "a" else [(1, 1000)])
        assert len(kind) < 1_500_000
