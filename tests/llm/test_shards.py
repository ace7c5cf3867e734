import zlib

import numpy as np
import pytest

from tessera.llm import shards


def check(rows, texts, n_shards=24):
    """rows: doc_id, size, crc, number, shard, slot."""
    data = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts if d is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == data
    assert sorted(r.number for r in rows) == list(range(len(texts)))
    slots = [sorted(r.slot for r in rows if r.shard == s) for s in range(n_shards)]
    assert all(s == list(range(len(s))) for s in slots)
    sizes = [len(s) for s in slots]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    order = sorted(rows, key=lambda r: r.number)
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in order]
    assert keys == sorted(keys)
    for r in rows:  # shard and slot are known from the number, and the number from them
        p = r.slot * n_shards + r.shard
        assert shards.place(np.array([r.number]), len(texts))[0] == p and shards.number(np.array([p]), len(texts))[0] == r.number


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 23, 24, 25, 256, 257, 4097])
def test_place_is_a_permutation_and_number_its_inverse(n):
    p = shards.place(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n)) and (shards.number(p, n) == np.arange(n)).all()
    if n > 200:
        assert np.mean(np.abs(p - np.arange(n))) > n / 5 and (shards.place(np.arange(n), n, 1) != p).mean() > 0.9


def test_large_numbers():
    n = (1 << 61) + 12345
    at = np.array([0, 1, 1 << 40, n - 1])
    p = shards.place(at, n)
    assert (p >= 0).all() and (p < n).all() and (shards.number(p, n) == at).all()
    with pytest.raises(ValueError):
        shards.place(np.array([5]), 5)


def test_query(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    df = shards.query(spark, data)
    rows = df.collect()
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    check(rows, texts)


def test_query_equals_sql(same_rows):
    same_rows(shards.query, shards.sql())


def test_same_order_for_any_partitions(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    one = sorted(map(tuple, shards.shuffled(df).collect()))
    assert sorted(map(tuple, shards.shuffled(df.repartition(13, "text")).collect())) == one


def test_odd_texts_and_repeated_rows(odd, odd_texts):
    check(shards.shuffled(odd).collect(), odd_texts)
    more = odd
    for _ in range(4):
        more = more.union(more)
    check(shards.shuffled(more).collect(), odd_texts * 16)


def test_empty(empty):
    assert shards.shuffled(empty).count() == 0
