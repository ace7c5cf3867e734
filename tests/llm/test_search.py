import math
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import search
from tests.llm.conftest import alnum


def brute(docs, items, top=10):
    bags = [(d, Counter(alnum(t))) for d, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (d, bag), n in zip(bags, sizes, strict=True):
            s = 0
            for term, times in Counter(alnum(text)).items():
                if tf := bag[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    s += times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total)))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def ranked(docs, items, **options):
    shard_bytes = options.pop("shard_bytes", search.SHARD_BYTES)
    index, n, _ = search.build_index(docs, shard_bytes=shard_bytes)
    out = search.search(index, n, items, **options)
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_equals_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in search.query(spark, data).collect()), key=repr) == brute(docs, items)


def test_query_equals_sql(same_rows):
    same_rows(search.query, search.sql())


ITEMS = [(1, "b1 b2 B3 b3"), (2, None), (3, ""), (4, "none of these"), (5, "Q q ONE"), (5, "ü ß 日本"), (None, "w1x1 b59"), (6, "b1 " * 50)]


@pytest.mark.parametrize("shard_bytes", [1, 2000, 4 << 20])
@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_odd_texts(spark, odd, odd_texts, shard_bytes, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(odd, items, shard_bytes=shard_bytes, limit=limit) == brute(odd_texts, ITEMS)


def test_ties_across_shards_go_by_id(spark):
    rows = [((i * 37) % 101, "same words here") for i in range(101)] + [(200, "other"), (None, "same words here")]
    items = [(1, "words"), (2, "same here same")]
    for shard_bytes in (1, 64, 1 << 20):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        got = ranked(docs, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard_bytes, top=4)
        assert got == brute(rows, items, 4) and [r[2] for r in got] == [0, 1, 2, 3] * 2


def test_a_row_group_of_the_index_is_one_shard(odd):
    """However many shards a task writes: a reader makes arrays of a whole row group at once."""
    index, _, _ = search.build_index(odd.coalesce(1), shard_bytes=1)
    files = [pq.read_metadata(urlparse(f).path) for f in index.inputFiles()]
    rows = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(files) == 1 and rows == [1] * index.count() and len(rows) > 9


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(empty, items) == [] and ranked(odd, items.limit(0)) == []


def test_selection_takes_all_ties():
    rng = np.random.default_rng(3)
    for n in (0, 1, 9, 10, 11, 500):
        score, ids = rng.integers(0, 4, n), rng.permutation(n)
        absent = rng.random(n) < 0.2
        wanted = sorted(np.flatnonzero(score > 0).tolist(), key=lambda i: (-score[i], absent[i], ids[i]))[:10]
        assert search.best(score, ids, absent, 10).tolist() == wanted


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9, 10**12])
    assert search.lengths(n, 10**10, 10**14).tolist() == [25 + 75 * x * 10**10 // 10**14 for x in n.tolist()]
