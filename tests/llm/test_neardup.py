import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.components import components
from tests.llm import brute


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_table_equals_brute_force(spark, data, percent):
    df = spark.read.parquet(f"{data}/documents.parquet")
    assert rows_of(neardup.near_duplicates(df, percent=percent)) == brute.near_duplicates([(r.doc_id, r.text) for r in df.collect()], percent)


def test_odd_texts(odd, odd_texts):
    assert rows_of(neardup.near_duplicates(odd, percent=80)) == brute.near_duplicates(odd_texts, 80)


def test_empty(empty):
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.distinct_documents(empty).columns == empty.columns


def test_chains_and_groups(spark):
    """Copies of a text that drift apart: neighbours are linked, distant ones are not."""
    rng = random.Random(5)
    rows, text = [], [f"v{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(60):
        rows.append((rng.randrange(10**9), " ".join(text)))
        for _ in range(rng.choice([1, 1, 2, 5])):
            text[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(df, percent=85)) == brute.near_duplicates(rows, 85)


def test_rows_that_stay(odd):
    out = neardup.distinct_documents(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [-4, 1, 3, 4, 5, 6, 9, 11, 12, 13]


def test_likelihood_prunes_far_pairs_only():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)

    def sketch(a, b):
        return neardup.registers(neardup.minima(pool[a:b]))[None, :]

    n = np.array([400.0])
    assert neardup.likely(sketch(0, 400), sketch(20, 420), n, n, 0.85)[0]
    assert not neardup.likely(sketch(0, 400), sketch(200, 600), n, n, 0.85)[0]


def test_sketches_merge():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 300), dtype=np.uint64)
    whole = neardup.registers(neardup.minima(np.concatenate([a, b])))
    parts = np.maximum(neardup.registers(neardup.minima(a)), neardup.registers(neardup.minima(b)))
    assert (whole == parts).all()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 120)]
    star = [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 121), 1), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_cover_all_pairs_across(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(i % 7):
            text[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    assert rows_of(neardup.near_duplicates(df, percent=85)) == brute.near_duplicates(rows, 85)


def test_dealt_rows_of_a_mixed_bucket(spark):
    """5,000 members: one component of 4,990 and ten of one each. Members of the large one go to one group only."""
    rows = [(7, i, 1 if i < 4990 else i) for i in range(1, 5001)]
    got = neardup.dealt(spark.createDataFrame(rows, "bucket long, doc_id long, component long")).collect()
    units = -(-4989 // neardup.BLOCK)
    small = 11
    assert sum(r.component == 1 for r in got) == 4989
    assert sum(r.component != 1 for r in got) == small * (units + 1)
    met = {}
    for r in got:
        met.setdefault((r.ic, r.ib, r.jc, r.jb), []).append(r)
    pairs = {(a.doc_id, b.doc_id) for g in met.values() for a in g for b in g if a.component != b.component and (a.ic == a.jc and a.ib == a.jb or a.mine != b.mine)}
    assert len(pairs) == 2 * 4989 * small + small * (small - 1)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_weak_hashes_take_for_equal(spark, n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, f"{one} x y z u"), (2, f"{two} x y z u"), (3, f"{two} x y z u"), (4, one), (5, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(neardup.near_duplicates(df, percent=80)) == brute.near_duplicates(rows, 80)


def test_users_columns_of_any_name_stay(odd):
    df = odd.withColumnsRenamed({"n_words": "_gone", "component_id": "_many"}).withColumn("gone", F.lit(1)).withColumn("many", F.lit(2)).withColumn("count", F.lit(3))
    out = neardup.distinct_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [-4, 1, 3, 4, 5, 6, 9, 11, 12, 13]


@pytest.mark.parametrize("turn", [False, True])
def test_ids_that_repeat_with_different_texts(spark, turn):
    w, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(1, w), *([(2, w + " x"), (2, v)] if turn else [(2, v), (2, w + " x")]), (3, v + " y"), (3, None), (4, ""), (4, "z"), (5, v)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(neardup.near_duplicates(df, percent=85))
    assert got == brute.near_duplicates(rows, 85) and {r[2] for r in got if r[0] != 4} == {1}


def test_random_ids_that_repeat(spark):
    rng = random.Random(11)
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(12)]
    rows = [(rng.choice([None, *range(8)]), rng.choice([None, *texts]) or None) for _ in range(30)]
    rows = [(d, t and t + rng.choice(["", " x", " y"])) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(neardup.near_duplicates(df, percent=85)) == brute.near_duplicates(rows, 85)
