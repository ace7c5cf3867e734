import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import repeats
from tests.llm import brute


def test_table_equals_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    wanted = brute.repeats([(r.doc_id, r.text) for r in df.collect()])
    found = repeats.repeated(df)
    got = repeats.cut(df.select("doc_id", "text"), found, always=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == sorted(wanted)


def test_odd_texts(odd, odd_texts):
    found = repeats.repeated(odd)
    got = repeats.cut(odd.select("doc_id", "text"), found, always=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=repr) == sorted(brute.repeats(odd_texts), key=repr)


def test_stage_keeps_rows_columns_and_untouched_texts(odd, odd_texts):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(odd_texts)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[6] == " \t\n " and texts[3] is None and texts[2] == "x y" and texts[7] == ""


def test_empty(empty):
    assert repeats.without_repeats(empty).count() == 0


def cut_rows(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in repeats.cut(df, repeats.repeated(df), always=True).collect())


@pytest.mark.parametrize("group", [0, 5, 4096])
def test_parts_larger_than_a_task_may_hold(spark, monkeypatch, group):
    """Shared passages of several lengths, on both sides of the size at which prefixes are made longer."""
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(group)
    shared = [" ".join(f"s{i}_{k}" for k in range(n)) for i, n in enumerate((12, 13, 14, 30, 80))]
    rows = []
    for i in range(60):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30)))]
        for _ in range(3):
            parts += [rng.choice(shared), " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(9)))]
        rows.append((rng.randrange(100), " ".join(parts)))
    assert cut_rows(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute.repeats(rows))


def test_one_id_with_many_texts(spark):
    base = " ".join(f"b{i}" for i in range(40))
    rows = [(7, f"{base} end{i}") for i in range(30)] + [(3, base), (9, base + " end1"), (9, "x " + base)]
    assert cut_rows(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute.repeats(rows))


def test_ranks_are_those_of_sorted_words():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 3, 5, 13):
        of = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        assert repeats.ranked(words, n).tolist() == [sorted(set(of)).index(x) for x in of]


def test_maximal_passages(spark):
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(1, base), (2, "x y " + base + " z"), (3, "b20 " + " ".join(f"b{i}" for i in range(30, 50)) + " q"), (4, None), (None, base)]
    got = {tuple(r) for r in repeats.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 2, 60, base), (3, 1, 20, " ".join(f"b{i}" for i in range(30, 50)))}


def test_users_columns_of_any_name_stay(odd, odd_texts):
    df = odd.withColumn("_n_words", F.lit("mine")).withColumn("_n_removed", F.lit(1)).withColumn("row", F.lit(2)).withColumn("_row", F.lit(3))
    out = repeats.without_repeats(df)
    assert out.columns == df.columns and out.where("_n_words = 'mine' AND n_words = 'n' AND row = 2 AND _row = 3").count() == len(odd_texts)


def thue_morse(n):
    """Two words of n bytes that polynomials modulo powers of two cannot tell apart from 1024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_weak_hashes_take_for_equal(spark, n):
    one, two = thue_morse(n)
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{two} {tail}")]
    assert cut_rows(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute.repeats(rows))
