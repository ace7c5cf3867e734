import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import periods
from tests.llm.conftest import sha, words


def brute_runs(w, least=24, k=3):
    """Maximal stretches of each period, the least period of each."""
    known = {}
    n, found, w = len(w), {}, np.array([known.setdefault(x, len(known)) for x in w])
    for q in range(1, n // k + 1):
        wrong = np.concatenate([[-1], np.flatnonzero(w[:-q] != w[q:]), [n - q]])
        for j in np.flatnonzero(np.diff(wrong) > 1).tolist():
            a, b = int(wrong[j]) + 1, int(wrong[j + 1]) + q
            if b - a >= max(least, k * q):
                found.setdefault((a, b), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_plant(d, w):
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def brute_row(d, t):
    w = brute_plant(d, words(t))
    found = brute_runs(w)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * top[1] // top[2] if found else None
    return (d, len(found), *top, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(collapse(w, found)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = rows_of(periods.query(spark, data))
    assert got == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) >= 10


def test_odd_texts(odd, odd_texts):
    got = rows_of(periods.periodic_runs(odd))
    wanted = []
    for d, t in odd_texts:
        w = words(t)
        found = brute_runs(w)
        wanted.append((d, found, collapse(w, found).decode()))
    assert [(d, [tuple(r) for r in runs], t) for d, runs, t in got] == sorted(wanted, key=repr)


def test_empty(spark, empty):
    assert periods.periodic_runs(empty).count() == 0


def numbers(texts):
    """Texts of small numbers as one array of hashes, and where each begins."""
    rows = np.cumsum([0, *map(len, texts)])
    return np.array([x * 0x9E3779B97F4A7C15 % 2**64 for t in texts for x in t], np.uint64), rows


@pytest.mark.parametrize(("least", "k"), [(24, 3), (2, 2), (7, 4), (30, 2)])
@pytest.mark.parametrize("block", [7, 1 << 18])
def test_random_sequences(monkeypatch, least, k, block):
    monkeypatch.setattr(periods, "BLOCK", block)
    rng = random.Random(least * k)
    texts = []
    for i in range(60):
        t = []
        while len(t) < rng.randrange(150):
            part = [rng.randrange(2 + i % 3) for _ in range(rng.randrange(1, 12))]
            t += part * rng.randrange(1, 9)
        texts.append(t)
    data, rows = numbers(texts)
    begin, end, q = periods.find(data, rows, least, k)
    of = np.searchsorted(rows, begin, "right") - 1
    got = [[] for _ in texts]
    for b, e, p, i in zip(begin.tolist(), end.tolist(), q.tolist(), of.tolist(), strict=True):
        got[i].append((b - int(rows[i]), e - b, p))
    assert got == [brute_runs(t, least, k) for t in texts]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("text", [[0] * 2000, [0, 1] * 900 + [2] + [0, 1] * 100, fibonacci(1500), [bin(i).count("1") & 1 for i in range(1500)]], ids=["one", "two", "fibonacci", "thue-morse"])
def test_repetitive_sequences(text):
    data, rows = numbers([text])
    begin, end, q = periods.find(data, rows)
    assert list(zip(begin.tolist(), (end - begin).tolist(), q.tolist(), strict=True)) == brute_runs(text)


def test_wrong_hashes_are_found_out(monkeypatch):
    """With hashes that are always equal, words decide."""
    monkeypatch.setattr(periods.Prefixes, "same", lambda self, at, gap, size: np.ones(len(at), bool))
    text = [5, 6] + [1, 2, 3] * 12 + [1, 4] + [7] * 30
    data, rows = numbers([text])
    begin, end, q = periods.find(data, rows)
    assert list(zip(begin.tolist(), (end - begin).tolist(), q.tolist(), strict=True)) == brute_runs(text)


def test_products_modulo_the_prime():
    rng = np.random.default_rng(1)
    a = np.append(rng.integers(0, periods._P, 1000, np.uint64), np.array([0, 1, periods._P - 1], np.uint64))
    b = a[::-1].copy()
    assert periods.times(a, b).tolist() == [int(x) * int(y) % periods._P for x, y in zip(a, b, strict=True)]
    assert periods._POWERS.get(40)[39] == pow(periods._BASE, 39, periods._P)
    p = periods.Prefixes(a)
    assert int(p.sums[-1]) == sum(int(x) * pow(periods._BASE, i, periods._P) for i, x in enumerate(a.tolist())) % periods._P


@pytest.mark.parametrize("unit", ["a ", "a b c ", "a " * 1000 + "b "])
def test_long_repetition_takes_no_longer_than_its_length(spark, unit):
    text = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = periods.periodic_runs(df).collect()
    assert time.time() - began < 60
    n, q = len(text.split()), len(unit.split())
    assert (0, n, q) in [tuple(r) for r in row.runs]
    assert len(row.text.split()) < n / 2
