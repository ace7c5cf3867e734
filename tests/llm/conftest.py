import hashlib
import re

import pytest


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, one word, ties, repeats, copies, a very long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    base = " ".join(f"b{i}" for i in range(60))
    return [(1, base), (2, "x " + base + " y"), (3, None), (4, ""), (5, "one"), (6, " \t\n "), (7, base), (8, base.upper()), (9, long), (10, long + " tail"), (11, "é ü ß 日本 😀 " * 20), (None, base), (1, base), (-4, "b1 b2 b3"), (12, "b3 b4 b5 b6"), (13, "q " * 40)]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The same as a table with columns whose names clash with those of results."""
    rows = [(d, t, "en", "src", 1, "n", 2, True) for d, t in odd_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id int, kept boolean")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def sha(data):
    return hashlib.sha256(data).hexdigest()
