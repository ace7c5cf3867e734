import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid


def model(spark, data):
    return langid.fitted(spark.read.parquet(f"{data}/documents.parquet"))


def test_held_out_texts(spark, data):
    m = model(spark, data)
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang")
    got = {r.page_id: r.lang for r in langid.identify(held, m).collect()}
    assert np.mean([got[r.page_id] == r.lang for r in held.collect()]) > 0.98


def test_text_likelihood_by_hand(spark, data):
    m = model(spark, data)
    html = '<html lang="de"><script>x</script><body>nicht die und</body></html>'
    row = langid.evidence(spark.createDataFrame([(1, "http://A.b.de/x", html)], "page_id long, url string, html string"), m, "page_id", "url", "html").first()
    body = b"   nicht die und  "
    want = langid.TEMPER * m.weights[langid.trigrams(np.frombuffer(body, np.uint8))].sum(0)
    assert np.allclose(row.text, want) and (row.host, row.domain, row.suffix, row.declared) == ("a.b.de", "b.de", "de", "de")


def test_markup_and_host_decide_where_text_says_nothing(spark, data):
    m = model(spark, data)
    german = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'de'").limit(20).collect()
    english = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'").limit(40).collect()
    rows = [(i, "http://a.de/x", f'<html lang="de">{r.text}</html>') for i, r in enumerate(german)] + [(100 + i, "http://b.com/x", f'<html lang="en">{r.text}</html>') for i, r in enumerate(english)]
    rows += [(500, "http://a.de/y", "1 2 3"), (501, "http://b.com/y", None), (502, None, '<html lang="de">7</html>'), (None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("declared", F.lit("x"))
    got = {r.page_id: r for r in langid.identify(df, m).collect()}
    assert len(got) == len(rows) and got[500].lang == "de" and got[501].lang == "en" and got[502].lang == "de"
    assert all(0 < r.confidence <= 1 and math.isfinite(r.confidence) for r in got.values())


def test_empty(spark, data):
    m = model(spark, data)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(pages, m).count() == 0
    none = langid.fitted(spark.createDataFrame([], "doc_id long, text string, lang string"))
    one = spark.createDataFrame([(1, "http://x/", "a")], "page_id long, url string, html string")
    assert langid.identify(one, none).first().lang is None


_MARKUP = re.compile(rb"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;")
_DECLARED = re.compile(rb"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)")


def test_markup_goes_as_by_an_expression():
    rng = random.Random(1)
    parts = [b"<", b">", b"<script", b"</script>", b"<SCRIPT a>", b"<style>", b"</style>", b"<!--", b"-->", b"&amp;", b"&#12;", b"&", b";", b"a", b" ", b"<html ", b"lang=", b"lang='EN'", b"<html>", b"<scripty>", "ü".encode()]
    for _ in range(5000):
        page = b"".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        said = _DECLARED.search(page)
        assert langid.visible(page) == _MARKUP.sub(b" ", page) and langid.declared(page) == (said[1].decode().lower() if said else "")


@pytest.mark.parametrize("unit", [b"<", b"<script ", b"<!--", b"&", b"&a", b"<html ", b"<html lang", b"<style>x", b"<a>&amp;"])
def test_pages_of_open_marks_take_no_longer_than_their_length(unit):
    began = time.time()
    page = unit * (1_000_000 // len(unit))
    langid.visible(page)
    langid.declared(page)
    assert time.time() - began < 10
