"""The fusion of evidence in operators 9 and 10 against loops over small tables, given the fitted models' evidence."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, langid, quality
from tessera.llm.words import ALNUM, runs
from tests.llm import brute


def softmax(logs):
    top = max(logs)
    scaled = [math.exp(x - top) for x in logs]
    return [x / sum(scaled) for x in scaled]


def languages(rows, langs):
    """page_id, language, confidence and the language of the host, as the docstring of the operator says."""
    k = range(len(langs))
    soft = [softmax(r[5]) for r in rows]

    def sums(key):
        out = {}
        for r, s in zip(rows, soft, strict=True):
            total, n = out.get(key(r), ([0.0] * len(langs), 0))
            out[key(r)] = [total[i] + s[i] for i in k], n + 1
        return out

    hosts, domains, suffixes, said, (every,) = sums(lambda r: r[1:4]), sums(lambda r: r[1:3]), sums(lambda r: r[1]), sums(lambda r: r[4]), sums(lambda r: 0).values()
    out = []
    for r, s in zip(rows, soft, strict=True):
        prior = [(every[0][i] + 1) / (every[1] + len(langs)) for i in k]
        for total, n in (suffixes[r[1]], domains[r[1:3]]):
            prior = [(total[i] + langid.PRIOR * prior[i]) / (n + langid.PRIOR) for i in k]
        total, n = hosts[r[1:4]]
        rest = [(total[i] - s[i] + langid.PRIOR * prior[i]) / (n - 1 + langid.PRIOR) for i in k]
        markup = [math.log((said[r[4]][0][i] + (langid.DECLARED if r[4] == langs[i] else langid.DECLARED / 100)) / (every[0][i] + langid.DECLARED)) if r[4] else 0.0 for i in k]
        posterior = softmax([r[5][i] + math.log(rest[i]) + markup[i] for i in k])
        out.append((r[0], langs[posterior.index(max(posterior))], max(posterior), langs[rest.index(max(rest))]))
    return out


def test_languages_by_loops(spark):
    rng = random.Random(9)
    langs = ["de", "en", "fr"]
    rows = []
    for i in range(300):
        suffix = rng.choice(["de", "com", ""])
        domain = f"{rng.choice('ab')}.{suffix}" if suffix else ""
        host = "hot.a.com" if i % 3 == 0 else rng.choice(["", "www."]) + domain
        suffix, domain = ("com", "a.com") if i % 3 == 0 else (suffix, domain)
        rows.append((i, suffix, domain, host, rng.choice(["", "de", "en", "xx"]), [rng.choice([0.0, rng.uniform(-3, 3)]) for _ in langs]))
    rows += [rows[5], (None, *rows[6][1:]), (400, "", "", "", "", [0.0, 0.0, 0.0])]  # a repeated row, a null id, nothing known at all
    df = spark.createDataFrame(rows, "page_id long, suffix string, domain string, host string, declared string, text array<double>")
    got = sorted(((r.page_id, r.lang, r.confidence, r.host_lang) for r in langid.fused(df, langs).collect()), key=repr)
    for one, two in zip(got, sorted(languages(rows, langs), key=repr), strict=True):
        assert one[0] == two[0] and one[1] == two[1] and one[2] == pytest.approx(two[2], abs=2e-6) and one[3] == two[3]


def test_long_pages_are_weighed_whole_and_in_steps(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEP", 7)
    model = langid.fit(["der die das und ist nicht", "the and is not of to"], ["de", "en"])
    text = " the and of" * 500
    df = spark.createDataFrame([(1, None, text), (2, None, None), (3, None, ""), (1, None, text)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in langid.evidence(df, model, "page_id", "url", "html").collect())
    import numpy as np

    want = langid.TEMPER * model.weights[langid.trigrams(np.frombuffer(text.encode(), np.uint8))].sum(0)
    assert np.allclose(got[0][1], want) and got[0] == got[1] and got[2][1] == [0, 0] and got[3][1] == [0, 0]


def weight(groups, level, n, var):
    """Method of moments: groups are (sum, number, rate of the level above)."""
    q = sum((s - r * m) ** 2 / m for s, m, r in groups if m)
    extra = (q - sum(1 for _, m, _ in groups if m) * var / n) / n if n else 0
    return min(max(var / n / extra - 1, quality.LEAST), quality.MOST) if extra > 0 else quality.MOST


def posteriors(rows, odds_at):
    """The posterior of one label and that of the site for each row: host, path and odds."""
    ps = [None if r[odds_at] is None else 1 / (1 + math.exp(-r[odds_at])) for r in rows]

    def sums(key):
        out = {}
        for r, p in zip(rows, ps, strict=True):
            s, n = out.get(key(r), (0.0, 0))
            out[key(r)] = (s + (p or 0), n + (p is not None))
        return out

    hosts, paths, ((total, n),) = sums(lambda r: r[2]), sums(lambda r: r[2:4]), sums(lambda r: 0).values()
    rate = min(max(total / max(n, 1), 1e-4), 1 - 1e-4)
    by_host = weight([(s, m, rate) for s, m in hosts.values()], "host", n, n * rate * (1 - rate))
    mean = {h: s / m for h, (s, m) in hosts.items() if m}
    by_path = weight([(s, m, mean.get(k[0])) for k, (s, m) in paths.items()], "path", n, sum(m * mean[k[0]] * (1 - mean[k[0]]) for k, (_, m) in paths.items() if m))

    def logit(p):
        return math.log(p / (1 - p))

    out = []
    for r, p in zip(rows, ps, strict=True):
        own, one = p or 0, p is not None
        above = (hosts[r[2]][0] - own + by_host * rate) / (hosts[r[2]][1] - one + by_host)
        site = (paths[r[2:4]][0] - own + by_path * above) / (paths[r[2:4]][1] - one + by_path)
        odds = (logit(rate) if r[odds_at] is None else r[odds_at]) + quality.SITE_WEIGHT * (logit(site) - logit(rate))
        out.append((1 / (1 + math.exp(-odds)), site))
    return out


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_quality_by_loops(spark, monkeypatch, spread):
    monkeypatch.setattr(quality, "LEAST", 0.5)
    rng = random.Random(10)
    bad = {h: rng.gauss(0, spread) for h in "abcdef"}
    rows = []
    for i in range(400):
        host = rng.choice(["hot", "hot", *"abcdef"])
        path = rng.choice(["", "x", "y"])
        rows.append((i, i * 7, host, path, rng.gauss(-1 + bad.get(host, 0) + (2 if path == "x" else 0), 1), None if i % 11 == 0 else rng.gauss(-3, 2)))
    rows += [rows[3], (None, None, "", "", None, None), (999, 1, "lone", "", 5.0, -5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, host string, path string, low_odds double, toxic_odds double")
    got = sorted(((r.doc_id, r.low, r.low_site, r.toxic, r.toxic_site, r.kept) for r in quality.fused(df, {"low": True, "toxic": True}).collect()), key=repr)
    want = sorted(((r[0], *low, *toxic, low[0] < quality.THRESHOLD and toxic[0] < quality.THRESHOLD) for r, low, toxic in zip(rows, posteriors(rows, 4), posteriors(rows, 5), strict=True)), key=lambda x: repr(x[0]))
    got.sort(key=lambda x: repr(x[0]))
    assert len({x[5] for x in got}) == 2
    for one, two in zip(got, want, strict=True):
        assert one[0] == two[0] and one[5] == two[5] and one[1:5] == pytest.approx(two[1:5], abs=2e-6)


def test_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "BAD!! " * 50 if i % 2 else "plain words " * 20) for i in range(40)] + [(100, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 ^ 1, 0) for i in range(40)] + [(100, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fitted(docs, labels, 100, 20_000)["low"] is not None
    assert quality.fitted(docs, labels, 100, 10) == {"low": None, "toxic": None}


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_benchmark_words_that_weak_hashes_take_for_equal(spark, n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    tail = " ".join(f"t{i}" for i in range(9))
    rows, items = [(1, f"{one} {tail}"), (2, f"x {two} {tail} y")], [(7, f"{two} {tail}")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: 0, 2: 10} == {r[0]: r[2] for r in brute.contamination(rows, items)}


def test_stages_take_columns_of_any_name(spark, data, odd):
    df = odd.withColumn("_id", F.lit(1)).withColumn("_hash", F.lit(2)).withColumn("_gone", F.lit(3)).withColumn("_many", F.lit(4)).withColumn("_n_words", F.lit(5)).withColumn("_n_removed", F.lit(6)).withColumn("row", F.lit(7))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == df.columns
        assert docs.where("_id = 1 AND _hash = 2 AND _gone = 3 AND _many = 4 AND _n_words = 5 AND _n_removed = 6 AND row = 7").count() == docs.count() > 0


_TAGS = re.compile(rb"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;")
_LANG = re.compile(rb"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)")


def buckets(data):
    """Trigrams of letters, all else as spaces, by hash."""
    low = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in data)
    return [((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % 2**32) >> (32 - langid.BITS) for i in range(len(low) - 2)]


def test_language_query_by_loops(spark, data):
    """From labelled documents and pages to what the query returns."""
    docs = [r for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.lang is not None]
    langs = sorted({r.lang for r in docs})
    counts = [Counter(b for r in docs if r.lang == lang for b in buckets(f" {r.text or ''} ".encode())) for lang in langs]
    totals = [sum(c.values()) + 2**langid.BITS for c in counts]
    rows = []
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        html = (r.html or "").encode()
        seen = buckets(_TAGS.sub(b" ", html))
        text = [langid.TEMPER * sum(math.log((c[b] + 1) / n) for b in seen) for c, n in zip(counts, totals, strict=True)]
        host = (re.search(r"://([^/?#]*)", r.url or "") or ["", ""])[1].lower()
        said = _LANG.search(html)
        rows.append((r.page_id, host.split(".")[-1], ".".join(host.split(".")[-2:]), host, said[1].decode().lower() if said else "", [x - sum(text) / len(text) for x in text]))
    want = sorted(languages(rows, langs), key=repr)
    got = sorted(((r.page_id, r.lang, r.confidence, r.host_lang) for r in langid.query(spark, data).collect()), key=repr)
    assert len(got) == len(want) > 40
    for one, two in zip(got, want, strict=True):
        assert one[0] == two[0] and one[1] == two[1] and one[3] == two[3] and one[2] == pytest.approx(two[2], abs=2e-6)


def features(text, model):
    """Marker words that a text has, then shares of its bytes and words, as the model scales them."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", data)
    lower = b" ".join(w.lower() for w in words)
    (hashed,) = runs(pa.array([lower]), ALNUM, lower=True)
    own = set(hashed.hashes.tolist())
    n, k = max(len(data), 1), max(len(words), 1)
    shares = [sum(65 <= b <= 90 for b in data) / n, sum(b in quality._SYMBOLS for b in data) / n, sum(48 <= b <= 57 for b in data) / n, data.count(b"\n") / n, *(data.count(bytes([m])) / n for m in b"!|%#$&*")]
    shares += [sum(map(len, words)) / k / 10, len({w.lower() for w in words}) / k, math.log1p(len(words)) / 10]
    return [float(m in own) for m in model.markers.tolist()] + [(x - m) / s for x, m, s in zip(shares, model.mean.tolist(), model.scale.tolist(), strict=True)] + [1.0]


def test_quality_query_by_loops(spark, data):
    """From the fitted weights and whole texts to what the query returns."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    models = quality.fitted(docs, labels)
    assert models["low"] and models["toxic"] and len(models["toxic"].markers)
    rows = []
    for r in docs.collect():
        odds = [max(-30.0, min(30.0, sum(a * b for a, b in zip(features(r.text, models[k]), models[k].weights.tolist(), strict=True)))) if r.text else None for k in ("low", "toxic")]
        rows.append((r.doc_id, 0, r.source or "", r.lang or "", *odds))
    want = {r[0]: (*low, *toxic) for r, low, toxic in zip(rows, posteriors(rows, 4), posteriors(rows, 5), strict=True)}
    got = {r.doc_id: r for r in quality.query(spark, data).collect()}
    assert set(got) == set(want)
    for d, (low, low_site, toxic, toxic_site) in want.items():
        r = got[d]
        assert (r.low, r.low_site, r.toxic, r.toxic_site) == pytest.approx((low, low_site, toxic, toxic_site), abs=3e-6)
        assert r.kept == (round(low, 6) < quality.THRESHOLD and round(toxic, 6) < quality.THRESHOLD)
