"""Operator 10, quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Evidence of a document comes from two logistic models over marker words, found by
their association with a label, and the shape of the text. They are fitted on a
bounded sample of labelled rows; everything else covers all rows. The documents'
posteriors are summed up by host and by path. A host's rate is drawn to the rate of
all documents and a path's to its host's, each by a weight that the spread at its own
level gives (method of moments), so a site with few documents says little. A document
is taken out of its own site's sums before they speak about it. The path's log-odds
against the overall ones are added to those of the document.

Defined results: a null or empty text has no evidence and gets the prior of its site;
null host or path count as a site of their own. Without labelled rows, or if a label
has one value only, that label rejects nothing. Rows are kept one by one, repeats too;
equal rows get equal results. An empty table gives an empty one. Texts are used whole; a
task holds one run of about 1 MB or one longer text at a time. Columns go by place in
good(), so those of its table may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import read, scratch, stash
from tessera.llm.words import ALNUM, U64, Words, runs

#: Labelled rows that the models are fitted on, those of the smallest hash of doc_id, and bytes of their texts, at most. Rows that do not fit into the bytes left are passed over.
FIT_ROWS, FIT_BYTES = 6000, 24 << 20
#: Weight of the site against the document, and bounds of the weight of a prior in documents.
SITE_WEIGHT, LEAST, MOST = 0.5, 50.0, 1e6
THRESHOLD = 0.4
LABELS = ("low", "toxic")
_BITS = 20
_SYMBOLS = b"!|%#$&*@<>{}[]=_~^+\\"


@dataclass
class Model:
    markers: np.ndarray  # sorted hashes
    weights: np.ndarray  # markers, then shape, then the constant
    mean: np.ndarray
    scale: np.ndarray
    table: np.ndarray


def shape(words: Words) -> np.ndarray:
    """A row per text: shares of capitals, symbols, digits and several marks among its bytes, and of short and distinct words."""
    n = len(words)
    row_of = np.repeat(np.arange(n), np.diff(words.rows))
    word_n = np.maximum(np.diff(words.rows), 1)
    data = words.data
    bounds = words.bytes_at
    size = np.maximum(np.diff(bounds), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / size

    upper = (data >= 65) & (data <= 90)
    marks = [share(data == m) for m in b"!|%#$&*"]
    length = words.end - words.begin
    distinct = np.zeros(n)
    if len(row_of):
        order = np.lexsort((words.hashes, row_of))
        r, h = row_of[order], words.hashes[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(r[first], minlength=n)
    return np.stack([share(upper), share(np.isin(data, np.frombuffer(_SYMBOLS, np.uint8))), share((data >= 48) & (data <= 57)), share(data == 10), *marks, np.bincount(row_of, length, minlength=n) / word_n / 10, distinct / word_n, np.log1p(np.diff(words.rows)) / 10], axis=1)


def _marks(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each text's markers, once each: rows of texts and places of markers."""
    tokens, row_of = words.hashes, np.repeat(np.arange(len(words)), np.diff(words.rows))
    maybe = model.table[tokens >> U64(64 - _BITS)]
    tokens, row_of = tokens[maybe], row_of[maybe]
    at = np.searchsorted(model.markers, tokens)
    hit = np.flatnonzero(at < len(model.markers))
    hit = hit[model.markers[at[hit]] == tokens[hit]]
    k = max(len(model.markers), 1)
    both = np.unique(row_of[hit] * k + at[hit])
    return both // k, both % k


def _scores(rows: np.ndarray, marks: np.ndarray, shapes: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The log-odds of texts: weights of their markers, of their scaled shares, and the constant. No row of all markers is made."""
    k = len(w) - shapes.shape[1] - 1
    return np.bincount(rows, w[:k][marks], minlength=len(shapes)) + shapes @ w[k:-1] + w[-1]


def scores(words: Words, model: Model) -> np.ndarray:
    return _scores(*_marks(words, model), (shape(words) - model.mean) / model.scale, model.weights)


def _counted(sample: DataFrame) -> DataFrame:
    """word, a hash, and of how many texts of the sample and of each label's it is. sample: row, a boolean for each label, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in range(1, 1 + len(LABELS))]
            for words in runs(batch.column(1 + len(LABELS)), ALNUM, lower=True):
                t, r = words.hashes, np.repeat(np.arange(len(words)), np.diff(words.rows))
                order = np.lexsort((t, r))
                t, r = t[order], r[order]
                keep = np.ones(len(t), bool)
                keep[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
                own, back = np.unique(t[keep], return_inverse=True)
                sums = [np.bincount(back, y[r[keep] + words.first], minlength=len(own)).astype(np.int64) for y in told]
                yield pa.record_batch([pa.array(x) for x in (own.view(np.int64), np.bincount(back, minlength=len(own)), *sums)], ["word", "n", *LABELS])

    names = ["n", *LABELS]
    each = sample.select("row", *LABELS, "text").mapInArrow(count, ", ".join(f"{c} long" for c in ["word", *names]))
    return each.groupBy("word").agg(*(F.sum(c).alias(c) for c in names))


def _marked(sample: DataFrame, models: dict[str, Model]) -> DataFrame:
    """row, the shape of its text, and the places of its markers for each label that has a model."""
    sent = sample.sparkSession.sparkContext.broadcast(models)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for words in runs(batch.column(1), ALNUM, lower=True):
                found = []
                for m in known.values():
                    r, at = _marks(words, m)
                    found.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(words) + 1)).astype(np.int32)), pa.array(at, pa.int64())))
                forms = shape(words)
                forms = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * forms.shape[1]), pa.array(forms.ravel()))
                yield pa.record_batch([batch.column(0).slice(words.first, len(words)), forms, *found], ["row", "shape", *known])

    return sample.select("row", "text").mapInArrow(mark, ", ".join(["row long", "shape array<double>", *(f"{k} array<bigint>" for k in models)]))


def fit(sample: DataFrame, labels: dict[str, np.ndarray]) -> dict[str, Model | None]:
    """Markers by z-score, then ridge-penalized logistic models by Newton steps; None for a label that has one value only.

    sample: row, a boolean for each label, text; labels: those of rows 0, 1 and so on.
    Tasks go over the texts; markers, shapes and the places of markers reach the driver.
    """
    models: dict[str, Model] = {}
    asked = {k: y.astype(bool) for k, y in labels.items() if y.any() and not y.all()}
    if not asked:
        return dict.fromkeys(labels)
    passed = []
    for k, y in asked.items():
        positive, rate = F.lit(float(y.sum())), F.col("n") / F.lit(float(len(y)))
        z = (F.col(k) - positive * rate) / F.sqrt(positive * rate * (F.lit(1.0) - rate) + F.lit(1e-9))
        passed.append((F.col(k) >= 3) & (z > 5))
    found = _counted(sample).select("word", *(c.alias(k) for k, c in zip(asked, passed, strict=True))).where(" OR ".join(asked)).toArrow()
    for k in asked:
        markers = np.sort(found["word"].filter(found[k]).to_numpy().astype(np.int64).view(U64))
        table = np.zeros(1 << _BITS, bool)
        table[markers >> U64(64 - _BITS)] = True
        models[k] = Model(markers, np.empty(0), np.empty(0), np.empty(0), table)
    found = _marked(sample, models).toArrow().sort_by("row").combine_chunks()
    shapes = found["shape"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    mean, scale = shapes.mean(0), shapes.std(0) + 1e-3
    for k, m in models.items():
        places = found[k].combine_chunks()
        rows = np.repeat(np.arange(found.num_rows), places.value_lengths().to_numpy())
        m.mean, m.scale = mean, scale
        m.weights = _solved(rows, places.flatten().to_numpy(), (shapes - mean) / scale, len(m.markers), asked[k].astype(float))
    return {k: models.get(k) for k in labels}


def _solved(rows: np.ndarray, marks: np.ndarray, shapes: np.ndarray, k: int, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalized logistic model by Newton steps, each by conjugate gradients, so that memory is that of the markers that occur."""
    n = k + shapes.shape[1] + 1
    ridge = np.full(n, 0.1)
    ridge[-1] = 1e-6
    w = np.zeros(n)

    def back(v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(marks, v[rows], minlength=k), v @ shapes, [v.sum()]])

    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(_scores(rows, marks, shapes, w), -30, 30)))
        d = p * (1 - p)
        rest = back(p - y) + ridge * w
        scale = 1 / (np.concatenate([np.bincount(marks, d[rows], minlength=k), d @ shapes**2, [d.sum()]]) + ridge)
        step, z = np.zeros(n), scale * rest
        q, rho, enough = z.copy(), float(rest @ z), 1e-22 * float(rest @ (scale * rest))
        for _ in range(10 * n + 100):
            if rho <= enough:
                break
            h = back(d * _scores(rows, marks, shapes, q)) + ridge * q
            a = rho / float(q @ h)
            step += a * q
            rest -= a * h
            z = scale * rest
            rho, before = float(rest @ z), rho
            q = z + rho / before * q
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(documents: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, limit_bytes: int = FIT_BYTES) -> dict[str, Model | None]:
    """A model per label, from labelled documents that are there: `limit` rows and `limit_bytes` of text at most.

    Those of the least hash, but of each value of a label a twentieth of `limit` at least,
    if there are so many. Of documents with the same id, the text of the least hash counts.
    """
    told = labels.where("doc_id IS NOT NULL").select("doc_id", (F.coalesce("quality", F.lit(1)) == 0).alias("low"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")).distinct()
    size = F.octet_length(F.coalesce("text", F.lit("")))
    there = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(size, F.xxhash64("text")).alias("bytes"))
    with scratch(documents.sparkSession):
        told, _ = stash(told.withColumn("hash", F.xxhash64("doc_id")).join(there.hint("merge"), "doc_id"))
        order = ("hash", "doc_id", "low", "toxic", "bytes")
        parts = [told.where(F.col(k) == v).orderBy(*order).limit(max(limit // 20, 1)).withColumn("last", F.lit(False)) for k in LABELS for v in (False, True)]
        parts.append(told.orderBy(*order).limit(limit).withColumn("last", F.lit(True)))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        rows = every.groupBy(*order).agg(F.min("last").alias("last")).orderBy("last", *order).limit(limit).collect()
    chosen, used = [], 0
    for r in rows:
        if used + r.bytes <= limit_bytes:
            used += r.bytes
            chosen.append((r.doc_id, r.low, r.toxic))
    if not chosen:
        return dict.fromkeys(LABELS)
    # One text of each id, by partial aggregates: an id that repeats is bounded too.
    chosen.sort()
    ids = documents.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(chosen)], "doc_id long, low boolean, toxic boolean, row long")
    found = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("row", *LABELS).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    with scratch(documents.sparkSession):
        sample, _ = stash(found)
        return fit(sample, {k: np.array([x[i] for x in chosen]) for i, k in enumerate(LABELS, 1)})


def evidence(df: DataFrame, models: dict[str, Model | None]) -> DataFrame:
    """Adds the log-odds of each label by the document alone; null where there is no evidence."""
    sent = df.sparkSession.sparkContext.broadcast(models)
    kept = len(df.columns)
    schema = T.StructType([*df.schema.fields[1:], *(T.StructField(f"{k}_odds", T.DoubleType()) for k in LABELS)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for words in runs(batch.column(0), ALNUM, lower=True):
                rows = batch.slice(words.first, len(words))
                empty = np.diff(words.bytes_at) == 0
                odds = [pa.array(np.clip(scores(words, m), -30, 30), mask=empty) if (m := known[k]) else pa.nulls(len(words), pa.float64()) for k in LABELS]
                yield pa.record_batch([*rows.columns[1:kept], *odds], [f.name for f in schema])

    return df.mapInArrow(judge, schema)


def _logit(p):
    return F.log(p / (1 - p))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text_hash, the posterior of each label, those of the site, and kept. df is read twice: for the sample, and for all rows."""
    docs = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"))
    models = fitted(docs, labels, fit_rows)
    with scratch(df.sparkSession) as kept:
        judged, _ = stash(evidence(docs, models))
        out, at = stash(fused(judged, {k: m is not None for k, m in models.items()}, threshold))
        kept.append(at)
    return out


def _weight(q: float | None, groups: int | None, above: float, n: float) -> float:
    """The weight in documents of the level above: what its rates' variance is to the spread q of the groups below, beyond what sampling gives."""
    var = above / n if n else 0.0
    extra = ((q or 0) - (groups or 0) * var) / n if n else 0.0
    return min(max(var / extra - 1, LEAST), MOST) if extra > 0 else MOST


def fused(judged: DataFrame, known: dict[str, bool], threshold: float = THRESHOLD) -> DataFrame:
    """Puts the evidence of documents and of their sites together. judged: doc_id, text_hash, host, path and the odds of each label."""
    for k in LABELS:
        judged = judged.withColumn(f"{k}_p", 1 / (1 + F.exp(-F.col(f"{k}_odds"))))
    sums = [f(F.col(f"{k}_p")).alias(f"{k}_{n}") for k in LABELS for n, f in (("sum", F.sum), ("n", F.count))]
    paths = judged.groupBy("host", "path").agg(*sums).fillna(0.0)
    hosts = paths.groupBy("host").agg(*(F.sum(f"{k}_{n}").alias(f"{k}_host_{n}") for k in LABELS for n in ("sum", "n")))
    # One row: rates of all documents, then the spread of hosts around them, and of paths around their hosts.
    totals = hosts.agg(*(F.sum(f"{k}_host_{n}").alias(f"{k}_{n}") for k in LABELS for n in ("sum", "n"))).first()
    rate = {k: min(max((totals[f"{k}_sum"] or 0) / max(totals[f"{k}_n"] or 0, 1), 1e-4), 1 - 1e-4) for k in LABELS}
    # A table of its own, so that Spark may split a hot site.
    sites, _ = stash(paths.join(hosts.hint("merge"), "host"))

    def off(own: str, mean, name: str) -> list:
        """Squared deviations of a level's sums from what the level above says, and the number of groups."""
        s, n = F.col(f"{own}_sum"), F.col(f"{own}_n")
        return [F.sum(F.when(n > 0, (s - mean * n) ** 2 / n)).alias(f"{name}_q"), F.sum(F.when(n > 0, 1)).alias(f"{name}_groups")]

    by_host = hosts.agg(*(c for k in LABELS for c in off(f"{k}_host", F.lit(rate[k]), k))).first()
    mean = {k: F.col(f"{k}_host_sum") / F.col(f"{k}_host_n") for k in LABELS}
    by_path = sites.agg(*(c for k in LABELS for c in (*off(k, mean[k], k), F.sum(F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_n") * mean[k] * (1 - mean[k]))).alias(f"{k}_var")))).first()
    out = judged.join(sites.hint("merge"), ["host", "path"])
    for k in LABELS:
        n = totals[f"{k}_n"] or 0
        host_weight = _weight(by_host[f"{k}_q"], by_host[f"{k}_groups"], n * rate[k] * (1 - rate[k]), n)
        path_weight = _weight(by_path[f"{k}_q"], by_path[f"{k}_groups"], by_path[f"{k}_var"] or 0.0, n)
        own, one = F.coalesce(f"{k}_p", F.lit(0.0)), F.when(F.col(f"{k}_p").isNull(), 0).otherwise(1)
        above = (F.col(f"{k}_host_sum") - own + host_weight * rate[k]) / (F.col(f"{k}_host_n") - one + host_weight)
        site = (F.col(f"{k}_sum") - own + path_weight * above) / (F.col(f"{k}_n") - one + path_weight)
        out = out.withColumn(f"{k}_site", F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6)))
        prior = _logit(F.lit(rate[k]))
        odds = F.coalesce(F.col(f"{k}_odds"), prior) + SITE_WEIGHT * (_logit(F.col(f"{k}_site")) - prior)
        out = out.withColumn(k, F.round(1 / (1 + F.exp(-odds)), 6)).withColumn(f"{k}_site", F.round(f"{k}_site", 6))
    rejected = F.lit(False)
    for k in LABELS:
        rejected = rejected | ((F.col(k) >= threshold) & F.lit(known[k]))
    return out.select("doc_id", "text_hash", *LABELS, *(f"{k}_site" for k in LABELS), (~rejected).alias("kept"))


def good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of df, with all their columns, that classify() keeps."""
    names = df.columns
    own = [f"c{i}" for i in range(len(names))]
    rows, k, t = df.toDF(*own), own[names.index(key)], own[names.index(text)]
    with scratch(df.sparkSession) as kept:
        bad, at = stash(classify(df, labels, key, text, **more).where("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct())
        kept.append(at)
    same = F.col(k).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.col(t).cast("string")) == F.col("hash"))
    return rows.join(bad.hint("merge"), same, "left_anti").toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")
