"""Operator 9, language ID: evidence of text, markup and address, fused by Bayes' rule.

The text speaks through byte trigrams, whose likelihood by language is fitted on a
bounded sample of labelled documents. Everything else is counted over all pages, with
each page's text posterior as a soft count: how often each language is declared in the
markup as what, and how languages are spread over address suffixes, domains and hosts.
Suffix, domain and host form a chain: each level is drawn to the one above by a weight
of PRIOR pages, and a page is taken out of its own host's count. Counts are grouped
aggregations, and go back to the pages by joins on lean rows.

Defined results: a null or empty page has no text evidence; a null url has empty host,
domain and suffix, which form a site of their own; where nothing is declared, markup
says nothing; equal posteriors go to the language that comes first by name; rows are
kept one by one, and equal rows get equal results. Without labelled documents all
languages are null; an empty table gives an empty one. Pages are used whole, STEP
trigrams at a time, so memory is bounded by the longest page's bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import read, scratch, stash
from tessera.llm.words import spans

#: Labelled documents that the text model is fitted on, those of the smallest hash of doc_id, and bytes of their texts, at most. Rows that do not fit into the bytes left are passed over.
FIT_ROWS, FIT_BYTES = 2000, 24 << 20
#: Trigrams of a page are weighed so many at a time.
STEP = 1 << 17
BITS = 15
#: Trigrams overlap, so each counts for less.
TEMPER = 0.2
#: Weight of the level above, and of the guess that what is declared is so, in pages.
PRIOR, DECLARED = 20.0, 5.0

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint32)


@dataclass
class TextModel:
    langs: list[str]
    weights: np.ndarray  # log-likelihood of each trigram bucket by language, as a difference to their mean


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each place on; letters in lower case, all else as spaces."""
    folded = _FOLD[data]
    if len(folded) < 3:
        return np.empty(0, np.int64)
    key = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    return (key * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


def fit(texts: list[str], langs: list[str]) -> TextModel:
    names = sorted(set(langs))
    counts = np.ones((1 << BITS, len(names)))
    for text, lang in zip(texts, langs, strict=True):
        counts[:, names.index(lang)] += np.bincount(trigrams(np.frombuffer(f" {text} ".encode(), np.uint8)), minlength=1 << BITS)
    logs = np.log(counts / counts.sum(0))
    return TextModel(names, logs - logs.mean(1, keepdims=True) if names else logs)


def fitted(documents: DataFrame, limit: int = FIT_ROWS, limit_bytes: int = FIT_BYTES) -> TextModel:
    """From labelled documents, `limit` rows and `limit_bytes` of text at most, which reach the driver. Of rows with the same id, that of the least hash counts."""
    labelled = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    one = F.struct(F.xxhash64("text", "lang").alias("hash"), "lang", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    rows = labelled.groupBy("doc_id").agg(F.min(one).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    chosen, used = [], 0
    for r in rows:
        if used + r.one.bytes <= limit_bytes:
            used += r.one.bytes
            chosen.append((r.doc_id, r.one.hash))
    ids = documents.sparkSession.createDataFrame(chosen, "doc_id long, hash long")
    found = labelled.select("doc_id", F.xxhash64("text", "lang").alias("hash"), "text", "lang").join(F.broadcast(ids), ["doc_id", "hash"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    rows = found.toArrow().sort_by([("doc_id", "ascending")])
    return fit([x or "" for x in rows["text"].to_pylist()], rows["lang"].to_pylist())


def likelihood(page: np.ndarray, model: TextModel) -> np.ndarray:
    """The tempered log-likelihood of a page's bytes by language."""
    told = np.zeros(len(model.langs))
    for i in range(0, max(len(page) - 2, 0), STEP):
        told += model.weights[trigrams(page[i : i + STEP + 2])].sum(0)
    return TEMPER * told


_REFERENCE, _MARK = re.compile(rb"&#?\w++;"), re.compile(rb"<|&#?\w++;")
_OPENS = re.compile(rb"<(?:(script|style)\b|(!--))?", re.I)
_ROOT = re.compile(rb"<html\b", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([a-z]+)", re.I)


def visible(html: bytes) -> bytes:
    """A page's text: scripts, styles, comments, tags and character references are a space each.

    What isn't closed is a tag, if there is a > later, or text. An end that was looked for
    in vain isn't looked for again, so the time is in proportion to the page.
    """
    lower, parts, at, mark, absent = html.lower(), [], 0, _MARK, set()
    search = 0
    while found := mark.search(html, search):
        begin, end = found.span()
        if html[begin] == 0x3C:
            opens = _OPENS.match(html, begin)
            close = b"</" + opens[1].lower() + b">" if opens[1] else b"-->" if opens[2] else b">"
            where = -1 if close in absent else lower.find(close, opens.end())
            if where < 0 and close != b">":
                absent.add(close)
                close = b">"
                where = lower.find(close, begin)
            if where < 0:  # no tags from here on
                mark, search = _REFERENCE, begin + 1
                continue
            end = where + len(close)
        parts += (html[at:begin], b" ")
        at = search = end
    return b"".join((*parts, html[at:]))


def declared(html: bytes) -> str:
    """The language that the page's root declares, in lower case; else an empty string."""
    at = 0
    while root := _ROOT.search(html, at):
        end = html.find(b">", root.end())
        end = len(html) if end < 0 else end
        if said := _LANG.search(html[root.end() : end]):
            return said[1].decode().lower()
        at = end
    return ""


def evidence(pages: DataFrame, model: TextModel, key: str, url: str, html: str) -> DataFrame:
    """page_id, host, domain, suffix, declared and text: the log-likelihood by language."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"://([^/?#]*)", 1))
    lean = pages.select(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"), F.col(f"`{key}`").cast("long").alias("page_id"), host.alias("host"))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        width = len(known.langs)
        for batch in batches:
            data, at = spans(batch.column(0))
            pages = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            told = np.array([likelihood(np.frombuffer(visible(x), np.uint8), known) for x in pages]).reshape(batch.num_rows, width)
            lists = pa.ListArray.from_arrays(np.arange(len(told) + 1, dtype=np.int32) * width, pa.array(told.ravel()))
            yield pa.record_batch([*batch.columns[1:], pa.array([declared(x) for x in pages], pa.string()), lists], ["page_id", "host", "declared", "text"])

    told = lean.mapInArrow(judge, "page_id long, host string, declared string, text array<double>")
    return told.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.substring_index("host", ".", -2))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    scaled = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host and host_lang."""
    k = len(model.langs)
    if not k:
        return evidence(pages, model, key, url, html).select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.lit(None).cast("string").alias("host_lang"))
    with scratch(pages.sparkSession) as kept:
        lean, _ = stash(evidence(pages, model, key, url, html))
        out, at = stash(fused(lean, model.langs))
        kept.append(at)
    return out


def fused(lean: DataFrame, langs: list[str]) -> DataFrame:
    """Puts the evidence of text, markup and address together. lean: page_id, suffix, domain, host, declared and text, the log-likelihoods by language."""
    k = len(langs)
    lean = lean.withColumn("soft", _softmax(F.col("text")))

    def sums(column: str, name: str) -> list[Column]:
        return [F.array(*(F.sum(F.col(column)[i]) for i in range(k))).alias(name)]

    def drawn(own: str, n: str, above: Column) -> Column:
        return F.transform(F.arrays_zip(F.col(own).alias("x"), above.alias("y")), lambda z: (z["x"] + PRIOR * z["y"]) / (F.col(n) + PRIOR))

    hosts = lean.groupBy("suffix", "domain", "host").agg(*sums("soft", "host_sum"), F.count(F.lit(1)).alias("host_n"))
    domains = hosts.groupBy("suffix", "domain").agg(*sums("host_sum", "domain_sum"), F.sum("host_n").alias("domain_n"))
    suffixes = domains.groupBy("suffix").agg(*sums("domain_sum", "suffix_sum"), F.sum("domain_n").alias("suffix_n"))
    total = suffixes.agg(*sums("suffix_sum", "s"), F.sum("suffix_n").alias("n")).first()  # one row
    n = (total["n"] or 0) + k
    overall = F.array(*(F.lit((x + 1.0) / n) for x in total["s"] if x is not None)) if total["n"] else F.array(*(F.lit(1.0 / k) for _ in range(k)))
    sites = (
        hosts.join(domains.hint("merge"), ["suffix", "domain"])
        .join(suffixes.hint("merge"), "suffix")
        .withColumn("by_suffix", drawn("suffix_sum", "suffix_n", overall))
        .withColumn("by_domain", drawn("domain_sum", "domain_n", F.col("by_suffix")))
        .select("suffix", "domain", "host", "host_sum", "host_n", "by_domain")
    )
    sites, _ = stash(sites)  # tables of their own, so that Spark may split a hot host's pages
    # How likely each language's pages declare what this one does.
    said = lean.where("declared <> ''").groupBy("declared").agg(*sums("soft", "said_sum"))
    all_said = [float(x or 0) for x in (total["s"] or [0.0] * k)]
    likely = F.array(*(F.log((F.col("said_sum")[i] + F.when(F.col("declared") == lang, DECLARED).otherwise(DECLARED / 100)) / (all_said[i] + DECLARED)) for i, lang in enumerate(langs)))
    said, _ = stash(said.select("declared", likely.alias("markup")))
    joined = lean.join(sites.hint("merge"), ["suffix", "domain", "host"]).join(said.hint("merge"), "declared", "left")
    rest = F.transform(F.arrays_zip(F.col("host_sum").alias("s"), F.col("soft").alias("o"), F.col("by_domain").alias("d")), lambda z: (z["s"] - z["o"] + PRIOR * z["d"]) / (F.col("host_n") - 1 + PRIOR))
    logs = F.transform(F.arrays_zip(F.col("text").alias("t"), rest.alias("p"), F.coalesce("markup", F.array_repeat(F.lit(0.0), k)).alias("m")), lambda z: z["t"] + F.log(F.greatest(z["p"], F.lit(1e-12))) + z["m"])
    names = F.array(*(F.lit(x) for x in langs))

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return joined.withColumn("posterior", _softmax(logs)).select(
        "page_id", best(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"), best(F.col("text")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "host", best(rest).alias("host_lang")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "pages"), fitted(read(spark, sf_dir, "documents")))
