"""Operator 8, benchmark decontamination with suffix arrays of the training texts.

A shard is a run of whole documents within a task, as an array of word hashes. Of its
suffixes those that may begin a benchmark window enter the shard's suffix array, which
is sorted by their first words; every distinct benchmark window is then found by binary
search. Words that windows cover are summed up from there, without the items. Where a
window occurs in a document and in an item, the words before tell whether a longer match
goes through it; those places where they differ begin the maximal matches, whose lengths
are found by binary search over hashes of prefixes. Of each document and item the longest
verbatim match is told, and where it is in both. So texts that repeat one window many
times cost by their length and their matches, not by the product of their windows.

Shards never meet, so there is no shuffle, and a passage that a third of all documents
share costs no more there than elsewhere. The benchmark goes to all tasks in slices of
at most SLICE_BYTES of text; a larger one takes one pass over the documents per slice,
with the table written to the shared folder in between.

Defined results: null texts have no words and no hits; an item of fewer words than a
window is one window, an item without words none; a null item_id matches, but isn't
counted or listed; items with equal ids count once; documents are kept row by row,
repeats too; of equally long matches the first in the document, then in the item, is told.
An empty benchmark hits nothing. Only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.periods import Prefixes, powers, times
from tessera.llm.shared import read, stash, text_of
from tessera.llm.words import ALNUM, U64, Words, grams, runs

WINDOW = 10
SLICE_BYTES = 4 << 20
_BITS = 22
#: Places that may begin a match are looked at so many at once.
BLOCK = 1 << 18


def _spread(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with n zeros behind each text, and where each word went."""
    texts = np.repeat(np.arange(len(words)), np.diff(words.rows))
    place = np.arange(len(texts)) + n * texts
    out = np.zeros(len(texts) + n * max(1, len(words)), U64)
    out[place] = words.hashes[: len(texts)]
    return out, place


def _keys(spread: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n words from each position as bytes that sort as the words do; zeros behind a text's end sort first."""
    rows = np.ascontiguousarray(spread[at[:, None] + np.arange(n)].astype(">u8"))
    return rows.view(f"S{8 * n}").ravel()


class Slice:
    """Windows of some benchmark items, each once, sorted, and where they occur."""

    def __init__(self, items: list[tuple[int | None, str]], window: int) -> None:
        self.window, self.items = window, [i for i, _ in items]
        (words,) = runs(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True, run_bytes=1 << 62) if items else (None,)
        self.keys = np.empty(0, f"S{8 * window}")
        if words is None or not len(words.hashes):
            return
        spread, place = _spread(words, window)
        sizes = np.diff(words.rows)
        item = np.repeat(np.arange(len(items)), sizes)
        left = words.left()
        starts = np.flatnonzero((left >= window) | ((sizes[item] < window) & (left == sizes[item])))
        keys = _keys(spread, place[starts], window)
        kinds, kind = np.unique(keys, return_inverse=True)
        self.hashes, self.left = words.hashes, left
        # Occurrences by window, then by the word before: that of an item's first word comes first.
        self.befores = np.unique(words.hashes)
        before = np.where(left[starts] == sizes[item[starts]], 0, 1 + np.searchsorted(self.befores, words.hashes[starts - 1]))
        order = np.lexsort((starts, before, kind))
        self.at, self.item, self.before = starts[order], item[starts[order]], (kind * (len(self.befores) + 1) + before)[order]
        self.bounds = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
        self.keys, self.length = kinds, np.minimum(left[self.at[self.bounds[:-1]]], window)
        self.prefix = int(self.length.min())
        self.table = np.zeros(1 << _BITS, bool)
        self.table[grams(spread, self.prefix)[place[starts]] >> U64(64 - _BITS)] = True
        # Where a shorter window's suffixes end in sorted order: behind all that begin with it.
        self.ends = np.array([k.ljust(8 * n, b"\0") + b"\xff" * (8 * (window - n)) for k, n in zip(self.keys.tolist(), self.length.tolist(), strict=True)], self.keys.dtype)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_sums"}

    @property
    def sums(self) -> Prefixes:
        """Hashes of prefixes of all items' words, made in each worker."""
        if "_sums" not in self.__dict__:
            self._sums = Prefixes(self.hashes)
        return self._sums

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each window of the slice and each word of a shard that it begins at."""
        none = np.empty(0, np.int64)
        if not len(self.keys) or not len(words.hashes):
            return none, none
        spread, place = _spread(words, self.window)
        at = place[self.table[grams(spread, self.prefix)[place] >> U64(64 - _BITS)]]
        keys = _keys(spread, at, self.window)
        order = np.argsort(keys, kind="stable")  # the suffix array
        keys, at = keys[order], at[order]
        low, high = np.searchsorted(keys, self.keys, "left"), np.searchsorted(keys, self.ends, "right")
        kind = np.repeat(np.arange(len(self.keys)), high - low)
        nth = np.arange(len(kind)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return kind, np.searchsorted(place, at[low[kind] + nth])

    def longest(self, words: Words, kind: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document row, item row, first words in both and words of the longest match of each document and item that have hits; by document and item."""
        best = tuple(np.empty(0, np.int64) for _ in range(5))
        if not len(kind):
            return best
        doc = np.searchsorted(words.rows, word, "right") - 1
        inside = np.flatnonzero(word > words.rows[doc])
        begin, end = self.bounds[kind], self.bounds[kind + 1]
        # Occurrences with the same word before are part of a match that begins earlier.
        same, until = end.copy(), end.copy()
        left = np.searchsorted(self.befores, words.hashes[word[inside] - 1])
        known = np.flatnonzero(left < len(self.befores))
        known = known[self.befores[left[known]] == words.hashes[word[inside[known]] - 1]]
        code = kind[inside[known]] * (len(self.befores) + 1) + 1 + left[known]
        same[inside[known]], until[inside[known]] = np.searchsorted(self.before, code, "left"), np.searchsorted(self.before, code, "right")
        count = same - begin + end - until
        ends = np.cumsum(count)
        sums = Prefixes(words.hashes)
        rest, up = words.left(), powers(max(len(words.hashes), len(self.hashes)) + 1)
        for k in range(0, int(ends[-1]), BLOCK):
            number = np.arange(k, min(k + BLOCK, int(ends[-1])))
            of = np.searchsorted(ends, number, "right")
            nth = number - (ends[of] - count[of])
            o = np.where(nth < same[of] - begin[of], begin[of] + nth, until[of] + nth - (same[of] - begin[of]))
            p, q = word[of], self.at[o]
            n = _common(sums, self.sums, up, p, q, self.length[kind[of]], np.minimum(rest[p], self.left[q]))
            found = (doc[of], self.item[o], p - words.rows[doc[of]], q, n)
            best = tuple(np.concatenate(x) for x in zip(best, found, strict=True))
            order = np.lexsort((best[3], best[2], -best[4], best[1], best[0]))
            best = tuple(x[order] for x in best)
            first = np.ones(len(order), bool)
            first[1:] = (best[0][1:] != best[0][:-1]) | (best[1][1:] != best[1][:-1])
            best = tuple(x[first] for x in best)
        starts = np.flatnonzero(self.left == self._sizes())
        return best[0], best[1], best[2], best[3] - starts[np.searchsorted(starts, best[3], "right") - 1], best[4]

    def _sizes(self) -> np.ndarray:
        """For each word, how many words its item has."""
        last = np.flatnonzero(self.left == 1)
        sizes = np.diff(np.concatenate([[-1], last]))
        return np.repeat(sizes, sizes)


def _common(one: Prefixes, two: Prefixes, up: np.ndarray, p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words from p and q on are equal: at least low, at most high. By doubling, then by halving."""
    low, high = low.astype(np.int64), high.astype(np.int64)
    growing, step = np.ones(len(p), bool), 1
    live = np.flatnonzero(low < high)
    while len(live):
        a, b, was = p[live], q[live], low[live]
        size = np.where(growing[live], np.minimum(was + step, high[live]), (was + high[live] + 1) >> 1)
        equal = times(one.between(a, a + size), up[b]) == times(two.between(b, b + size), up[a])
        low[live[equal]] = size[equal]
        high[live[~equal]] = size[~equal] - 1
        growing[live[~equal]] = False
        live, step = live[low[live] < high[live]], 2 * step
    return low


_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
_MATCHES = T.ArrayType(T.StructType().add("item_id", "long").add("item_word", "long").add("doc_word", "long").add("n_words", "long"))


def slices(benchmark: DataFrame, window: int, limit: int, key: str, text: str) -> Iterator[Slice]:
    """The benchmark in slices of bounded size; an item is never cut."""
    items, size = [], 0
    for row in text_of(benchmark, key, text).toLocalIterator():
        items.append((row.doc_id, row.text or ""))
        size += len((row.text or "").encode())
        if size >= limit:
            yield Slice(items, window)
            items, size = [], 0
    if items:
        yield Slice(items, window)


def contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit and the longest verbatim match of each item that has hits in the document."""
    return _contamination(text_of(df, key, text), benchmark, window, item, item_text, limit).select("doc_id", "n_words", "n_hit", "matches")


def _contamination(rows: DataFrame, benchmark: DataFrame, window: int, item: str, item_text: str, limit: int) -> DataFrame:
    """rows: doc_id, text and columns to carry along."""
    out, done = rows, False
    for one in slices(benchmark, window, limit, item, item_text):
        if done:
            out, _ = stash(out)
        out, done = _look(out, one, rows.columns), True
    out = out if done else _look(out, Slice([], window), rows.columns)
    return out.withColumn("n_hit", F.aggregate("covered", F.lit(0).cast("long"), lambda n, c: n + c["n"]))


_SPAN = pa.struct([("begin", pa.int64()), ("n", pa.int64())])
_SPANS = T.ArrayType(T.StructType().add("begin", "long").add("n", "long"))


def _look(df: DataFrame, one: Slice, kept: list[str]) -> DataFrame:
    """Adds the covered words and the matches of a slice to those of the slices before."""
    sent = df.sparkSession.sparkContext.broadcast(one)
    before = "matches" in df.columns
    schema = T.StructType([df.schema[c] for c in kept]).add("n_words", "long").add("covered", _SPANS).add("matches", _MATCHES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        names = pa.array(index.items, pa.int64())
        for batch in batches:
            for words in runs(batch.column(1), ALNUM, lower=True):
                rows = batch.slice(words.first, len(words))
                kind, word = index.hits(words)
                turns = np.zeros(len(words.hashes) + 1, np.int64)
                if len(kind):
                    np.add.at(turns, word, 1)
                    np.add.at(turns, word + index.length[kind], -1)
                doc, item, at, item_at, n = index.longest(words, kind, word)
                found = [names.take(pa.array(item)), pa.array(item_at), pa.array(at), pa.array(n)]
                if before:
                    old, row = _flat(rows.column("covered"))
                    begin = words.rows[row] + old.field("begin").to_numpy()
                    np.add.at(turns, begin, 1)
                    np.add.at(turns, begin + old.field("n").to_numpy(), -1)
                    old, row = _flat(rows.column("matches"))
                    found = [pa.concat_arrays([old.field(k), x]) for k, x in enumerate(found)]
                    order = np.argsort(np.concatenate([row, doc]), kind="stable")
                    doc, found = np.concatenate([row, doc])[order], [x.take(pa.array(order)) for x in found]
                matches = _lists(doc, pa.StructArray.from_arrays(found, fields=list(_MATCH.value_type)), len(words))
                yield pa.record_batch([*rows.columns[: len(kept)], pa.array(np.diff(words.rows).astype(np.int64)), _covered(words, np.cumsum(turns[:-1]) > 0), matches], [*kept, "n_words", "covered", "matches"])

    return df.mapInArrow(look, schema)


def _flat(lists: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The structs of a column of lists, and the row of each."""
    return lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """Values by ascending row as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _covered(words: Words, hit: np.ndarray) -> pa.Array:
    """The stretches of hit words of each text."""
    of = np.repeat(np.arange(len(words)), np.diff(words.rows))
    edge = np.ones(len(hit), bool)
    edge[1:] = (of[1:] != of[:-1]) | (hit[1:] != hit[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(hit)))
    first, size = first[hit[first]], size[hit[first]]
    return _lists(of[first], pa.StructArray.from_arrays([pa.array(first - words.rows[of[first]]), pa.array(size)], fields=list(_SPAN)), len(words))


def clean(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of df, with all their columns, without those that hold a benchmark window."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    told = _contamination(rows, benchmark, window, "item_id", "text", limit).where("n_hit = 0")
    return told.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sort_array(F.array_distinct(F.transform(F.filter("matches", lambda m: m["item_id"].isNotNull()), lambda m: m["item_id"].cast("string"))))
    return told.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
