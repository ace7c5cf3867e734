"""Operator 11, periodic runs of words, by a harmonic grid.

A run of period q, at least k * q and at least m words long, holds at least
need = max(m - q, (k - 1) * q) places whose word is also q words later. So of grid points
need // 2 apart, one has need // 2 such places from it on within the run. Over all
periods, grid points are a harmonic series: about n * log(n) for n words.

1. All (period, grid point) pairs of a run of texts are numbered, in ascending order of
   periods, and taken in blocks of bounded size. A pair stays if the words at both ends
   are equal and the hashes of the need // 2 words from there on are.
2. Both longest common extensions of the pairs that stay, back and forth, are found for all
   of them at once, by binary search over hashes of prefixes modulo 2**61 - 1. That gives
   the maximal stretch of the period.
3. Stretches found more than once are told apart by their ends: the least period of a
   stretch is the smallest with these ends, as other periods of it are multiples of it.
   Each is verified word by word; where hashes were wrong, extensions are found by words.
4. A pair whose ends lie in a known run of a period that divides its own is passed over: its
   stretch is that run. So a text that is one long repetition costs little more than
   its length.

Rows don't meet: there is no shuffle, and what a task holds is bounded by a batch, a run of
about 1 MB or one longer text.

Defined results: a null or empty text has no words and no runs, and stays as an empty
collapsed text; rows are kept as they are, repeated ones too; null ids are carried along.
Empty tables give empty ones. Other columns aren't read. Words are bytes between ASCII white
space, known by 64-bit hashes (words.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import read, text_of
from tessera.llm.words import NOT_SPACE, U64, Words, runs

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Pairs that are looked at at once.
BLOCK = 1 << 18
_P = (1 << 61) - 1
_BASE = 0x1B3F6C9D2E4A5871 % _P
_P64, _LOW32, _29 = U64(_P), U64((1 << 32) - 1), U64((1 << 29) - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for any x of 64 bits."""
    x = (x & _P64) + (x >> U64(61))
    return np.where(x >= _P64, x - _P64, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of factors below it."""
    a0, a1, b0, b1 = a & _LOW32, a >> U64(32), b & _LOW32, b >> U64(32)
    low, high = a0 * b0, a1 * b1  # high counts 2**64, which is 8 modulo 2**61 - 1
    middle = a1 * b0 + a0 * b1  # below 2**62; counts 2**32
    return _mod(_mod(low) + _mod(high << U64(3)) + ((middle & _29) << U64(32)) + (middle >> U64(29)))


class _Powers:
    """Powers of the base, made as far as they are needed, by doubling."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.next = np.array([_BASE], U64)  # the base to the power of how many there are

    def get(self, n: int) -> np.ndarray:
        while len(self.up) < n:
            self.up = np.concatenate([self.up, times(self.up, self.next)])
            self.next = times(self.next, self.next)
        return self.up


_POWERS = _Powers()


def powers(n: int) -> np.ndarray:
    """At least n powers of the base, from that to the power of 0 on."""
    return _POWERS.get(n)


class Prefixes:
    """Hashes of all prefixes of a sequence of words."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.words, self.up = words, _POWERS.get(n + 1)
        terms = times(_mod(words), self.up[:n])
        low, high = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        np.cumsum(terms & _LOW32, out=low[1:])
        np.cumsum(terms >> U64(32), out=high[1:])
        # high counts 2**32; its sum is below 2**29 times n.
        self.sums = _mod(_mod(low) + times(_mod(high), np.full(n + 1, 1 << 32, U64)))

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from begin to end, as they stand: times the base to the power of begin."""
        return _mod(self.sums[end] + (_P64 - self.sums[begin]))

    def same(self, at: np.ndarray, gap: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from each `at` on and from `gap` words later on have one hash."""
        return times(self.between(at, at + size), self.up[gap]) == self.between(at + gap, at + gap + size)

    def extend(self, at: np.ndarray, gap: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest common extensions of `at` and `at + gap`, of up to `most` words; back: of those before both."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        growing, step = np.ones(len(at), bool), 1  # gallop, then halve: most extensions are short
        live = np.flatnonzero(high > 0)
        while len(live):
            size = np.where(growing[live], np.minimum(low[live] + step, high[live]), (low[live] + high[live] + 1) >> 1)
            equal = self.same(at[live] - size if back else at[live], gap[live], size)
            low[live[equal]] = size[equal]
            high[live[~equal]] = size[~equal] - 1
            growing[live[~equal]] = False
            live, step = live[low[live] < high[live]], 2 * step
        return low


def _by_words(words: np.ndarray, at: int, gap: int, first: int, last: int) -> tuple[int, int]:
    """The maximal stretch of period gap around the pair (at, at + gap) in words first to last, by comparison."""
    equal = words[first : last - gap] == words[first + gap : last]
    wrong = np.flatnonzero(~equal) + first
    i = int(np.searchsorted(wrong, at))
    begin = int(wrong[i - 1]) + 1 if i else first
    return begin, (int(wrong[i]) if i < len(wrong) else last - gap) + gap


def find(words: np.ndarray, rows: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of the runs of all texts whose words begin at rows; ordered by begin, then period."""
    none = np.empty(0, np.int64)
    sizes = np.diff(rows)
    most = np.where(sizes >= least_words, sizes // least_periods, 0)
    if not most.sum():
        return none, none, none
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    order = np.argsort(period, kind="stable")
    text, period = text[order], period[order]
    half = np.maximum(1, np.maximum(least_words - period, (least_periods - 1) * period) // 2)
    points = np.maximum(0, (sizes[text] - period - half) // half + 1)
    ends = np.cumsum(points)
    prefixes = Prefixes(words)
    to, by = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)  # of a run at each place: its end and period
    found = []
    a = 0
    while a < len(text):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        for begin, end, q in _stretches(prefixes, rows, text[a:b], period[a:b], half[a:b], points[a:b], to, by, least_words, least_periods):
            found.append((begin, end, q))
            for i in np.argsort(end - begin, kind="stable").tolist():
                if end[i] - begin[i] > 4 * least_words:  # short ones aren't worth it
                    to[begin[i] : end[i]], by[begin[i] : end[i]] = end[i], q[i]
        a = b
    if not found:
        return none, none, none
    begin, end, q, _ = _least(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _least(begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of stretches of equal ends the one of the smallest period, and its place."""
    order = np.lexsort((q, end, begin))
    begin, end = begin[order], end[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return begin[first], end[first], q[order[first]], order[first]


def _stretches(prefixes: Prefixes, rows: np.ndarray, text: np.ndarray, period: np.ndarray, half: np.ndarray, points: np.ndarray, to: np.ndarray, by: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Begin, end and period of the maximal stretches around grid points that are long enough, each once; a long text's points come in parts."""
    words, total = prefixes.words, int(points.sum())
    base = np.cumsum(points) - points
    for k in range(0, total, BLOCK):
        number = np.arange(k, min(k + BLOCK, total))
        of = np.searchsorted(base, number, "right") - 1
        at = rows[text[of]] + (number - base[of]) * half[of]
        live = words[at] == words[at + period[of]]
        of, at = of[live], at[live]
        live = ~((to[at] > at + period[of]) & (period[of] % by[at] == 0))
        of, at = of[live], at[live]
        live = prefixes.same(at, period[of], half[of])
        of, at = of[live], at[live]
        gap = period[of]
        if not len(at):
            continue
        first, last = rows[text[of]], rows[text[of] + 1]
        back = prefixes.extend(at, gap, at - first, True)
        on = prefixes.extend(at, gap, last - gap - at, False)
        begin, end = at - back, at + on + gap  # where hashes are wrong, these are too far apart, never too near
        long = end - begin >= np.maximum(least_words, least_periods * gap)
        begin, end, gap, at, first, last = (x[long] for x in (begin, end, gap, at, first, last))
        *told, _ = _least(begin, end, gap)
        if _verified(words, *told).all():
            yield tuple(told)
            continue
        for i in np.flatnonzero(~_verified(words, begin, end, gap)).tolist():
            begin[i], end[i] = _by_words(words, int(at[i]), int(gap[i]), int(first[i]), int(last[i]))
        long = end - begin >= np.maximum(least_words, least_periods * gap)
        yield _least(begin[long], end[long], gap[long])[:3]


def _verified(words: np.ndarray, begin: np.ndarray, end: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Whether all words of each stretch equal those a period later."""
    size = end - begin - gap
    out, a = np.ones(len(size), bool), 0
    ends = np.cumsum(size)
    while a < len(size):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + 4 * BLOCK, "right")))
        if b == a + 1:
            out[a] = np.array_equal(words[begin[a] : end[a] - gap[a]], words[begin[a] + gap[a] : end[a]])
        else:
            n = size[a:b]
            of = np.repeat(np.arange(b - a), n)
            at = begin[a:b][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
            wrong = words[at] != words[at + gap[a:b][of]]
            out[a:b] = np.bincount(of, wrong, minlength=b - a) == 0
        a = b
    return out


def collapsed(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    at = np.flatnonzero(keep)
    size = words.end[at] - words.begin[at]
    row = np.searchsorted(words.rows, at, "right") - 1
    last = np.ones(len(at), bool)
    last[:-1] = row[1:] != row[:-1]
    width = size + ~last
    to = np.zeros(len(at) + 1, np.int64)
    np.cumsum(width, out=to[1:])
    data = np.full(int(to[-1]), 32, np.uint8)
    source = np.repeat(words.begin[at], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(to[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = words.data[source]
    offsets = to[np.searchsorted(at, words.rows)]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = T.ArrayType(T.StructType().add("start", "long", False).add("length", "long", False).add("period", "long", False))


def periodic_runs(df: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and text: without what repeats a run's first period."""
    if least_periods < 2 or least_words < 2:
        raise ValueError("a run has at least two periods and two words")
    schema = T.StructType().add("doc_id", "long").add("runs", RUNS).add("text", "string")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(1), NOT_SPACE):
                begin, end, period = find(words.hashes, words.rows, least_words, least_periods)
                gone = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, end, -1)
                row = np.searchsorted(words.rows, begin, "right") - 1
                found = pa.StructArray.from_arrays([pa.array(begin - words.rows[row]), pa.array(end - begin), pa.array(period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)), found)
                yield pa.record_batch([batch.column(0).slice(words.first, len(words)), lists, collapsed(words, np.cumsum(gone[:-1]) <= 0)], ["doc_id", "runs", "text"])

    return text_of(df, key, text).mapInArrow(look, schema)


def planted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, with periods planted where the checksum of the id ends in 0: from word a on, the p words from a repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def let(value: Column, f) -> Column:  # value is worked out once
        return F.transform(F.array(value), f)[0]

    def repeat(w: Column) -> Column:
        return let(F.size(w).cast("long"), lambda n: F.when(n > 0, let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)).cast("long"), lambda p: repeated(w, n, a, p)))))

    def repeated(w: Column, n: Column, a: Column, p: Column) -> Column:
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return text_of(df, key, text).select("doc_id", F.when(h % 10 == 0, let(words, repeat)).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    whole, none = F.col("runs"), F.lit(None).cast(RUNS.elementType)

    def higher(one: Column, other: Column) -> Column:
        """The run of the larger exact ratio of length and period; ties go to the first, as runs come by start, then period."""
        return F.when(one.isNull() | (other["length"] * one["period"] > one["length"] * other["period"]), other).otherwise(one)

    top = found.withColumn("top", F.aggregate(whole, none, higher))
    lines = F.array_join(F.transform(whole, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return top.select(
        "doc_id",
        F.size(whole).cast("long").alias("n_runs"),
        *(F.col("top")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("top")["length"] / F.col("top")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
