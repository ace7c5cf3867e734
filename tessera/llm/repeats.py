"""Operator 3, substring dedup: prefix-partitioned suffix trees over words.

A window of 13 words that repeats is an internal node of depth 13 in the tree of all
suffixes, and a longer maximal repeat is a run of such nodes one word apart. The tree is
built in parts:

1. Suffixes are split by prefixes. A window is in the part of the suffix sampled in it:
   the one whose 5-word prefix has the least hash. Equal windows sample equal prefixes.
   A prefix that one document alone has leads to leaves only, and its windows are done
   with. Of the others, the sizes of their parts are counted.
2. Windows that follow each other and sample one prefix are shipped as one segment of
   text, so words that windows share are shipped once. A task takes its parts one after
   another and sorts all suffixes of a part's segments by prefix doubling: ranks by one
   word make those by two, four and eight, and these the ranks by 13. Suffixes of equal
   rank are a node, and the least document below it keeps its words.
3. A part of more than GROUP suffixes gets longer prefixes: whole windows, each a node
   by itself. What such a node needs, its least document, is summed up before the
   shuffle and goes back to its windows by a join whose large side Spark may split, as
   the sums are a table of their own by then. So a passage that a third of all documents
   share is spread over tasks, and no task holds more than a part of GROUP suffixes.

A row is known by doc_id and a hash of its text, so what is gathered for a row is bounded
by its own text, even where an id repeats.

Defined results: a null or empty text has no words; texts of fewer words than a window
lose none; an empty table gives an empty one. Windows of a row with a null doc_id count
for nothing and stay; a window that repeats within one document only stays; rows with
equal doc_id are one document each, and none is before the other. Windows are judged on
the input. Texts are used whole; a task holds one run of about 1 MB or one longer text
at a time. Columns go by place, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import drop, read, stash, text_of
from tessera.llm.words import NOT_SPACE, U64, Words, grams, mix, runs

WINDOW, PREFIX = 13, 5
#: Suffixes of a part that a task holds as one tree; larger parts get longer prefixes.
GROUP = 4096
_OTHER = U64(0xA24BAED4963EE407)


def _windows(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within a text: its first word, its text's row, and its sampled prefix."""
    total = len(words.hashes) - window + 1
    if total <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    at = np.flatnonzero(words.left()[:total] >= window)
    short = grams(words.hashes, prefix)
    least = short[:total].copy()
    for i in range(1, window - prefix + 1):
        np.minimum(least, short[i : i + total], out=least)
    row = np.repeat(np.arange(len(words)), np.diff(words.rows))
    return at, row[at], least[at]


def sampled(df: DataFrame, window: int, prefix: int) -> DataFrame:
    """prefix, doc_id and row, for each sampled suffix of doc_id, text and row."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(1), NOT_SPACE):
                _, of, least = _windows(words, window, prefix)
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
                here, take = batch.slice(words.first, len(words)), pa.array(of[new])
                yield pa.record_batch([pa.array(least[new].view(np.int64)), here.column(0).take(take), here.column(2).take(take)], ["prefix", "doc_id", "row"])

    return df.mapInArrow(sample, "prefix long, doc_id long, row long")


def segments(df: DataFrame, window: int, prefix: int) -> DataFrame:
    """From doc_id, text, row, its repeated prefixes and the hot ones among them: what goes to a tree, and what is a node by itself.

    The first have prefix, doc_id, row and segment: the words of consecutive windows that
    sample this prefix. The others have node and check (hashes of a whole window), doc_id
    and row, once for each row.
    """

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(1), NOT_SPACE):
                here = batch.slice(words.first, len(words))
                at, of, least = _windows(words, window, prefix)
                tied = _tied(least, of)
                keep = np.isin(tied, _tied(*_listed(here.column(3))))
                at, of, least, tied = at[keep], of[keep], least[keep], tied[keep]
                hot = np.isin(tied, _tied(*_listed(here.column(4))))
                node = grams(words.hashes, window)
                one = at[hot][np.unique(_tied(node[at[hot]], of[hot]), return_index=True)[1]]
                at, of, least = at[~hot], of[~hot], least[~hot]
                new = np.ones(len(at), bool)
                new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1 if len(at) else first
                text = _slices(words.data, words.begin[at[first]], words.end[at[last] + window - 1])
                row = np.searchsorted(words.rows, one, "right") - 1
                check = (grams(mix(words.hashes ^ _OTHER), window)[one] >> U64(32)).astype(np.uint32).view(np.int32)
                take = pa.array(np.concatenate([of[first], row]))
                yield pa.record_batch(
                    [
                        pa.concat_arrays([pa.array(least[first].view(np.int64)), pa.nulls(len(one), pa.int64())]), here.column(0).take(take), here.column(2).take(take), pa.concat_arrays([text, pa.nulls(len(one), pa.binary())]),
                        pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(node[one].view(np.int64))]), pa.concat_arrays([pa.nulls(len(first), pa.int32()), pa.array(check)]),
                    ],
                    ["prefix", "doc_id", "row", "segment", "node", "check"],
                )

    return df.mapInArrow(ship, "prefix long, doc_id long, row long, segment binary, node long, check int")


def _listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of lists, and the row of each."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(U64), np.repeat(np.arange(len(lists)), lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of data, which may overlap, as binary values."""
    size = end - begin
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    gathered = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(gathered)]).cast(pa.binary())


def ranked(hashes: np.ndarray, window: int) -> np.ndarray:
    """The rank of the `window` words from each place on among all such, by prefix doubling; equal words have equal ranks."""
    rank, n = np.unique(hashes, return_inverse=True)[1].astype(np.int64), 1
    while n < window and len(rank):
        step = min(n, window - n)
        both = rank[: max(0, len(rank) - step)] * (rank.max() + 1) + rank[step:]
        rank, n = np.unique(both, return_inverse=True)[1].astype(np.int64), n + step
    return rank


def subtrees(pieces: DataFrame, window: int) -> DataFrame:
    """doc_id, row and node for windows that start in a smaller document too, of segments sorted by their prefix."""

    def grow(table: pa.Table) -> pa.RecordBatch:
        (words,) = runs(table.column(3), NOT_SPACE, run_bytes=1 << 62)
        rank = ranked(words.hashes, window)
        at = np.flatnonzero(words.left()[: len(rank)] >= window)
        row = np.searchsorted(words.rows, at, "right") - 1
        rank, doc = rank[at], table.column(1).to_numpy()[row]
        order = np.lexsort((doc, rank))
        head = np.ones(len(order), bool)
        head[1:] = rank[order][1:] != rank[order][:-1]
        least = doc[order][head][np.cumsum(head) - 1] if len(order) else doc
        later = order[doc[order] > least]
        node = grams(words.hashes, window)[at[later]]
        take = pa.array(row[later])
        return pa.record_batch([table.column(1).combine_chunks().take(take), table.column(2).combine_chunks().take(take), pa.array(node.view(np.int64))], ["doc_id", "row", "node"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            prefix = table.column(0).to_numpy()
            whole = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if len(prefix) and prefix[0] != prefix[-1] else 0
            if whole:
                yield grow(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield grow(rest)

    return pieces.select("prefix", "doc_id", "row", "segment").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(look, "doc_id long, row long, node long")


def _tied(prefix: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(prefix + row.astype(U64) * _OTHER)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id and row of rows whose whole text a smaller document has too."""
    lean = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row", F.hash("text").alias("b"), F.octet_length("text").alias("n"))
    least, least_at = stash(lean.groupBy("row", "b", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    out, _ = stash(lean.join(least.hint("merge"), ["row", "b", "n"]).where("least < doc_id").select("doc_id", "row").distinct())
    drop(docs.sparkSession, least_at)
    return out


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, row (hash of its text) and nodes: those of its windows that start in a smaller document too.

    A copy of a smaller document has null nodes, for all of its windows do; what else
    it shares it shares with the other one, so its windows go no further.
    """
    docs = text_of(df, key, text).withColumn("row", F.xxhash64("text"))
    spark, own = df.sparkSession, ["doc_id", "row"]
    whole = copies(docs)
    suffixes = sampled(docs.where("doc_id IS NOT NULL"), window, prefix)
    shared = suffixes.groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("prefix", F.when(F.col("n") > GROUP, F.col("prefix")).alias("hot"))
    shared, shared_at = stash(shared)
    kept = suffixes.join(shared.hint("merge"), "prefix").groupBy(*own).agg(F.collect_set("prefix").alias("prefixes"), F.collect_set("hot").alias("hot")).join(whole, own, "left_anti")
    kept, kept_at = stash(kept)
    drop(spark, shared_at)
    pieces, pieces_at = stash(segments(docs.join(kept.hint("merge"), own).select("doc_id", "text", "row", "prefixes", "hot"), window, prefix))
    drop(spark, kept_at)
    nodes = pieces.where("node IS NOT NULL").select("node", "check", *own)
    least, least_at = stash(nodes.groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    later = nodes.join(least.hint("merge"), ["node", "check"]).where("least < doc_id").select(*own, "node")
    cold = subtrees(pieces.where("segment IS NOT NULL"), window)
    found = cold.unionByName(later).groupBy(*own).agg(F.collect_set("node").alias("nodes"))
    out, _ = stash(found.unionByName(whole.withColumn("nodes", F.lit(None).cast("array<bigint>"))))
    drop(spark, pieces_at, least_at)
    return out


def cut(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, always: bool = False) -> DataFrame:
    """df with its text without the words of windows that repeated() found, and n_words and n_removed (as the last columns).

    Kept words are joined by one space; a text that loses none stays as it is, unless always.
    """
    names = df.columns
    at = names.index(text)
    # Columns go by place under names of their own, so that those of df may have any names.
    own = [f"c{i}" for i in range(len(names))]
    rows = df.toDF(*own).withColumn(own[at], F.col(own[at]).cast("string"))
    known = found.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("nodes").alias("_nodes"), F.col("nodes").isNull().alias("_whole"))
    same = (rows[own[names.index(key)]].cast("long") == F.col("_doc")) & (F.xxhash64(rows[own[at]]) == F.col("_row"))
    joined = rows.join(known.hint("merge"), same, "left").select(*own, "_nodes", "_whole")
    schema = T.StructType([*rows.schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(at), NOT_SPACE):
                part = batch.slice(words.first, len(words))
                gone = _covered(words, part.column(len(names)), part.column(len(names) + 1), window)
                n_words = np.diff(words.rows)
                removed = np.bincount(np.repeat(np.arange(len(words)), n_words), gone, minlength=len(words)).astype(np.int64)
                texts = []
                for old, n, first, last in zip(part.column(at).to_pylist(), removed.tolist(), words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
                    if n:
                        texts.append(b" ".join([w for w, g in zip(old.encode().split(), gone[first:last].tolist(), strict=True) if not g]).decode())
                    else:
                        texts.append(b" ".join((old or "").encode().split()).decode() if always else old)
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))]
                yield pa.record_batch([*columns, pa.array(n_words.astype(np.int64)), pa.array(removed)], schema.fieldNames())

    return joined.mapInArrow(remove, schema).toDF(*names, "n_words", "n_removed")


def _covered(words: Words, lists: pa.Array, whole: pa.Array, window: int) -> np.ndarray:
    """Which words are in a window that goes."""
    total = len(words.hashes) - window + 1
    gone = np.zeros(len(words.hashes) + 1, np.int64)
    if total > 0:
        begins = np.flatnonzero(words.left()[:total] >= window)
        row = np.repeat(np.arange(len(words)), np.diff(words.rows))[begins]
        hit = np.isin(_tied(grams(words.hashes, window)[begins], row), _tied(*_listed(lists))) | whole.fill_null(False).to_numpy(zero_copy_only=False)[row]
        gone[begins[hit]] += 1
        np.add.at(gone, begins[hit] + window, -1)
    return np.cumsum(gone[:-1]) > 0


def passages(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, first_word, n_words and passage: the longest stretches of words that windows of smaller documents cover."""
    docs = text_of(df, key, text).withColumn("row", F.xxhash64("text"))
    found = repeated(df, key, text, window).withColumn("whole", F.col("nodes").isNull())
    joined = docs.join(found.hint("merge"), ["doc_id", "row"]).select("doc_id", "text", "nodes", "whole")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(1), NOT_SPACE):
                here = batch.slice(words.first, len(words))
                gone = _covered(words, here.column(2), here.column(3), window)
                of = np.repeat(np.arange(len(words)), np.diff(words.rows))
                edge = np.ones(len(gone), bool)
                edge[1:] = (of[1:] != of[:-1]) | (gone[1:] != gone[:-1])
                first = np.flatnonzero(edge)
                last = np.append(first[1:], len(gone)) if len(gone) else first
                first, last = first[gone[first]], last[gone[first]]
                row = of[first]
                text = [b" ".join(words.data[words.begin[a] : words.end[b - 1]].tobytes().split()).decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.record_batch([here.column(0).take(pa.array(row)), pa.array(first - words.rows[row]), pa.array(last - first), pa.array(text, pa.string())], ["doc_id", "first_word", "n_words", "passage"])

    return joined.mapInArrow(look, "doc_id long, first_word long, n_words long, passage string")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with all its columns and rows, its text without repeated passages."""
    out = cut(df, repeated(df, key, text, window), key, text, window)
    own = [f"c{i}" for i in range(len(out.columns))]
    return out.toDF(*own).select(*own[:-2]).toDF(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_of(read(spark, sf_dir, "documents"), "doc_id", "text")
    return cut(docs, repeated(docs), always=True).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
