"""Operator 12, ranked lexical search over document-sharded postings.

1. One pass over the texts counts documents with terms (N) and terms (L): sums of two
   numbers a task.
2. A second pass writes the index, a table of shards. A shard is a run of whole documents,
   about 4 MB of text or one longer text: their ids, the hashes of their terms in order,
   where each term's postings begin, and for each posting the document's place and its
   impact, a whole number that holds everything but the term's weight.
3. A search sends the items' terms along, in slices of bounded size. Document frequencies
   are sums of posting counts by term, from the shards' lists of terms only.
4. Per shard and item, terms are taken one at a time: weight times impact is added into a
   dense array of the shard's documents. The k best are chosen by argpartition, with
   all ties of the k-th score, and put in order by id. A task keeps the k best of each item
   over its shards; those of tasks are merged in two steps of windows by item.

Shards never meet before that, so one word or text that a third of all documents hold
costs no more there than elsewhere. Terms are known by 64-bit hashes: a term of an item
is taken for another one of the corpus with a probability of about 2**-64 for each pair.

Defined results: null texts, or texts without terms, are in no result and don't count in
N; rows of equal doc_id are documents of their own; equal scores go by ascending doc_id,
null ids last. Each row of items has a ranking of its own, also where item_ids repeat; an
item without terms, or whose terms no document holds, has no rows. Empty tables give
empty ones. Other columns aren't read. Numbers are 64-bit, products beyond that are
worked out as Python's integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import drop, read, scratch, stash, text_of
from tessera.llm.words import ALNUM, U64, Words, runs

TOP = 10
SHARD_BYTES, SLICE_BYTES = 4 << 20, 1 << 20
#: Groups in which the best rows of tasks are merged first.
_MERGERS = 64


def counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms, of doc_id and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for words in runs(batch.column(0), ALNUM, lower=True):
                n += int(np.count_nonzero(np.diff(words.rows)))
                total += len(words.begin)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = docs.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def lengths(n_terms: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with so many terms: 25 at no length, 100 at the mean."""
    if len(n_terms) and 75 * int(n_terms.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * n * n_docs // total for n in n_terms.tolist()], np.int64)
    return 25 + 75 * n_terms.astype(np.int64) * n_docs // max(total, 1)


def _shard(words: Words, n_docs: int, total: int) -> tuple[np.ndarray, ...]:
    """Terms in order of hash, where their postings begin (and the last end), and places and impacts of postings."""
    sizes = np.diff(words.rows)
    doc = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    order = np.lexsort((doc, words.hashes))
    term, doc = words.hashes[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(term)))
    term, doc = term[first], doc[first]
    head = np.ones(len(term), bool)
    head[1:] = term[1:] != term[:-1]
    begin = np.flatnonzero(head)
    m = lengths(sizes, n_docs, total)[doc]
    if len(tf) and int(tf.max()) >= 1 << 33:
        raise OverflowError("a term occurs more than 2**33 times in one text")
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
    return term[begin], np.append(begin, len(term)), doc, impact


INDEX = "doc_ids array<bigint>, terms array<bigint>, begins array<int>, docs array<int>, impacts array<int>"
#: A row group is one shard. Parquet's writer else looks at its size only after 100 rows, and Spark's reader makes arrays of a whole row group (up to 4096 rows) at once.
ALONE = {"parquet.block.row.count.limit": "1"}
#: Documents are read without Parquet's vectored reads, with which the JVM's memory outside its heap grows with the row groups.
IN_TURN = {"parquet.hadoop.vectored.io.enabled": "false"}


def _one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(kind.to_pandas_dtype())))


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, str]:
    """The index as a table, the number of documents with terms, and the table's path (for shared.drop)."""
    docs = text_of(df, key, text)
    n_docs, total = counted(docs)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(1), ALNUM, lower=True, run_bytes=shard_bytes):
                ids = batch.column(0).slice(words.first, len(words))
                terms, begins, places, impacts = _shard(words, n_docs, total)
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _one(terms.view(np.int64), pa.int64()), _one(begins, pa.int32()), _one(places, pa.int32()), _one(impacts, pa.int32())],
                    ["doc_ids", "terms", "begins", "docs", "impacts"],
                )

    out, path = stash(docs.mapInArrow(index, INDEX), ALONE)
    return out, n_docs, path


class Items:
    """A slice of items: its distinct terms in order, and for each item its terms' places and how often it repeats them."""

    def __init__(self, first: int, texts: list[str]) -> None:
        self.first, self.n = first, len(texts)
        found = list(runs(pa.array(texts, pa.string()), ALNUM, lower=True, run_bytes=1 << 62))
        hashes = found[0].hashes if found else np.empty(0, U64)
        rows = found[0].rows if found else np.zeros(1, np.int64)
        self.terms, at = np.unique(hashes, return_inverse=True)
        pairs = [np.unique(at[a:b], return_counts=True) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.term = [t for t, _ in pairs]
        self.times = [n.astype(np.int64) for _, n in pairs]
        self.weight = np.zeros(len(self.terms), np.int64)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these sorted terms of a shard are in the slice: their places here and there."""
        at = np.searchsorted(terms, self.terms)
        known = np.flatnonzero(at < len(terms))
        known = known[terms[at[known]] == self.terms[known]]
        return known, at[known]


def slices(items: DataFrame, key: str, text: str, limit: int) -> Iterator[tuple[list, Items]]:
    """Ids and terms of items, in slices of bounded size; an item is never cut."""
    ids, texts, size, first = [], [], 0, 0
    for row in text_of(items, key, text).toLocalIterator():
        ids.append(row.doc_id)
        texts.append(row.text or "")
        size += len(texts[-1].encode()) + 64
        if size >= limit:
            yield ids, Items(first, texts)
            ids, texts, size, first = [], [], 0, first + len(ids)
    if ids:
        yield ids, Items(first, texts)


def weigh(index: DataFrame, n_docs: int, items: Items) -> None:
    """Sets the weights of the slice's terms from their document frequencies."""
    sent = index.sparkSession.sparkContext.broadcast(items.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                here = _list(batch.column(0), i).view(U64)
                at = np.searchsorted(here, terms)
                known = np.flatnonzero(at < len(here))
                known = known[here[at[known]] == terms[known]]
                begins = _list(batch.column(1), i)
                df[known] += begins[at[known] + 1] - begins[at[known]]
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], ["term", "df"])

    for row in index.select("terms", "begins").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        items.weight[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    sent.destroy()


def _list(column: pa.Array, i: int) -> np.ndarray:
    """The i-th list of a column, as numpy."""
    begin, end = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(begin, end - begin).to_numpy(zero_copy_only=False)


def best(score: np.ndarray, ids: np.ndarray, absent: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` highest scores above 0, equal ones by ascending id, absent ids last; in this order."""
    if len(score) > top:
        least = np.partition(score, len(score) - top)[len(score) - top]
        at = np.flatnonzero(score >= max(int(least), 1))
    else:
        at = np.flatnonzero(score > 0)
    return at[np.lexsort((ids[at], absent[at], -score[at]))[:top]]


class _Ranking:
    """The best documents of each item so far."""

    def __init__(self, items: Items, top: int) -> None:
        none = np.empty(0, np.int64)
        self.items, self.top = items, top
        self.rows: list[tuple[np.ndarray, ...]] = [(none, none, np.empty(0, bool))] * items.n
        #: The score that a document needs to get in; at the top's last score it may, by its id.
        self.needs = np.ones(items.n, np.int64)

    def add(self, ids: np.ndarray, absent: np.ndarray, terms: np.ndarray, begins: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        items, top = self.items, self.top
        known, at = items.places(terms)
        begin, end = np.zeros(len(items.terms), np.int64), np.zeros(len(items.terms), np.int64)
        begin[known], end[known] = begins[at], begins[at + 1]
        score = np.empty(len(ids), np.int64)
        for i in range(items.n):
            term = items.term[i]
            held = end[term] > begin[term]
            if not held.any():
                continue
            score[:] = 0
            term = term[held]
            for a, b, w in zip(begin[term].tolist(), end[term].tolist(), (items.weight[term] * items.times[i][held]).tolist(), strict=True):
                score[docs[a:b]] += w * impacts[a:b]
            may = np.flatnonzero(score >= self.needs[i])
            if not len(may):
                continue
            chosen = may[best(score[may], ids[may], absent[may], top)]
            rows = tuple(np.concatenate(x) for x in zip(self.rows[i], (score[chosen], ids[chosen], absent[chosen]), strict=True))
            order = best(*rows, top)
            self.rows[i] = tuple(x[order] for x in rows)
            if len(order) == top:
                self.needs[i] = self.rows[i][0][-1]


def search(index: DataFrame, n_docs: int, items: DataFrame, top: int = TOP, key: str = "item_id", text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """item (a number of the row of items), item_id, rank, doc_id and score. One pass over the index a slice of items."""
    spark, parts = index.sparkSession, []
    for ids, one in slices(items, key, text, limit):
        weigh(index, n_docs, one)
        found, _ = stash(_merged(_ranked(index, one, top), top))
        names = spark.createDataFrame([(one.first + i, x) for i, x in enumerate(ids)], "item long, item_id long")
        parts.append(found.join(F.broadcast(names), "item"))
    if not parts:
        return index.select(F.lit(0).cast("long").alias("item"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("item", "item_id", "rank", "doc_id", "score")


def _ranked(index: DataFrame, items: Items, top: int) -> DataFrame:
    """item, score, doc_id: the best of each task."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = _Ranking(sent.value, top)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0).values.slice(batch.column(0).offsets[i].as_py(), batch.column(0).offsets[i + 1].as_py() - batch.column(0).offsets[i].as_py())
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                ranking.add(ids.fill_null(0).to_numpy(), absent, _list(batch.column(1), i).view(U64), *(_list(batch.column(c), i).astype(np.int64) for c in (2, 3, 4)))
        score, ids, absent = (np.concatenate([r[k] for r in ranking.rows]) if ranking.rows else np.empty(0, np.int64) for k in range(3))
        item = np.repeat(np.arange(len(ranking.rows)), [len(r[0]) for r in ranking.rows]) + sent.value.first
        yield pa.record_batch([pa.array(item.astype(np.int64)), pa.array(score), pa.array(ids, mask=absent.astype(bool))], ["item", "score", "doc_id"])

    return index.select("doc_ids", "terms", "begins", "docs", "impacts").mapInArrow(rank, "item long, score long, doc_id long")


def _merged(rows: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = Window.partitionBy("item", "_part").orderBy(*order)
    some = rows.withColumn("_part", F.spark_partition_id() % _MERGERS).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("_part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        index, n_docs, path = build_index(read(spark, sf_dir, "documents", IN_TURN))
        out, at = stash(search(index, n_docs, read(spark, sf_dir, "benchmark")))
        kept.append(at)
        drop(spark, path)
    return out.select("item_id", "rank", "doc_id", "score")


def sql(top: int = TOP) -> str:
    """The same in SQL."""
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {terms} AS terms FROM documents),
sizes AS (SELECT doc, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM sizes),
items AS (SELECT row_number() OVER () AS item, item_id, unnest({terms}) AS term FROM benchmark),
query AS (SELECT item, item_id, term, count(*) AS times FROM items GROUP BY ALL),
postings AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM query) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
impacts AS (SELECT doc, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total)) AS impact FROM postings JOIN sizes USING (doc), totals),
scores AS (SELECT item, item_id, doc, doc_id, sum(times * w * impact)::BIGINT AS score FROM query JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {top}"""
