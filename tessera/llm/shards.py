"""Operator 13, sharding by a permutation of global row numbers.

1. Rows get numbers 0 to N - 1 in the order of their keys: a range exchange of lean rows
   (key, size, checksum, and a number of the input's row that splits large groups of equal
   keys), sorted within partitions, and one count for each partition. The driver sees these
   counts only.
2. A Feistel network over the least even number of bits that holds N permutes the numbers;
   a value of N or more is permuted again until it falls below N (cycle walking), which is
   a permutation of 0 to N - 1, as the walk follows one cycle of the larger one.
3. The row at place p of the shuffled order is in shard p mod S, at slot p div S. So
   counts of shards differ by one at most and slots have no gaps, and `place` and its
   inverse `number` tell a row's shard and slot, or the row of a shard and slot, from
   numbers alone, without any table.

The order depends on the rows and the seed only, not on partitions, files or executors.

Defined results: a null text has no bytes; rows of null keys come first; rows of equal
keys are ordered by checksum and size, and rows equal in these too are interchangeable, as
their results are made of nothing else. An empty table gives an empty one. Other columns
aren't read. Texts are used whole and don't leave the task that reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import on_path, read, scratch, stash, text_of

SHARDS, SEED, ROUNDS = 24, 20240131, 8
#: Odd multipliers below 2**31, so that products of 31 bits stay below 2**62 (and SQL can repeat them).
_MIX = (0x2C1B3C6D, 0x297A2D39)
_31 = (1 << 31) - 1


def keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Round keys of 31 bits."""
    return [int.from_bytes(hashlib.sha256(f"{seed} {i}".encode()).digest()[:4], "big") & _31 for i in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of half a number below n, at least one."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (x + key) & _31
    for m, s in zip(_MIX, (15, 13), strict=True):
        x = (x * m) & _31
        x ^= x >> s
    return x & mask


def _network(x: np.ndarray, bits: int, order: list[int], backwards: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in order:
        if backwards:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return left << bits | right


def _walked(x: np.ndarray, n: int, seed: int, backwards: bool) -> np.ndarray:
    x = np.array(x, np.int64)
    if len(x) and not 0 <= int(x.min()) <= int(x.max()) < n:
        raise ValueError(f"numbers must be from 0 to {n - 1}")
    bits, order = half_bits(n), keys(seed)[:: -1 if backwards else 1]
    at = np.arange(len(x))
    while len(at):
        x[at] = _network(x[at], bits, order, backwards)
        at = at[x[at] >= n]
    return x


def place(number: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Where rows of these numbers stand in the shuffled order of n rows; n is at most 2**62."""
    return _walked(number, n, seed, False)


def number(place: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The numbers of the rows at these places: the inverse of place()."""
    return _walked(place, n, seed, True)


def numbered(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """df with `number`, from 0 by ascending `by`, and the number of rows. Its tables are in the shared folder; see shared.scratch."""
    spread, _ = stash(df.withColumn("_at", F.monotonically_increasing_id()))
    ordered, _ = stash(spread.repartitionByRange(*by, "_at").sortWithinPartitions(*by, "_at").drop("_at").withColumn("_at", F.monotonically_increasing_id()))
    # _at is the partition's number, shifted by 33 bits, plus the place within it.
    counts = sorted(ordered.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    total, before = 0, []
    for part, count in counts:
        before.append((part, total))
        total += count
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    joined = ordered.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_part"))
    return joined.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before"), total


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, number, shard and slot of each row."""
    on_path(df.sparkSession)
    data = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    lean = text_of(df, key, text).select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows, n = numbered(lean, ["doc_id", "text_crc32", "size"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column("number").to_numpy(), n, seed)
            yield pa.record_batch([*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], [*batch.schema.names, "shard", "slot"])

    return rows.mapInArrow(deal, "doc_id long, size long, text_crc32 long, number long, shard int, slot long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        out, at = stash(shuffled(read(spark, sf_dir, "documents")))
        kept.append(at)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number")


def sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same in SQL: checksums by a table of 256, and the walk as a recursive statement."""
    half = "CAST(greatest(1, (CASE WHEN n <= 1 THEN 0 ELSE length(ltrim(bin(n - 1), '0')) END + 1) // 2) AS INTEGER)"
    x, steps = "((r + k) & 2147483647)", []
    for m, s in zip(_MIX, (15, 13), strict=True):
        steps.append((m, s))
    f1 = f"(({x} * {steps[0][0]}) & 2147483647)"
    f2 = f"((xor({f1}, {f1} >> {steps[0][1]}) * {steps[1][0]}) & 2147483647)"
    f = f"(xor({f2}, {f2} >> {steps[1][1]}) & ((1::BIGINT << h) - 1))"
    return f"""
WITH RECURSIVE bits AS (SELECT b, 0 AS i, b::BIGINT AS c FROM range(256) t(b) UNION ALL SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE i = 8),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents, crc),
numbers AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number, count(*) OVER () AS n FROM docs),
ks AS (SELECT {keys(seed)}::BIGINT[] AS ks),
walk AS (
  SELECT number, n, {half} AS h, number >> {half} AS l, number & ((1::BIGINT << {half}) - 1) AS r, 1 AS i FROM numbers
  UNION ALL
  SELECT number, n, h, r, xor(l, {f}), CASE WHEN i = {ROUNDS} AND ((r << h) | xor(l, {f})) >= n THEN 1 ELSE i + 1 END
  FROM (SELECT walk.*, ks[i] AS k FROM walk, ks WHERE i <= {ROUNDS})),
placed AS (SELECT number, (l << h) | r AS p FROM walk WHERE i = {ROUNDS + 1})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, p // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, number
FROM numbers JOIN placed USING (number)"""
