"""Operator 2, MinHash near-dedup by SetSketch registers.

A register is the least exponential value of a document's shingles, truncated to steps
that are spaced exponentially; the sketch of a union is the register-wise best, so
sketches merge. Bands of registers give buckets of candidates. A candidate pair's
registers are compared jointly: with the known set sizes, the numbers of greater, equal
and smaller registers give the likelihood of each similarity, and a pair goes on unless
the wanted similarity is that much less likely than the best one. What is left is
verified on the full sets of shingles.

Copies of one set are a class of their own from the start, and its least doc_id stands
for it. Within a bucket every document is compared with the bucket's least one first.
Only buckets that still hold more than one component after that are looked at further,
in units of bounded size, and only members of different components meet: those of a
large component meet the others, never each other. So links are found among all
candidates, and no step emits all pairs of a group.

Misses: a pair at the threshold shares a band but for (1 - t**ROWS)**BANDS, 6e-9 at
0.85, and is dropped by likelihood beyond Z standard deviations, 7e-5 at the threshold
itself and less above.

Defined results: null and empty texts have no shingles and no links; a null doc_id is
not linked and has a null component; rows of equal doc_id are one node, which is linked as
each of their texts is; an empty table gives an empty one. Texts are used whole; a task holds one run of about 1 MB or one longer
text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import drop, read, scratch, stash, text_of
from tessera.llm.words import NOT_SPACE, U64, Words, grams, mix, runs

SHINGLE, BANDS, ROWS = 5, 40, 6
#: The first BANDS * ROWS make up the bands; all of them count for the likelihood.
REGISTERS = 400
#: Base of the steps and rate of the exponential values; registers are of 16 bits.
STEP, RATE, TOP = 1.001, 20.0, 65535
#: A similarity is given up beyond so many standard deviations.
Z = 3.8
BLOCK = 512

_RANDOM = np.random.default_rng(20240217)
_TIMES = _RANDOM.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_CHUNK = 256


def shingle_sets(words: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a text of fewer words is one shingle."""
    all_of = grams(words.hashes, n)
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(all_of[a : b - n + 1])
        elif b > a:
            yield grams(words.hashes[a:b], b - a)
        else:
            yield np.empty(0, U64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of REGISTERS hash functions over a set; of no shingles, the greatest value there is."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), _CHUNK):
        np.minimum(out, (low[i : i + _CHUNK, None] * _TIMES + _PLUS).min(0), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Least uniform values as least exponential ones, truncated to exponentially spaced steps."""
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(STEP)), 0, TOP).astype(np.uint16)


def bands(sketches: np.ndarray) -> np.ndarray:
    """A bucket number for each band of each sketch."""
    parts = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS).astype(U64)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(sketches), BANDS)).copy()
    for i in range(ROWS):
        out = mix(out + parts[:, :, i])
    return out


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, wanted: float, z: float = Z) -> np.ndarray:
    """For pairs of sketches, whether a similarity of at least `wanted` is within z deviations of the likeliest one.

    With shares u and v of both sizes in their sum, a register of the one is greater with
    probability p(u - v J), and that of the other with p(v - u J), where p(x) is
    -log_b(1 - x (b - 1) / b).
    """
    share = (n_a / (n_a + n_b))[:, None]
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    most = np.minimum(n_a / n_b, n_b / n_a)[:, None]  # no similarity is above the ratio of sizes
    grid = np.concatenate([np.linspace(0, 1, 81), [wanted]])[None, :] * np.ones_like(most)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        def p(x):
            return -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP)

        j = np.minimum(j, most)
        up, down = p(share - (1 - share) * j), p((1 - share) - share * j)
        return more * np.log(up + 1e-12) + less * np.log(down + 1e-12) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    told = log_likelihood(grid)
    above = np.where(grid >= wanted, told, -np.inf).max(1)
    return (most[:, 0] >= wanted - 1e-9) & (2 * (told.max(1) - above) <= z * z)


def sketched(df: DataFrame) -> DataFrame:
    """From doc_id and text: doc_id, size and hash of the set, and sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in runs(batch.column(1), NOT_SPACE, lower=True):
                least = np.empty((len(words), REGISTERS), np.uint32)
                size, total, other = (np.empty(len(words), U64) for _ in range(3))
                for i, found in enumerate(shingle_sets(words)):
                    least[i], size[i], total[i], other[i] = minima(found), len(found), found.sum(), np.bitwise_xor.reduce(mix(found)) if len(found) else 0
                made = registers(least)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(words.first, len(words)),
                        pa.array(size.astype(np.int64)),
                        pa.array(mix(total).view(np.int64)),
                        pa.array(other.view(np.int64)),
                        pa.array([x.tobytes() for x in made], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return df.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def banded(sketches: DataFrame) -> DataFrame:
    """doc_id and bucket, a row for each band."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                numbers = bands(_matrix(batch.column(1)))
                yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(len(numbers)), BANDS))), pa.array(numbers.ravel().view(np.int64))], ["doc_id", "bucket"])

    return sketches.select("doc_id", "sketch").mapInArrow(deal, "doc_id long, bucket long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def estimated(pairs: DataFrame, sketches: DataFrame, wanted: float) -> DataFrame:
    """The pairs a, b whose sketches leave the wanted similarity likely."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").where(F.least("n_a", "n_b") >= F.lit(wanted) * F.greatest("n_a", "n_b") - 1e-6)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                good = likely(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b, wanted)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    return joined.mapInArrow(keep, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets of shingles are that similar. Of docs, only the texts of pairs are shuffled on."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts, texts_at = stash(docs.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")).hint("merge"), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b")).hint("merge"), "b").select("a", "b", "t_a", "t_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [(x for words in runs(batch.column(i), NOT_SPACE, lower=True) for x in shingle_sets(words)) for i in (2, 3)]
                good = []
                for one, two in zip(*sets, strict=True):
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    good.append(100 * both >= percent * (len(one) + len(two) - both))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    out, _ = stash(joined.mapInArrow(check, "a long, b long"))
    drop(docs.sparkSession, texts_at)
    return out


def dealt(members: DataFrame) -> DataFrame:
    """Groups in which every two members of one bucket and of different components meet. members: bucket, doc_id, component.

    A bucket's large components are cut into units of about BLOCK members each; members
    of small ones are dealt into units together. Two units form a group unless they are
    of one large component: its members are linked already. So a bucket of one large
    component and few others grows in proportion. (ic, ib) and (jc, jb) name the units,
    with negative numbers for those of small components; mine: whether a member is of
    the first.
    """
    sizes, _ = stash(members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m")))
    small = sizes.where(F.col("m") <= BLOCK).groupBy("bucket").agg(F.sum("m").alias("m")).select("bucket", F.lit(0).cast("long").alias("c"), F.ceil(F.col("m") / BLOCK).cast("int").alias("units"))
    large = sizes.where(F.col("m") > BLOCK).select("bucket", F.col("component").alias("c"), F.ceil(F.col("m") / BLOCK).cast("int").alias("units"))
    units = small.select("bucket", "c", F.explode(F.sequence(-F.col("units"), F.lit(-1))).alias("b")).union(large.select("bucket", "c", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("b")))
    units, _ = stash(units)
    one, two = (units.select("bucket", F.col("c").alias(f"{x}c"), F.col("b").alias(f"{x}b")) for x in "ij")
    ordered = (F.col("ib") < F.col("jb")) | ((F.col("ib") == F.col("jb")) & (F.col("ic") < F.col("jc")))
    within = (F.col("ib") == F.col("jb")) & (F.col("ic") == F.col("jc")) & (F.col("ib") < 0)
    apart = (F.col("ib") < 0) | (F.col("jb") < 0) | (F.col("ic") != F.col("jc"))
    groups, _ = stash(one.hint("merge").join(two.hint("merge"), "bucket").where(within | (ordered & apart)))
    placed = (
        members.join(sizes.hint("merge"), ["bucket", "component"])
        .join(small.select("bucket", F.col("units").alias("small")).hint("merge"), "bucket", "left")
        .withColumn("c", F.when(F.col("m") > BLOCK, F.col("component")).otherwise(F.lit(0).cast("long")))
        .withColumn("b", F.when(F.col("m") > BLOCK, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / BLOCK))).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.col("small"))).cast("int"))
        .select("bucket", "c", "b", "doc_id", "component")
    )
    first = placed.join(groups.withColumn("c", F.col("ic")).withColumn("b", F.col("ib")).hint("merge"), ["bucket", "c", "b"]).withColumn("mine", F.lit(True))
    second = placed.join(groups.where("ic <> jc OR ib <> jb").withColumn("c", F.col("jc")).withColumn("b", F.col("jb")).hint("merge"), ["bucket", "c", "b"]).withColumn("mine", F.lit(False))
    return first.union(second).select(*_GROUP, "mine", "doc_id", "component")


_GROUP = ["bucket", "ic", "ib", "jc", "jb"]


def across(members: DataFrame, sketches: DataFrame, wanted: float) -> DataFrame:
    """Likely pairs of different components in one bucket. members: bucket, doc_id and component.

    A pair that shares an earlier band is left to that one.
    """
    lean = sketches.select("doc_id", "n_shingles", "sketch")
    groups = dealt(members).join(lean.hint("merge"), "doc_id").repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cuts = _cuts(table)
            yield from _pairs(table, cuts[:-1], wanted)
            rest = table.slice(cuts[-2]) if len(cuts) > 1 else table
        if rest is not None and rest.num_rows:
            yield from _pairs(rest, _cuts(rest), wanted)

    return groups.mapInArrow(look, "a long, b long").distinct()


def _cuts(table: pa.Table) -> list[int]:
    """Where groups begin, and the end."""
    keys = [table.column(c).to_numpy() for c in _GROUP]
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]


def _pairs(table: pa.Table, cuts: list[int], wanted: float) -> Iterator[pa.RecordBatch]:
    if len(cuts) < 2:
        return
    doc, component, size, mine, ic, ib, jc, jb = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "mine", "ic", "ib", "jc", "jb"))
    bucket = table.column("bucket").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    numbers = bands(sketch).view(np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        one, two = np.triu_indices(b - a, 1)
        one, two = one + a, two + a
        apart = component[one] != component[two]
        if ic[a] != jc[a] or ib[a] != jb[a]:  # pairs within a unit belong to that unit's own group
            apart &= mine[one] != mine[two]
        one, two = one[apart], two[apart]
        for at in range(0, len(one), 8192):
            x, y = one[at : at + 8192], two[at : at + 8192]
            close = np.minimum(size[x], size[y]) >= wanted * np.maximum(size[x], size[y]) - 1e-6
            x, y = x[close], y[close]
            first = (numbers[x] == numbers[y]).argmax(1) if len(x) else x
            here = numbers[x, first] == bucket[a]
            x, y = x[here], y[here]
            if len(x):
                good = likely(sketch[x], sketch[y], size[x].astype(float), size[y].astype(float), wanted)
                found.append((doc[x[good]], doc[y[good]]))
    if found:
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


# Joins of two sides that both grow with the data ask for a sort-merge join, so that the
# plan is the same for small and large inputs and nothing of unknown size is broadcast.


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of df: documents whose sets of 5-word shingles have `percent` of their union in common are linked."""
    spark = df.sparkSession
    with scratch(spark) as kept:
        out, at = stash(_near_duplicates(text_of(df, key, text), percent))
        kept.append(at)
    return out


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """Documents are nodes by id. Where ids repeat with different texts, each such text is a node of its own, and nodes of one id are linked."""
    spark = docs.sparkSession
    rows = docs.withColumn("row", F.xxhash64("text"))
    lean = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    several, _ = stash(lean.where("low < high").select("doc_id", F.lit(True).alias("many")))
    if several.isEmpty():
        return _linked(docs, percent)
    node = F.when(F.col("many"), F.xxhash64("doc_id", "row")).otherwise(F.col("doc_id"))
    named, _ = stash(rows.join(several.hint("merge"), "doc_id", "left").select(node.alias("node"), "doc_id", "text"))
    told, _ = stash(_linked(named.select(F.col("node").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("node"), "n_shingles", "component_id"))
    own, _ = stash(named.where("node IS NOT NULL").select("node", "doc_id").distinct())
    both, _ = stash(own.join(told.where("node IS NOT NULL").select("node", F.col("component_id").alias("part")).distinct().hint("merge"), "node"))
    first, _ = stash(both.groupBy("doc_id").agg(F.min("part").alias("a")))
    more = components(both.join(first.hint("merge"), "doc_id").select("a", F.col("part").alias("b")))
    joined, _ = stash(both.join(more.select(F.col("node").alias("part"), "component").hint("merge"), "part", "left").select("doc_id", "node", F.coalesce("component", "part").alias("whole")))
    least, _ = stash(joined.groupBy("whole").agg(F.min("doc_id").alias("component_id")))
    of, _ = stash(joined.join(least.hint("merge"), "whole").select("node", "doc_id", "component_id"))
    out = told.select("node", "n_shingles").join(of.hint("merge"), "node", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    spark, wanted = docs.sparkSession, percent / 100
    sketches, _ = stash(sketched(docs))
    same = ["set_a", "set_b", "n_shingles"]
    # A table of its own: Spark splits a hot class only where both sides of the join come from a plain exchange.
    classes, _ = stash(sketches.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")))
    lone = sketches.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    entries = banded(lone)
    shared = entries.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    shared, shared_at = stash(shared)
    members, members_at = stash(entries.join(shared.hint("merge"), "bucket"))
    drop(spark, shared_at)
    # First every document with the least one of each of its buckets.
    stars = members.where("least < doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    first, first_at = stash(estimated(stars, sketches, wanted))
    links = verified(first, docs, percent)
    joined = components(links)
    # Then buckets that still hold several components.
    of = members.join(joined.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    mixed, _ = stash(of.join(mixed.hint("merge"), "bucket", "left_semi"))
    drop(spark, members_at)
    second, _ = stash(across(mixed, sketches, wanted).join(first.hint("merge"), ["a", "b"], "left_anti"))
    drop(spark, first_at)
    if not second.isEmpty():
        more = verified(second, docs, percent)
        if not more.isEmpty():
            joined = components(links.union(more))
    least = sketches.select("doc_id", *same).join(classes.hint("merge"), same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    out = least.join(joined.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of df, with all their columns, whose document stands for its group. Of rows with equal id and text one stays.

    Rows with a null id or without words stay, one of equal ones. Columns go by place,
    so they may have any name.
    """
    spark, names = df.sparkSession, df.columns
    own = [f"c{i}" for i in range(len(names))]
    rows, k, t = df.toDF(*own), own[names.index(key)], own[names.index(text)]
    with scratch(spark) as kept:
        gone, gone_at = stash(near_duplicates(df, key, text, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct())
        many, many_at = stash(df.toDF(*own).groupBy(F.col(k).alias("many")).count().where("count > 1").select("many"))
        kept += [gone_at, many_at]
    rest = rows.join(gone.hint("merge"), F.col(k).cast("long") == F.col("gone"), "left_anti")
    if not many.isEmpty():
        same = F.col(k).eqNullSafe(F.col("many"))
        rest = rest.join(many, same, "left_anti").union(rest.join(many, same, "left_semi").dropDuplicates([k, t]))
    return rest.toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)
