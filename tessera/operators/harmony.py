"""Joint thresholds of several models: exhaustive for two, harmony search for more.

An object counts once if any model finds it at or above its threshold; false hits add
up over models. Scores are on a grid, and detections are reduced to counts before any
search: how many objects have which best bins, and how many false hits fall into which
bin of which model.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Improvisations of a run, and runs.
ROUNDS, RUNS = 100_000, 16
#: Combinations of bins that a task may hold.
MOST = 1_000_000
_DRAWN = 4096


def _counts(objects: DataFrame, hits: DataFrame, keys: list[str], models: int) -> tuple[DataFrame, DataFrame]:
    best = hits.groupBy(*keys).agg(*(F.max(F.when(F.col("model") == m, F.col("bin"))).alias(f"b{m}") for m in range(models)))
    cols = [F.coalesce(f"b{m}", F.lit(-1)).alias(f"b{m}") for m in range(models)]
    found = objects.join(best, keys, "left").select(*cols).groupBy(*(f"b{m}" for m in range(models))).agg(F.count(F.lit(1)).alias("n"))
    false = hits.join(objects, keys, "left_anti").groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"))
    return found, false


def joint_f_grid(objects: DataFrame, hits: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """bin_a, bin_b, tp, fp and F of two models for every pair of thresholds.

    An object is missed by a pair if both its best bins are below: missed objects are sums
    over a corner of the table of counts, built up along one side and then along the other;
    false hits are sums from a bin on, of each model by itself. So the work is bins squared
    rows, in windows of one line each, whatever the data.
    """
    found, false = _counts(objects, hits, keys, 2)
    spark, total = objects.sparkSession, objects.count()
    place = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    cells = spark.range(bins).select(F.col("id").cast("int").alias("bin_a"), place.alias("bin_b"))
    # Bins of -1 stand for no hit: moved by one, a bin below bin_a is one of at most bin_a.
    counts = found.select((F.col("b0") + 1).alias("bin_a"), (F.col("b1") + 1).alias("bin_b"), "n").groupBy("bin_a", "bin_b").agg(F.sum("n").alias("n"))
    along = {c: W.partitionBy(o).orderBy(c).rowsBetween(W.unboundedPreceding, 0) for c, o in (("bin_a", "bin_b"), ("bin_b", "bin_a"))}
    missed = cells.join(counts, ["bin_a", "bin_b"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(along["bin_b"])).withColumn("n", F.sum("n").over(along["bin_a"]))
    lines = spark.range(2).select(F.col("id").cast("int").alias("model"), place.alias("bin")).join(false, ["model", "bin"], "left")
    above = lines.select("model", "bin", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("model").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)).alias("n"))
    a, b = (above.where(F.col("model") == m).select(F.col("bin").alias(f"bin_{c}"), F.col("n").alias(f"f_{c}")) for m, c in ((0, "a"), (1, "b")))
    told = missed.join(a, "bin_a").join(b, "bin_b").select("bin_a", "bin_b", (F.lit(total) - F.col("n")).cast("long").alias("tp"), (F.col("f_a") + F.col("f_b")).cast("long").alias("fp"))
    bottom = F.col("tp") + F.col("fp") + F.lit(total)
    return told.withColumn("f_measure", F.when(bottom > 0, 2.0 * F.col("tp") / bottom).otherwise(F.lit(0.0)))


def harmony(objective, sizes: list[int], seed: int, rounds: int = ROUNDS, memory: int = 30, consider: float = 0.9, pitch: float = 0.3) -> tuple[list[int], float]:
    """The best indices found: new ones are taken from memory or drawn, moved by one now and then, and replace the worst."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, sizes, (memory, len(sizes))).tolist()
    values = [objective(tuple(p)) for p in pool]
    worst = int(np.argmin(values))
    for begin in range(0, rounds, _DRAWN):
        n = min(_DRAWN, rounds - begin)
        taken, moved = rng.random((n, len(sizes))) < consider, rng.random((n, len(sizes))) < pitch
        row, step, fresh = rng.integers(0, memory, (n, len(sizes))), rng.integers(0, 2, (n, len(sizes))) * 2 - 1, rng.integers(0, sizes, (n, len(sizes)))
        step = np.where(moved, step, 0)
        for take, at, by, new in zip(taken.tolist(), row.tolist(), step.tolist(), fresh.tolist(), strict=True):
            for i, size in enumerate(sizes):
                if take[i]:
                    new[i] = min(max(pool[at[i]][i] + by[i], 0), size - 1)
            value = objective(tuple(new))
            if value > values[worst]:
                pool[worst], values[worst] = new, value
                worst = values.index(min(values))
    best = int(np.argmax(values))
    return pool[best], values[best]


def search(objects: DataFrame, hits: DataFrame, keys: list[str], sizes: list[int], seed: int, runs: int = RUNS, rounds: int = ROUNDS, b: float = 1.0) -> DataFrame:
    """thresholds (bins) and F of the best of several seeded runs, one task each.

    What goes along are counts by combination of bins, as many rows as combinations occur:
    MOST at most, else an error that asks for a coarser grid.
    """
    found, false = _counts(objects, hits, keys, len(sizes))
    told = found.limit(MOST + 1).collect()
    if len(told) > MOST:
        raise ValueError(f"over {MOST} combinations of bins occur; take fewer bins a model")
    best = np.array([tuple(r) for r in told], np.int64).reshape(-1, len(sizes) + 1)
    wrong = [np.zeros(n + 1) for n in sizes]
    for r in false.collect():
        wrong[r["model"]][r["bin"]] += r["n"]
    above = [np.cumsum(w[::-1])[::-1].tolist() for w in wrong]
    total = int(best[:, -1].sum())

    def run(batches):
        import pandas as pd

        @functools.lru_cache(1 << 16)
        def objective(at: tuple[int, ...]) -> float:
            tp = int(best[(best[:, :-1] >= np.asarray(at)).any(1), -1].sum())
            fp = sum(a[i] for a, i in zip(above, at, strict=True))
            bottom = tp + fp + b * b * total
            return (1 + b * b) * tp / bottom if bottom else 0.0

        for pdf in batches:
            rows = [harmony(objective, sizes, seed + int(i), rounds) for i in pdf["id"]]
            yield pd.DataFrame({"thresholds": [r[0] for r in rows], "f_measure": [r[1] for r in rows]})

    done = objects.sparkSession.range(0, runs, 1, runs).mapInPandas(run, "thresholds array<int>, f_measure double")
    return done.orderBy(F.desc("f_measure"), "thresholds").limit(1)
