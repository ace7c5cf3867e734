"""Scores of templates: pyramids, linear scores, correlation, distance transforms, parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.runs import in_runs
from tessera.operators.small import SLICE_BYTES, along

#: Places of a line that are transformed together.
BLOCK = 1024


def pyramid_scales(images: DataFrame, key: str, width: str, height: str, interval: int = 10, least: int = 40) -> DataFrame:
    """key, level and scale 2^(1 - level / interval) up to the level at which the smaller side is `least` pixels; none if that is under one octave."""
    top = interval * F.ceil(F.round(F.log2(F.least(F.col(width), F.col(height)) / F.lit(float(least))), 9)).cast("int")
    levels = images.select(key, top.alias("top")).where(F.col("top") >= interval)
    return levels.select(key, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")).withColumn("scale", F.pow(F.lit(2.0), 1 - F.col("level") / F.lit(float(interval))))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double and within generated code."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best_component(cells: DataFrame, key: str, array: str, models: DataFrame, digits: int = 6, limit: int = SLICE_BYTES) -> DataFrame:
    """Per cell the component with the highest score; ties go to the lowest. models (component, weights) go to all tasks in slices of at most about `limit` bytes."""
    highest = F.array_max(F.transform("packed", lambda m: F.struct(F.round(dot(F.col(array), m["weights"]), digits).alias("score"), (-m["component"]).alias("rank"))))
    told = along(cells, models, "component", "weights", highest, F.greatest, limit)
    return told.select(key, (-F.col("best.rank")).alias("component"), F.col("best.score").alias("score"))


def correlate(grid: DataFrame, filters: dict[tuple[int, int], float]) -> DataFrame:
    """score(y, x) = sum of filter(dy, dx) * v(y + dy, x + dx) at the grid's cells; missing cells are 0.

    Each value is sent to the cells that it counts for, so sums meet in a grouped
    aggregation and no cell is compared with others.
    """
    taps = F.array(*(F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx"), F.lit(float(f)).alias("f")) for (dy, dx), f in filters.items()))
    sent = grid.select("y", "x", "v", F.explode(taps).alias("t")).select((F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.f")).alias("part"), ((F.col("t.dy") == 0) & (F.col("t.dx") == 0)).alias("own"))
    return sent.groupBy("y", "x").agg(F.sum("part").alias("score"), F.max("own").alias("own")).where("own").drop("own")


def _crossing(p, v, q, u, a: float, b: float):
    """Where the parabola of height u at q gets above that of height v at p < q; numbers, arrays or columns."""
    return (p + q) / 2 - b / (2 * a) + (u - v) / (2 * a * (q - p))


def _hull(values: np.ndarray, places: np.ndarray, a: float, b: float) -> tuple[list[int], list[float]]:
    """The parabolas that are on top somewhere, and where each begins to be; places ascend."""
    hull, cut = [0], [-np.inf]
    for j in range(1, len(values)):
        while True:
            k = hull[-1]
            at = _crossing(places[k], values[k], places[j], values[j], a, b)
            if at > cut[-1] or len(hull) == 1:
                break
            hull.pop()
            cut.pop()
        hull.append(j)
        cut.append(at)
    return hull, cut


def envelope(values: np.ndarray, places: np.ndarray, targets: np.ndarray, a: float, b: float) -> np.ndarray:
    """max over j of values[j] + a (i - p_j)^2 + b (i - p_j) for each target i; a < 0; places ascend.

    The parabolas' upper envelope, in time linear in values and targets.
    """
    hull, cut = _hull(values, places, a, b)
    owner = np.asarray(hull)[np.searchsorted(np.asarray(cut), targets, "right") - 1]
    d = targets - places[owner]
    return values[owner] + a * d * d + b * d


def distance_transform(grid: DataFrame, line: str, along: str, value: str, first: int, last: int, a: float, b: float, block: int = BLOCK) -> DataFrame:
    """For each line all places from first to last; a < 0.

    Lines of more than `block` places are cut into blocks. Each block keeps the parabolas
    that are on top somewhere, with the stretch where they are, bounded by the occupied
    blocks beside it; each is sent to the blocks that its stretch touches. So a group is
    a block and what reaches into it, however long a line is; of a whole line only a row
    a block meets.
    """

    def best_of(table: pa.Table, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places of a group and the best value of each."""
        places, values = (table.column(c).to_numpy()[begin:end] for c in (along, value))
        new = np.flatnonzero(np.diff(places, prepend=places[0] - 1))
        return places[new].astype(float), np.maximum.reduceat(values, new).astype(float)

    def of(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        lines, found, best = table.column(line).to_numpy(), [], []
        number = table.column("_block").to_numpy() if "_block" in table.column_names else None
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            places, values = best_of(table, begin, end)
            start = first if number is None else first + int(number[begin]) * block
            targets = np.arange(start, (last if number is None else min(last, start + block - 1)) + 1)
            found.append(targets)
            best.append(envelope(values, places - start, targets - float(start), a, b))
        return pa.record_batch([pa.array(np.repeat(lines[cuts[:-1]], list(map(len, found)))), pa.array(np.concatenate(found)), pa.array(np.concatenate(best))], [line, along, value])

    def on_top(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        kept, low, high = [], [], []
        number = table.column("_block").to_numpy()
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            places, values = best_of(table, begin, end)
            start = float(first + int(number[begin]) * block)
            hull, cut = _hull(values, places - start, a, b)
            cut = np.asarray([*cut, np.inf]) + start
            kept.append(begin + np.asarray(hull))
            low.append(cut[:-1])
            high.append(cut[1:])
        rows = pa.array(np.concatenate(kept))
        return pa.record_batch([*(table.column(c).combine_chunks().take(rows) for c in (line, along, value, "_block")), pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], [line, along, value, "_block", "_from", "_to"])

    out = f"{line} long, {along} long, {value} double"
    if last - first < block:
        lean = grid.select(F.col(line).cast("long").alias(line), F.col(along).cast("long").alias(along), F.col(value).cast("double").alias(value))
        return in_runs(lean, [line], [along], of, out)
    best = grid.groupBy(F.col(line).cast("long").alias(line), F.col(along).cast("long").alias(along)).agg(F.max(F.col(value).cast("double")).alias(value)).withColumn("_block", F.floor((F.col(along) - first) / F.lit(float(block))))
    ends = best.groupBy(line, "_block").agg(F.min(F.struct(along, value)).alias("_low"), F.max(F.struct(along, value)).alias("_high"))
    w = W.partitionBy(line).orderBy("_block")
    ends = ends.select(line, "_block", *(f(end, 1).over(w).alias(f"{end}_{side}") for side, f in (("before", F.lag), ("after", F.lead)) for end in ("_low", "_high")))
    kept = in_runs(best, [line, "_block"], [along], on_top, f"{line} long, {along} long, {value} double, _block long, _from double, _to double").join(ends, [line, "_block"])

    def left(end: str):
        return _crossing(F.col(f"{end}.{along}"), F.col(f"{end}.{value}"), F.col(along), F.col(value), a, b)

    def right(end: str):
        return _crossing(F.col(along), F.col(value), F.col(f"{end}.{along}"), F.col(f"{end}.{value}"), a, b)

    # Nulls are skipped: there is nothing beside the outermost blocks. One place more on each side for rounding.
    begin = F.greatest(F.lit(float(first)), F.greatest("_from", left("_low_before"), left("_high_before")) - 1)
    end = F.least(F.lit(float(last)), F.least("_to", right("_low_after"), right("_high_after")) + 1)
    sent = kept.select(line, along, value, begin.alias("_begin"), end.alias("_end")).where("_begin <= _end")
    number = (F.floor((F.col(c) - first) / F.lit(float(block))) for c in ("_begin", "_end"))
    return in_runs(sent.select(line, along, value, F.explode(F.sequence(*number)).alias("_block")), [line, "_block"], [along], of, out)


def combine_part(root: DataFrame, part: DataFrame, offset: tuple[int, int], bias: float) -> DataFrame:
    """Root score plus the part's at twice the coordinates, one octave finer; a root whose part place is missing falls out (its score is minus infinity)."""
    at = root.withColumn("py", 2 * F.col("y") + offset[0]).withColumn("px", 2 * F.col("x") + offset[1])
    placed = part.select(F.col("y").alias("py"), F.col("x").alias("px"), F.col("v").alias("part"))
    return at.join(placed, ["py", "px"]).select("y", "x", (F.col("v") + F.col("part") + F.lit(bias)).alias("score"))
