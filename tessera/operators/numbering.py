"""Places of rows in an order of all of them, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import held

_BITS = 33


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df, held in order of `by`, with each row's place in it, from 0.

    A range exchange and a sort within partitions; the places are those within a partition
    plus the rows of the partitions before, of which the driver sees one count for each.
    Rows of equal `by` must be equal, or their places may be exchanged.
    """
    ordered = held(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted(ordered.groupBy(F.shiftright("_at", _BITS).alias("part")).count().collect())
    total, before = 0, []
    for part, count in counts:
        before.append((part, total))
        total += count
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    joined = ordered.join(F.broadcast(offsets), F.shiftright("_at", _BITS) == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_at", "_part", "_before")
