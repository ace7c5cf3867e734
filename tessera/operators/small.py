"""Small tables that go along with every row: measured first, and cut into slices that may be sent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table that are sent to all tasks at once.
SLICE_BYTES = 64 << 20


def along(df: DataFrame, small: DataFrame, name: str, array: str, best: Column, better: Callable[..., Column], limit: int = SLICE_BYTES) -> DataFrame:
    """df with a column best: the better of `best` over the slices of `small`, whose rows (name, array) it sees as the array column packed.

    The table is counted first. Up to `limit` bytes it is one array; a larger one is dealt
    into slices by hash, each an array of its own. An empty one gives nulls.
    """
    told = small.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(array)).alias("size")).first()
    number = max(1, -(-told["n"] * 8 * (told["size"] or 0) // limit))
    out, found = df, []
    for i in range(number):
        own = small.where(F.pmod(F.xxhash64(name), F.lit(number)) == i) if number > 1 else small
        packed = own.agg(F.sort_array(F.collect_list(F.struct(name, array))).alias("packed"))
        out = out.join(F.broadcast(packed)).withColumn(f"_best{i}", best).drop("packed")
        found.append(f"_best{i}")
    return out.withColumn("best", better(*found) if number > 1 else F.col(found[0])).drop(*found)
