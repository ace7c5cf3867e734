"""Sequential work on groups: a task takes its groups in sorted order, many at a time, as Arrow tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_runs(df: DataFrame, by: list[str], order: list[Column | str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """work(table, cuts) for runs of whole groups; group g has the rows from cuts[g] to cuts[g + 1], sorted by `order`.

    A group is held in memory by one task; a call gets about a batch of rows, or one
    larger group. The last column of the table tells groups apart.
    """
    marked = df.withColumn("_group", F.xxhash64(*by))
    sorted_ = marked.repartition(*by).sortWithinPartitions("_group", *by, *order)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = table.column("_group").to_numpy()
            if not len(group):
                continue
            last = int(np.searchsorted(group, group[-1], "left"))  # sorted by it, so the last group begins here
            if last or (rest and rest[-1].column("_group")[-1].as_py() != group[0]):
                whole = pa.concat_tables([*rest, table.slice(0, last)]).combine_chunks()
                rest = []
                yield work(whole, _cuts(whole))
            rest.append(table.slice(last))
        if rest:
            whole = pa.concat_tables(rest).combine_chunks()
            yield work(whole, _cuts(whole))

    return sorted_.mapInArrow(look, schema)


def _cuts(table: pa.Table) -> np.ndarray:
    group = table.column("_group").to_numpy()
    return np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
