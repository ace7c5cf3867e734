"""Tables between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.small import SLICE_BYTES


def held(df: DataFrame) -> DataFrame:
    """df, worked out and written to the folder of spark.checkpoint.dir, which cuts its lineage.

    Where that is unset, a temporary folder in local mode, as in tests; an error elsewhere.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def beside(df: DataFrame, table: DataFrame, on: list[str], size: Column, limit: int = SLICE_BYTES) -> DataFrame:
    """df joined with a held table of one row a key, whose rows have about `size` bytes.

    The table is measured: up to `limit` bytes it is sent along. Beyond that both meet by a
    sort-merge join, of which Spark splits large keys, as both sides are plain exchanges.
    """
    total = table.agg(F.sum(size.cast("long"))).first()[0] or 0
    return df.join(F.broadcast(table) if total <= limit else table.hint("merge"), on)
