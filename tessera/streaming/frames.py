"""Live frames: the latest of each key, and rates over the last frames; as tables and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(frames: DataFrame, keys: list[str], time: str, frame: str) -> DataFrame:
    """The last frame of each key; earlier ones are dropped. Works on tables and on streams."""
    return frames.groupBy(*keys).agg(F.max(F.struct(time, frame)).alias("m")).select(*keys, F.col(f"m.{frame}").alias(frame), F.col(f"m.{time}").alias(time))


def rate(frames: DataFrame, key: str, time: str, frame: str, n: int) -> DataFrame:
    """Frames per second over the last n frames, where there are as many; null if they share one instant."""
    w = W.partitionBy(key).orderBy(time, frame)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    told = frames.select(key, frame, micros.alias("t"), F.lag(micros, n - 1).over(w).alias("first")).where("first IS NOT NULL")
    return told.select(key, frame, F.when(F.col("t") > F.col("first"), F.lit((n - 1) * 1e6) / (F.col("t") - F.col("first"))).alias("rate"))


def watch(frames: DataFrame, keys: list[str], time: str, frame: str, late: str = "1 hour"):
    """A stream of frames, as a streaming query to be started: the latest frame of each key so far, in update mode."""
    return latest(frames.withWatermark(time, late), keys, time, frame).writeStream.outputMode("update")
