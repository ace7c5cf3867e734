"""The tables that stand in for images, boxes, scores and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each event: image = user, x = day, y = hour."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("image"), "event_type", F.dayofmonth("ts").cast("long").alias("x"), F.hour("ts").cast("long").alias("y"), (4 + F.col("event_id") % 9).alias("w"), (4 + (F.col("event_id") * 7) % 11).alias("h"), F.col("value").alias("score"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values summed by user (y) and day (x)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("y"), F.dayofmonth("ts").cast("long").alias("x")).agg(F.round(F.sum("value"), 6).alias("v"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box sizes: h = quantity of a line, w = size of its part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_type", F.col("l_quantity").cast("double").alias("h"), F.col("p_size").cast("double").alias("w"))


#: The same as common table expressions.
BOXES = "boxes AS (SELECT event_id, user_id AS image, event_type, CAST(day(ts) AS BIGINT) AS x, CAST(hour(ts) AS BIGINT) AS y, 4 + event_id % 9 AS w, 4 + (event_id * 7) % 11 AS h, value AS score FROM events)"
GRID = "grid AS (SELECT user_id AS y, CAST(day(ts) AS BIGINT) AS x, round(sum(value), 6) AS v FROM events GROUP BY ALL)"
SIZES = "sizes AS (SELECT p_type, CAST(l_quantity AS DOUBLE) AS h, CAST(p_size AS DOUBLE) AS w FROM lineitem JOIN part ON l_partkey = p_partkey)"
CELLS = "cells AS (SELECT vec_id, label, CAST(i AS INTEGER) AS ch, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i))"
INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
