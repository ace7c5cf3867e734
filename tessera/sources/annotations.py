"""Annotations in markup: boxes of objects in images, and attributes of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "filename string, size struct<width: int, height: int, depth: int>, object array<struct<name: string, pose: string, truncated: int, difficult: int, bndbox: struct<xmin: int, ymin: int, xmax: int, ymax: int>>>"


def objects(df: DataFrame, key: str, xml: str, image_width: str | None = None, image_height: str | None = None) -> DataFrame:
    """A row per annotated box that lies inside its image, right of x = 0 and below y = 0.

    With the image's true size, boxes are scaled from the annotation's size to it. Of a
    name the first word counts; boxes without a right or bottom side fall out.
    """
    parsed = df.withColumn("a", F.from_xml(xml, SCHEMA, {"rowTag": "annotation"}))
    width = F.col(image_width) if image_width else F.col("a.size.width")
    height = F.col(image_height) if image_height else F.col("a.size.height")
    o = parsed.select(key, width.alias("iw"), height.alias("ih"), (width / F.col("a.size.width")).alias("sx"), (height / F.col("a.size.height")).alias("sy"), F.explode("a.object").alias("o"))
    b = o.where("o.bndbox.xmax <> 0 AND o.bndbox.ymax <> 0").select(
        key, "iw", "ih",
        F.element_at(F.split(F.trim("o.name"), r"\s+"), 1).alias("name"), F.col("o.pose").alias("pose"),
        (F.coalesce("o.truncated", F.lit(0)) != 0).alias("truncated"), (F.coalesce("o.difficult", F.lit(0)) != 0).alias("difficult"),
        (F.col("o.bndbox.xmin") * F.col("sx")).cast("int").alias("x"), (F.col("o.bndbox.ymin") * F.col("sy")).cast("int").alias("y"),
        ((F.col("o.bndbox.xmax") - F.col("o.bndbox.xmin") + 1) * F.col("sx")).cast("int").alias("w"), ((F.col("o.bndbox.ymax") - F.col("o.bndbox.ymin") + 1) * F.col("sy")).cast("int").alias("h"),
    )
    return b.where("x > 0 AND y > 0 AND w > 0 AND h > 0 AND x + w <= iw AND y + h <= ih").drop("iw", "ih")


def attributes(df: DataFrame, key: str, markup: str, tag: str, name: str) -> DataFrame:
    """How many tags have the attribute, and the least and greatest value; rows without any fall out."""
    found = F.regexp_extract_all(markup, F.lit(rf'<{tag}\s[^>]*{name}="([^"]*)"'), F.lit(1))
    return df.select(key, found.alias("v")).where(F.size("v") > 0).select(key, F.size("v").cast("long").alias("n"), F.array_min("v").alias("first"), F.array_max("v").alias("last"))
