"""Boxes as columns x, y, w, h; right and bottom are inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a: str, b: str) -> Column:
    """Area that the boxes in the columns with these prefixes share."""

    def side(x: str, w: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(f"{a}{x}") + F.col(f"{a}{w}"), F.col(f"{b}{x}") + F.col(f"{b}{w}")) - F.greatest(f"{a}{x}", f"{b}{x}"))

    return (side("x", "w") * side("y", "h")).cast("long")


def area(prefix: str = "") -> Column:
    return (F.greatest(F.lit(0), F.col(f"{prefix}w")) * F.greatest(F.lit(0), F.col(f"{prefix}h"))).cast("long")


def iou(a: str, b: str) -> Column:
    shared = intersection(a, b)
    return shared.cast("double") / (area(a) + area(b) - shared)


def project(scale: Column, cell: int, border: int, width: Column, height: Column) -> dict[str, Column]:
    """Boxes in cells of a pyramid level to pixels of the image, cut to it; empty ones have w or h of 0 or less."""

    def place(c: str) -> Column:
        return (F.col(c) / scale + 0.5).cast("int") * cell + border

    def size(c: str) -> Column:
        return (F.col(c) / scale + 0.5).cast("int") * cell

    left, top = F.greatest(F.lit(0), place("x")), F.greatest(F.lit(0), place("y"))
    right, bottom = F.least(width, place("x") + size("w")), F.least(height, place("y") + size("h"))
    return {"px": left, "py": top, "pw": right - left, "ph": bottom - top}


def crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part of a box that lies in an image."""
    left, top = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(0), F.least(x + w, width) - left).alias("w"), F.greatest(F.lit(0), F.least(y + h, height) - top).alias("h"))


def boxes_or_whole(boxes: Column, width: Column, height: Column) -> Column:
    """Whole-image box where there are no boxes or any of them is empty."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), width.cast("long").alias("w"), height.cast("long").alias("h")))
    bad = F.coalesce(F.size(boxes), F.lit(0)) < 1
    return F.when(bad | F.exists(boxes, lambda b: (b["w"] <= 0) | (b["h"] <= 0)), whole).otherwise(boxes)


def cells_to_pixels(cells: Column, cell: int, border: int = 0) -> Column:
    """A size in cells as one in pixels, borders included."""
    return cells * cell + 2 * border


def pixels_to_cells(pixels: Column, cell: int, border: int = 0, nearest: bool = False) -> Column:
    """The other way: whole cells, or the nearest number of them."""
    inner = pixels - 2 * border
    return F.floor(inner / cell + 0.5).cast("int") if nearest else F.floor(inner / cell).cast("int")


def cell_to_pixel(place: Column, cell: int, border: int = 0) -> Column:
    """A coordinate in cells as one in pixels."""
    return place * cell + border


def aspect_ratio(w: Column, h: Column) -> Column:
    return h.cast("double") / w
