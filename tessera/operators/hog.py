"""Feature extractors over arrays in columns: histograms of oriented gradients, projections, a registry.

An image is height, width, depth and 8-bit samples, row by row. A task works on the
images of an Arrow batch one by one; images never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP, TEXTURE, ORIENTATIONS = 0.2, 0.2357, 18


def image_of(data: bytes, height: int, width: int, depth: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, depth)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, by halves while both sides stay large enough, rounded to 8 bits each time; pixel centres at one half, edges repeated."""
    out = image

    def step(x: np.ndarray, h: int, w: int) -> np.ndarray:
        def axis(n: int, m: int):
            at = (np.arange(m) + 0.5) * n / m - 0.5
            low = np.floor(at).astype(int)
            return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), (at - low)

        a, b, f = axis(x.shape[0], h)
        x = x[a] * (1 - f)[:, None, None] + x[b] * f[:, None, None]
        a, b, f = axis(x.shape[1], w)
        return x[:, a] * (1 - f)[None, :, None] + x[:, b] * f[None, :, None]

    def rounded(x: np.ndarray, h: int, w: int) -> np.ndarray:
        return np.clip(step(x.astype(np.float64), h, w) + 0.5, 0, 255).astype(np.uint8)

    scale = 0.5
    while height <= (half := int(image.shape[0] * scale + 0.5)) and width <= (wide := int(image.shape[1] * scale + 0.5)):
        out, scale = rounded(out, half, wide), scale / 2
    return out if out.shape[:2] == (height, width) else rounded(out, height, width)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int, padded: bool = False) -> np.ndarray:
    """The part of a box that lies in the image; padded, the whole box with reflected edges."""
    if not padded:
        return image[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]

    def places(first: int, n: int, size: int) -> np.ndarray:
        at = np.arange(first, first + n) % (2 * size)
        return np.where(at < size, at, 2 * size - 1 - at)

    return image[places(y, h, image.shape[0])][:, places(x, w, image.shape[1])]


def hog(image: np.ndarray, cell: int = 8) -> np.ndarray:
    """rows x columns x 32: 18 signed and 9 unsigned orientations, 4 of texture, 1 for cells beyond the edge (0 here).

    The image is padded by a cell, whose features are cut off again.
    """
    if cell < 2 or cell % 2:
        raise ValueError("the cell size must be a positive even number")
    rows, cols = (image.shape[0] + cell // 2) // cell, (image.shape[1] + cell // 2) // cell
    if not rows or not cols:
        return np.zeros((rows, cols, 32))
    x = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)), mode="edge")
    dx, dy = x[1:-1, 2:] - x[1:-1, :-2], x[2:, 1:-1] - x[:-2, 1:-1]
    power = dx * dx + dy * dy
    best = power.argmax(2)[:, :, None]  # the channel of the steepest gradient
    dx, dy = (np.take_along_axis(v, best, 2)[:, :, 0] for v in (dx, dy))
    size = np.sqrt(np.take_along_axis(power, best, 2)[:, :, 0])
    angle = (np.arctan2(dy, dx) / (2 * np.pi) * ORIENTATIONS) % ORIENTATIONS
    low = np.floor(angle).astype(int)
    share = angle - low
    # Each pixel counts for the two nearest orientations and the four nearest cells.
    h, w = size.shape
    hist = np.zeros((rows + 2, cols + 2, ORIENTATIONS))

    def axis(n: int):
        at = (np.arange(n) + 0.5) / cell - 0.5
        first = np.floor(at).astype(int)
        return first + 1, at - first

    (y0, fy), (x0, fx) = axis(h), axis(w)
    for dyc, wy in ((0, 1 - fy), (1, fy)):
        for dxc, wx in ((0, 1 - fx), (1, fx)):
            at_y, at_x = np.minimum(y0 + dyc, rows + 1)[:, None], np.minimum(x0 + dxc, cols + 1)[None, :]
            weight = size * wy[:, None] * wx[None, :]
            np.add.at(hist, (at_y, at_x, low % ORIENTATIONS), weight * (1 - share))
            np.add.at(hist, (at_y, at_x, (low + 1) % ORIENTATIONS), weight * share)
    half = ORIENTATIONS // 2
    unsigned = hist[:, :, :half] + hist[:, :, half:]
    energy = (unsigned**2).sum(2)
    block = energy[:-1, :-1] + energy[:-1, 1:] + energy[1:, :-1] + energy[1:, 1:]
    # The four blocks that a cell is part of.
    norms = 1 / np.sqrt(np.stack([block[a : a + rows, b : b + cols] for a in (0, 1) for b in (0, 1)], 2) + np.finfo(np.float32).eps)
    inner, plain = hist[1:-1, 1:-1], unsigned[1:-1, 1:-1]
    signed = np.minimum(inner[:, :, None, :] * norms[:, :, :, None], CLIP)
    out = np.zeros((rows, cols, 32))
    out[:, :, :18] = 0.5 * signed.sum(2)
    out[:, :, 18:27] = 0.5 * np.minimum(plain[:, :, None, :] * norms[:, :, :, None], CLIP).sum(2)
    out[:, :, 27:31] = TEXTURE * signed.sum(3)
    return out


#: For each channel of a mirrored image, the channel of the image: orientations turn about the vertical axis, blocks change sides.
MIRROR = [(9 - i) % 18 for i in range(18)] + [18 + (9 - i) % 9 for i in range(9)] + [28, 27, 30, 29, 31]


def flip(features: np.ndarray) -> np.ndarray:
    return features[:, ::-1][:, :, MIRROR]


@dataclass(frozen=True)
class Extractor:
    """A named way to features; equal parameters make equal extractors, so their plans can be shared."""

    name: str
    extract: Callable = field(compare=False)
    parameters: tuple[tuple[str, object], ...] = ()

    def __call__(self, image: np.ndarray) -> np.ndarray:
        return self.extract(image, **dict(self.parameters))

    def set(self, **changes) -> Extractor:
        known = dict(self.parameters)
        if unknown := set(changes) - set(known):
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        return Extractor(self.name, self.extract, tuple(sorted((known | changes).items())))


EXTRACTORS = {"HOG": Extractor("HOG", hog, (("cell", 8),)), "raw": Extractor("raw", lambda image: image.astype(float) / 255)}


def pyramid(image: np.ndarray, extractor: Extractor, interval: int = 10, least: int = 5, cell: int = 8) -> Iterator[tuple[int, float, np.ndarray]]:
    """Level, scale and features: the first octave at twice the resolution has cells of half the size."""
    smallest = min(image.shape[1], image.shape[0]) / (least * cell)
    top = interval * int(np.ceil(np.log2(smallest))) if smallest > 0 else 0
    if top < interval:
        return
    for k in range(top + 1):
        scale = 2.0 ** (1 - k / interval)
        fine = scale > 1 and extractor.name == "HOG"
        by = scale / 2 if fine else scale
        w, h = int(image.shape[1] * by + 0.5), int(image.shape[0] * by + 0.5)
        level = image if by == 1 else resize(image, w, h)
        yield k, scale, (extractor.set(cell=cell // 2) if fine else extractor)(level)


def pyramids(images: DataFrame, key: str, extractor: Extractor, interval: int = 10, least: int = 5, cell: int = 8) -> DataFrame:
    """key, level, scale, rows, cols, channels and data of each level; images have height, width, depth and data."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = [(row[0], k, scale, *f.shape, f.astype(np.float32).ravel()) for k, scale, f in pyramid(image_of(row[4], row[1], row[2], row[3]), extractor, interval, least, cell)]
                yield pd.DataFrame(out, columns=[key, "level", "scale", "rows", "cols", "channels", "data"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "depth", "data").where("data IS NOT NULL").mapInPandas(build, f"{key} {kind}, level int, scale double, rows int, cols int, channels int, data array<float>")


def joined_layers(layers: DataFrame, key: str) -> DataFrame:
    """key, rows, cols, channels and data: the layers of each image put together at the resolution of the first.

    layers has key, layer (from 0), rows, cols, channels, data, and cell_w and cell_h: how many
    cells of the first layer one of its cells spans. A cell of the first layer takes the
    channels of the cell that it lies in; what a layer falls short of is shared by both
    edges, which take its nearest cells. An image without a layer 0, or with an empty
    layer, has no row. A group is one image's layers.
    """
    own = F.struct("layer", *(F.col(c).cast("int").alias(c) for c in ("rows", "cols", "channels", "cell_w", "cell_h")), "data")
    packed = layers.groupBy(key).agg(F.sort_array(F.collect_list(own)).alias("_layers")).where((F.col("_layers")[0]["layer"] == 0) & F.forall("_layers", lambda x: x["rows"] * x["cols"] > 0))
    first = F.col("_layers")[0]

    def near(at: Column, size: Column, cell: Column, whole: Column) -> Column:
        edge = F.floor(F.greatest(F.lit(0), whole - size * cell) / 2)
        return F.greatest(F.lit(0), F.least(size - 1, F.floor((at - edge) / cell)))

    def cell(i: Column) -> Column:
        y, x = F.floor(i / first["cols"]), i % first["cols"]
        return F.flatten(F.transform("_layers", lambda of: F.slice(of["data"], ((near(y, of["rows"], of["cell_h"], first["rows"]) * of["cols"] + near(x, of["cols"], of["cell_w"], first["cols"])) * of["channels"] + 1).cast("int"), of["channels"])))

    data = F.flatten(F.transform(F.sequence(F.lit(0), first["rows"] * first["cols"] - 1), cell))
    return packed.select(key, first["rows"].alias("rows"), first["cols"].alias("cols"), F.aggregate("_layers", F.lit(0), lambda n, x: n + x["channels"]).alias("channels"), data.alias("data"))


def scaled(cell: Column, scales: list[float]) -> Column:
    """Each channel by its own largest value."""
    return F.zip_with(cell, F.array(*(F.lit(float(s)) for s in scales)), lambda x, s: x.cast("double") / F.when(s != 0, s).otherwise(F.lit(1.0)))


def projected(cell: Column, mean: list[float], axes: list[list[float]]) -> Column:
    """(x - mean) A, with A's columns as lists."""
    centred = F.zip_with(cell, F.array(*(F.lit(float(m)) for m in mean)), lambda x, m: x.cast("double") - m)
    return F.array(*(F.aggregate(F.zip_with(centred, F.array(*(F.lit(float(a)) for a in axis)), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) for axis in axes))
