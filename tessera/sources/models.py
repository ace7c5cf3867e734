"""Model files, background statistics, feature pyramids, projections and scales; and result tables.

Files are small driver-side objects or values of a binary column; parsing is per value.
"""

from __future__ import annotations

import io
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First word of a background file, or-ed with its version.
MAGIC = 0x04667900


@dataclass
class Part:
    weights: np.ndarray  # rows, columns, channels
    offset: tuple[int, int] = (0, 0)
    deformation: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


@dataclass
class Component:
    parts: list[Part]
    bias: float


@dataclass
class Model:
    components: list[Component]
    extractor: str = "HOG"
    parameters: dict[str, str] = field(default_factory=dict)


_STRING = re.compile(r"(\S+)\s+\{str\{\s*(.*?)\s*\}str\}|(\S+)\s+(\S+)")


def _headed(text: str) -> tuple[str, dict[str, str], str]:
    """Extractor, parameters, and the text from the number of components on."""
    first, _, rest = text.lstrip().partition("\n")
    if re.fullmatch(r"\s*\d+\s*", first):
        return "HOG", {}, text
    line, _, body = rest.partition("\n")
    return first.strip(), {m[1] or m[3]: m[2] if m[1] else m[4] for m in _STRING.finditer(line)}, body


def parse_model(text: str) -> Model:
    """Both versions: the second has the extractor's type and a line of parameters in front. The root's deformation is zero."""
    extractor, parameters, body = _headed(text)
    tokens = iter(body.split())
    return Model([_component(tokens) for _ in range(int(next(tokens)))], extractor, parameters)


def parse_components(text: str, head: bool = False) -> Iterator[Component]:
    """The components of a piece of a model file, one by one; head tells that it is the first piece."""
    tokens = (m[0] for m in re.finditer(r"\S+", _headed(text)[2] if head else text))
    if head:
        next(tokens)
    for first in tokens:
        yield _component(itertools.chain([first], tokens))


def _component(tokens: Iterator[str]) -> Component:
    def take(kind=float, n=1):
        return [kind(next(tokens)) for _ in range(n)]

    (n,), (bias,) = take(int), take()
    parts = []
    for i in range(n):
        rows, cols, channels, ox, oy = take(int, 5)
        deformation = take(float, 4)
        weights = np.array(take(float, rows * cols * channels), np.float32).reshape(rows, cols, channels)
        parts.append(Part(weights, (ox, oy), tuple(deformation) if i else (0.0,) * 4))
    return Component(parts, bias)


def format_head(extractor: str, parameters: dict[str, str], components: int) -> str:
    """The lines of a model file before its components."""

    def value(v: str) -> str:
        try:
            float(v)
            return str(v)
        except ValueError:
            return f"{{str{{ {v} }}str}}"

    return f"{extractor}\n{' '.join(f'{k} {value(v)}' for k, v in parameters.items())}\n{components}\n"


def format_component(c: Component) -> str:
    out = [f"{len(c.parts)} {c.bias!r}"]
    for p in c.parts:
        out.append(" ".join(map(str, (*p.weights.shape, *p.offset, *p.deformation))))
        out.append(" ".join(repr(float(x)) for x in p.weights.ravel()))
    return "\n".join(out) + "\n"


def format_model(model: Model) -> str:
    return format_head(model.extractor, model.parameters, len(model.components)) + "".join(map(format_component, model.components))


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """The model as a file on any file system that Spark knows; one that is there is replaced."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(format_model(model).encode()))
    finally:
        out.close()


def read_model(spark: SparkSession, path: str) -> Model:
    return parse_model(spark.read.text(path, wholetext=True).first()["value"])


def with_thresholds(model: Model, thresholds: list[float]) -> Model:
    """The bias of each component is its threshold, negated."""
    return Model([Component(c.parts, -t) for c, t in zip(model.components, thresholds, strict=True)], model.extractor, dict(model.parameters))


def without_component(model: Model, i: int) -> Model:
    return Model([c for k, c in enumerate(model.components) if k != i], model.extractor, dict(model.parameters))


def joined(a: Model, b: Model) -> Model:
    """The components of both; extractors must be equal."""
    if (a.extractor, a.parameters) != (b.extractor, b.parameters):
        raise ValueError("the models have different extractors")
    return Model([*a.components, *b.components], a.extractor, dict(a.parameters))


def mirrored(component: Component, channel_map: list[int]) -> Component:
    """A component seen from the other side. Parts change sides within the root, on a grid of twice its resolution; the root keeps its offset and deformation."""
    root, *parts = component.parts

    def seen(weights: np.ndarray) -> np.ndarray:
        return weights[:, ::-1][:, :, channel_map]

    out = [Part(seen(root.weights), root.offset, root.deformation)]
    for part in parts:
        a, b, c, d = part.deformation
        x, y = part.offset
        out.append(Part(seen(part.weights), (2 * root.weights.shape[1] - part.weights.shape[1] - x, y), (a, -b, c, d)))
    return Component(out, component.bias)


def components_table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """A row per part: class, component, part, rows, cols, channels, offset, deformation, weights, bias."""
    rows = [(name, i, j, *p.weights.shape, list(p.offset), list(p.deformation), p.weights.ravel().tolist(), c.bias) for name, m in models.items() for i, c in enumerate(m.components) for j, p in enumerate(c.parts)]
    return spark.createDataFrame(rows, "class string, component int, part int, rows int, cols int, channels int, offset array<int>, deformation array<double>, weights array<float>, bias double")


@dataclass
class Background:
    cell: tuple[int, int]
    mean: np.ndarray  # channels
    cov: np.ndarray  # offsets, channels, channels
    offsets: np.ndarray  # offsets, (dx, dy)


def read_background(data: bytes) -> Background:
    f = io.BytesIO(data)

    def ints(n: int, kind: str = "<u4") -> list[int]:
        return np.frombuffer(f.read(4 * n), kind).tolist()

    (first,) = ints(1)
    if first & ~0xFF == MAGIC:
        if first & 0xFF > 1:
            raise ValueError("unknown version of background statistics")
        w, h = ints(2)
    else:
        w = h = first
    channels, n = ints(2)
    mean = np.frombuffer(f.read(4 * channels), "<f4")
    cov = np.frombuffer(f.read(4 * n * channels * channels), "<f4").reshape(n, channels, channels)
    return Background((w, h), mean, cov, np.array(ints(2 * n, "<i4")).reshape(n, 2))


def write_background(b: Background) -> bytes:
    head = struct.pack("<5I", MAGIC | 1, *b.cell, len(b.mean), len(b.offsets))
    return head + b.mean.astype("<f4").tobytes() + b.cov.astype("<f4").tobytes() + np.asarray(b.offsets).astype("<i4").tobytes()


def reconstruct(b: Background, rows: int, cols: int) -> np.ndarray:
    """Covariance of a rows x cols template, cells row by row: block Toeplitz in the offsets."""
    n = len(b.mean)
    of = {(int(dx), int(dy)): c for (dx, dy), c in zip(b.offsets, b.cov, strict=True)}
    of |= {(-dx, -dy): c.T for (dx, dy), c in list(of.items())}
    out = np.zeros((rows * cols * n, rows * cols * n))
    for i in range(rows * cols):
        for j in range(rows * cols):
            d = (j % cols - i % cols, j // cols - i // cols)
            if d not in of:
                raise ValueError("the template is larger than the offsets allow")
            out[i * n : (i + 1) * n, j * n : (j + 1) * n] = of[d]
    return (out + out.T) / 2


def read_pyramid(data: bytes) -> tuple[int, list[tuple[float, np.ndarray]]]:
    """Interval, and scale and rows x cols x channels of each level."""
    levels, interval, bits = struct.unpack_from("<IIB", data)
    at, kind, out = 9, {32: "<f4", 64: "<f8"}[bits], []
    for _ in range(levels):
        scale, rows, cols, channels = struct.unpack_from("<dIII", data, at)
        n = rows * cols * channels
        out.append((scale, np.frombuffer(data, kind, n, at + 20).reshape(rows, cols, channels)))
        at += 20 + n * bits // 8
    return interval, out


def write_pyramid(interval: int, levels: list[tuple[float, np.ndarray]]) -> bytes:
    out = [struct.pack("<IIB", len(levels), interval, 32)]
    for scale, cells in levels:
        out += [struct.pack("<dIII", scale, *cells.shape), np.ascontiguousarray(cells, "<f4").tobytes()]
    return b"".join(out)


def read_projection(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix of a principal-component file."""
    rows, cols = struct.unpack_from("<II", data)
    mean = np.frombuffer(data, "<f4", rows, 8)
    return mean, np.frombuffer(data, "<f4", rows * cols, 8 + 4 * rows).reshape(rows, cols)


def write_projection(mean: np.ndarray, matrix: np.ndarray) -> bytes:
    return struct.pack("<II", *matrix.shape) + mean.astype("<f4").tobytes() + np.ascontiguousarray(matrix, "<f4").tobytes()


def read_scales(text: str) -> np.ndarray:
    return np.array(text.split(), float)


COLUMNS = ["Threshold", "TP", "FP", "NP", "Precision", "Recall", "F-Measure"]


def write_results(results: DataFrame, path: str, model: str | None = None) -> None:
    """threshold, tp, fp, np as a table with semicolons; measures have six digits."""
    tp, fp, np_ = (F.col(c).cast("double") for c in ("tp", "fp", "np"))
    six = [F.format_string("%.6f", F.coalesce(c, F.lit(0.0))) for c in (F.when(tp + fp > 0, tp / (tp + fp)), F.when(np_ > 0, tp / np_), F.when(tp + fp + np_ > 0, 2 * tp / (tp + fp + np_)))]
    cols = ([F.col(model).alias("Model")] if model else []) + [F.col(c).alias(n) for c, n in zip(["threshold", "tp", "fp", "np"], COLUMNS, strict=False)] + [c.alias(n) for c, n in zip(six, COLUMNS[4:], strict=True)]
    results.select(*cols).write.option("sep", ";").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """threshold, tp, fp, np and, where there is one, model."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    return raw.select(*(["model"] if "model" in raw.columns else []), F.col("threshold").cast("double"), *(F.col(c).cast("long") for c in ("tp", "fp", "np")))
