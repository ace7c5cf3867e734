"""Repositories of labelled images: archives or directories, one synset each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import file_stem
from tessera.operators import sampling
from tessera.operators.numbering import numbered
from tessera.sources import archives


def synsets(spark: SparkSession, path: str) -> DataFrame:
    """synset_id and description of a list with one `id description` per line; a line without a space has an empty description."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", " ", 2)
    return lines.select(F.element_at(parts, 1).alias("synset_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("description"))


def directory_images(spark: SparkSession, root: str) -> DataFrame:
    """synset_id, stem, path and content of the JPEG files below each directory of root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(root)
    inner = F.regexp_extract("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + r"/([^/]+)/", 1)
    return files.select(inner.alias("synset_id"), file_stem(F.col("path")).alias("stem"), "path", "content")


def archive_images(spark: SparkSession, root: str) -> DataFrame:
    """The same for a repository with Images/<id>.tar."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(f"{root}/Images")
    out = archives.extract(files).where("type = 'file'")
    return out.select(file_stem(F.col("path")).alias("synset_id"), file_stem(F.col("name")).alias("stem"), F.col("name").alias("path"), F.col("data").alias("content"))


def archive_annotations(spark: SparkSession, root: str) -> DataFrame:
    """synset_id, stem and xml of Annotation/<id>.tar."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(f"{root}/Annotation")
    out = archives.extract(files).where("type = 'file'")
    return out.select(file_stem(F.col("path")).alias("synset_id"), file_stem(F.col("name")).alias("stem"), F.decode("data", "UTF-8").alias("xml"))


def problems(spark: SparkSession, root: str) -> list[str]:
    """What a repository of archives lacks; empty if it is complete."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(conf)
    if not store.exists(path(root)):
        return ["no such directory"]
    missing = [x for x in ("synset_wordlist.txt", "Images", "Annotation") if not store.exists(path(f"{root}/{x}"))]
    if "Images" not in missing and not any(s.getPath().getName().endswith(".tar") for s in store.listStatus(path(f"{root}/Images"))):
        missing.append("Images/*.tar")
    return missing


def export(images: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """name and content of the first images, to be written by the caller's sink."""
    return images.orderBy(*order).limit(limit).select(F.concat("stem", F.lit(".jpg")).alias("name"), "content")


def export_mixed(images: DataFrame, folder: str, group: str, order: str, per_round: int, limit: int | None = None) -> DataFrame:
    """Writes images of all groups, `per_round` of each in turn, as files below a folder, and tells position, name and bytes of each.

    images has the group, the order, stem and content, and either compressed bytes as content,
    or samples with height, width and depth, which become PGM or PPM files. The folder is
    in a store that pyarrow.fs opens by its URI. Tasks write files of their own; one that is
    run again writes the same files again. A name is the position and the stem, so names never clash.
    """
    raw = {"height", "width", "depth"} <= set(images.columns)
    if limit is None:
        placed = sampling.round_robin(images.drop("content"), group, order, per_round)
    else:
        ranked = sampling.round_robin(images.drop("content"), group, order, per_round, limit)
        placed = numbered(ranked, ["round", group, "rank"], "position")
    lean = placed.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "position")
    joined = images.join(lean, F.col(group).eqNullSafe(F.col("_group")) & (F.col(order) == F.col("_order")))
    wanted = joined.select("position", "stem", "content", *(F.col(c) if raw else F.lit(None).cast("int").alias(c) for c in ("height", "width", "depth"))).where("content IS NOT NULL")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(at, recursive=True)
        for batch in batches:
            rows = []
            for place, stem, content, h, w, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = b"P%d\n%d %d\n255\n" % (5 if d == 1 else 6, w, h) if raw else b""
                name = f"{place:08d}_{(stem or '').replace('/', '_')}.{('pgm' if d == 1 else 'ppm') if raw else 'jpg'}"
                with store.open_output_stream(f"{at}/{name}") as out:
                    out.write(head + content)
                rows.append((place, name, len(head) + len(content)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["position", "name", "bytes"])

    return wanted.mapInArrow(write, "position long, name string, bytes long")
