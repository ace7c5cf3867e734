"""Queries over file formats, models and the way from feature levels to evaluation, on the same tables, with their SQL."""

from __future__ import annotations

import io
import itertools
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.functions.text import file_stem
from tessera.operators import engine, evaluate, keyed, sampling, stats
from tessera.plans.fixtures import BOXES, INTER, boxes, table
from tessera.sources import annotations, archives, models, repositories

#: Lines of a feature level, its columns, and the template of whole numbers that is looked for.
ROWS, COLS = 32, 31
TEMPLATE = ((1, -2, 3), (-1, 4, 1), (2, 0, -3))
#: Score above which a place is a candidate, side of the template cut into the covariance, largest offset.
SCORE, SIDE, OFFSETS = 100, 5, 4
#: Components of a piece of a model file.
PIECE = 4096
#: Keys of a run of an archive's entries, and bytes of a piece of it.
KEYS, PIECE_BYTES = 1 << 15, 4 << 20


def _archives(spark, d):
    """A tar archive per brand, in pieces: a file per part, by key, that holds the part's name. Pieces are of KEYS keys and about PIECE_BYTES at most; the last has the end mark."""
    parts = table(spark, d, "part").select("p_brand", F.floor(F.col("p_partkey") / KEYS).alias("run"), "p_partkey", "p_name")
    names = ["path", "run", "piece", "content"]

    def row(path, run: int, piece: int, content: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([path], pa.string()), pa.array([run], pa.int64()), pa.array([piece], pa.int64()), pa.array([content], pa.binary())], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (brand, run), own in itertools.groupby(rows, lambda r: r[:2]):
            piece, out = 0, bytearray()
            for _, _, key, name in own:
                data, info = name.encode(), tarfile.TarInfo(f"part_{key}.txt")
                info.size, info.mtime = len(data), int(key)
                out += info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % archives.BLOCK)
                if len(out) >= PIECE_BYTES:
                    yield row(brand, run, piece, bytes(out))
                    piece, out = piece + 1, bytearray()
            if out:
                yield row(brand, run, piece, bytes(out))

    packed = parts.repartition("p_brand", "run").sortWithinPartitions("p_brand", "run", "p_partkey", "p_name").mapInArrow(pack, "path string, run long, piece long, content binary")
    ends = parts.select(F.col("p_brand").cast("string").alias("path")).distinct().select("path", F.lit((1 << 63) - 1).alias("run"), F.lit(0).cast("long").alias("piece"), F.lit(bytes(2 * archives.BLOCK)).alias("content"))
    return packed.unionByName(ends)


def _index(spark, d):
    return archives.index(_archives(spark, d), piece=("run", "piece"))


def tar_index(spark, d):
    return _index(spark, d).select("path", F.col("index").cast("long").alias("place"), "name", "type", "size", "mtime", F.col("offset").alias("begin"))


def tar_extract(spark, d):
    return archives.extract(_archives(spark, d), piece=("run", "piece")).select("path", file_stem(F.col("name")).alias("stem"), F.decode("data", "UTF-8").alias("body"))


def tar_find(spark, d):
    return archives.find(_index(spark, d), "part_7.jpg", any_extension=True).select("path", "name", "size")


def _annotations(spark, d):
    """An annotation for each event: up to two objects, the second from the event's value."""
    e = boxes(spark, d)

    def box(name, x, y, w, h, difficult):
        def tag(t, c):
            return F.concat(F.lit(f"<{t}>"), c.cast("string"), F.lit(f"</{t}>"))

        return F.concat(F.lit("<object>"), tag("name", name), F.lit("<pose>left</pose><truncated>0</truncated>"), tag("difficult", difficult), F.lit("<bndbox>"), tag("xmin", x), tag("ymin", y), tag("xmax", x + w - 1), tag("ymax", y + h - 1), F.lit("</bndbox></object>"))

    first = box(F.concat("event_type", F.lit(" of a user")), F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("event_id") % 2)
    second = F.when(F.col("event_id") % 3 == 0, box(F.lit("second"), F.lit(1), F.lit(2), F.col("h"), F.col("w"), F.lit(0))).otherwise(F.lit(""))
    xml = F.concat(F.lit("<annotation><filename>f</filename><size><width>40</width><height>36</height><depth>3</depth></size>"), first, second, F.lit("</annotation>"))
    return e.select("event_id", xml.alias("xml"), (F.lit(40) * (1 + F.col("event_id") % 2)).cast("int").alias("iw"), F.lit(72).alias("ih"))


def annotation_objects(spark, d):
    return annotations.objects(_annotations(spark, d), "event_id", "xml").select("event_id", "name", "difficult", "x", "y", "w", "h")


def annotation_scaled(spark, d):
    """The same where images are larger than their annotations say, without what is difficult."""
    return annotations.objects(_annotations(spark, d), "event_id", "xml", "iw", "ih").where("NOT difficult").select("event_id", "name", "x", "y", "w", "h")


def export_first(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("stem"), "doc_id", F.col("lang").alias("content"))
    return repositories.export(docs, 25, ["doc_id"]).select("name", "content")


def cell_conversions(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", geometry.cells_to_pixels(size, 8, 3).cast("long").alias("pixels"), geometry.pixels_to_cells(key, 8, 3).cast("long").alias("cells"), geometry.pixels_to_cells(key, 8, 3, nearest=True).cast("long").alias("nearest"), geometry.cell_to_pixel(size, 8, 3).cast("long").alias("place"), F.round(geometry.aspect_ratio(size, key + 1), 9).alias("aspect"))


def crop_boxes(spark, d):
    cut = geometry.crop(F.col("x") - 5, F.col("y") - 5, F.col("w"), F.col("h"), F.lit(24), F.lit(20))
    return boxes(spark, d).select("event_id", cut.alias("c")).select("event_id", *(F.col(f"c.{c}").cast("long").alias(c) for c in "xywh"))


def _components(spark, d, where: str):
    """Components of a class: its parts by size and key, numbered from 0."""
    parts = table(spark, d, "part").where(where).groupBy(F.col("p_brand").alias("class")).agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    return parts.select("class", F.posexplode("keys").alias("component", "part"))


def components_appended(spark, d):
    return sampling.append_components(_components(spark, d, "p_size <= 25"), _components(spark, d, "p_size > 25"), "class", "component").select("class", F.col("component").cast("long").alias("component"), "part")


def component_removed(spark, d):
    return sampling.without_component(_components(spark, d, "true"), "component", 1, "class").select("class", F.col("component").cast("long").alias("component"), "part")


def models_deleted(spark, d):
    own = table(spark, d, "part").groupBy(F.col("p_brand").alias("class")).agg(F.max("p_size").alias("size"))
    return sampling.delete_by_key(own, table(spark, d, "part").where("p_size < 2").select(F.col("p_brand").alias("class")).distinct(), "class")


def _model_pieces(spark, d):
    """class, piece, text: the model file of each class, a component per part, its weight the part's key, in pieces of PIECE components; the first has the file's head."""
    found = _components(spark, d, "true")
    counts = found.groupBy(F.col("class").alias("own")).agg(F.count(F.lit(1)).alias("n"))
    each = found.join(counts, F.col("class").eqNullSafe(F.col("own"))).select("class", F.floor(F.col("component") / PIECE).alias("piece"), "component", "part", "n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True))
        for (name, piece), own in itertools.groupby(rows, lambda r: r[:2]):
            out = io.StringIO()
            for *_, part, n in own:
                if not piece and not out.tell():
                    out.write(models.format_head("HOG", {"cell": "8"}, n))
                out.write(models.format_component(models.Component([models.Part(np.full((1, 2, 1), part, np.float32), (0, 0))], -part / 4)))
            yield pa.record_batch([pa.array([name], pa.string()), pa.array([piece], pa.int64()), pa.array([out.getvalue()], pa.string())], ["class", "piece", "text"])

    return each.repartition("class", "piece").sortWithinPartitions("class", "piece", "component").mapInArrow(write, "class string, piece long, text string")


def model_files(spark, d):
    """Models by class written as files and read again: a component per part, its weight the part's key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, piece, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                read = [(name, piece * PIECE + i, float(c.parts[0].weights.sum()), float(c.bias)) for i, c in enumerate(models.parse_components(text, head=piece == 0))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*read, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["class", "component", "weight", "bias"])

    return _model_pieces(spark, d).mapInArrow(read, "class string, component long, weight double, bias double")


def positive_mean(spark, d):
    """The mean of the positives of each class."""
    means = table(spark, d, "embeddings").groupBy("label").agg(keyed.mean_of("embedding").alias("mean"))
    return means.select("label", F.posexplode("mean").alias("ch", "mean")).select("label", "ch", F.round("mean", 6).alias("mean"))


def _levels(spark, d):
    """Feature levels of one channel: ROWS users each, a column for each day, the value in whole numbers; missing days are 0.

    A day's values are added in order of their events: another order may end on the other
    side of a whole number. The SQL adds so on one thread, if rows are stored by event.
    """
    cell = ["image", "y", "x"]
    e = table(spark, d, "events").select(F.floor(F.col("user_id") / ROWS).alias("image"), (F.col("user_id") % ROWS).cast("int").alias("y"), F.dayofmonth("ts").alias("x"), "event_id", "value")
    whole = W.partitionBy(*cell).orderBy("event_id", "value").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = e.select(*cell, F.sum("value").over(whole).alias("v")).groupBy(*cell).agg(F.floor(F.max("v")).cast("double").alias("v"))
    # By lines first: looking up a place in a map takes as long as the map.
    lines = e.groupBy("image", "y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x") - 1, "v"))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(COLS - 1)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0)))
    packed = lines.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("y", line))).alias("m"))
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda y: F.coalesce(F.try_element_at("m", y), F.array_repeat(F.lit(0.0), COLS))))
    return packed.select("image", F.lit(10).alias("level"), F.lit(1.0).alias("scale"), F.lit(ROWS).alias("rows"), F.lit(COLS).alias("cols"), F.lit(1).alias("channels"), data.alias("data"))


def _template():
    return {"t": models.Model([models.Component([models.Part(np.array(TEMPLATE, np.float32)[:, :, None])], 0.0)])}


def _candidates(spark, d):
    return engine.candidates(_levels(spark, d), "image", _template(), {"t": float(SCORE)})


def detect_pyramids(spark, d):
    return _candidates(spark, d).select("image", "class", "score", "x", "y", "w", "h")


def evaluate_detected(spark, d):
    """From levels to evaluation: candidates matched with the purchases' boxes of their image, counted by threshold in steps of 10."""
    found = _candidates(spark, d).withColumn("event_id", F.col("y") * COLS + F.col("x") + F.col("image") * ROWS * COLS)
    objects = boxes(spark, d).where("event_type = 'purchase'").withColumn("image", F.floor(F.col("image") / ROWS))
    matched = evaluate.match(found, objects, "image", "event_id", 0.1)
    swept = evaluate.sweep(matched.withColumn("score", F.col("score") / 10), objects.count(), 1)
    return swept.select("threshold", "tp", "fp", "np", F.round(evaluate.f_measure(1.0), 6).alias("f1"))


def _background(spark, d):
    return engine.learn_background(_levels(spark, d), most=OFFSETS)


def background_learned(spark, d):
    b = _background(spark, d)
    return spark.createDataFrame([(int(dx), int(dy), round(float(c[0, 0]), 3)) for (dx, dy), c in zip(b.offsets, b.cov, strict=True)], "dx int, dy int, cov double")


def covariance_reconstructed(spark, d):
    """The covariance of a template of SIDE x SIDE cells, put together from the background that is learned of all levels; a channel that the background lacks has zeros."""
    return stats.reconstructed(engine.covariances(spark, _background(spark, d)), SIDE, SIDE, 2).select("p", "q", "i", "j", F.round("cov", 3).alias("cov"))


_QUERIES = (tar_index, tar_extract, tar_find, annotation_objects, annotation_scaled, export_first, cell_conversions, crop_boxes, components_appended, component_removed, models_deleted, model_files, positive_mean, detect_pyramids, evaluate_detected, background_learned, covariance_reconstructed)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def statements() -> tuple[str, str]:
    """The levels (cells), and the places where the template is found, as common table expressions."""
    taps = ", ".join(f"({y}, {x}, CAST({w} AS DOUBLE))" for y, row in enumerate(TEMPLATE) for x, w in enumerate(row))
    levels = f"sums AS (SELECT user_id // {ROWS} AS image, user_id % {ROWS} AS y, CAST(day(ts) AS BIGINT) - 1 AS x, floor(sum(value)) AS v FROM events GROUP BY ALL), cells AS (SELECT m.image, CAST(j AS BIGINT) AS y, CAST(i AS BIGINT) AS x, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT image FROM sums) m CROSS JOIN range({ROWS}) a(j) CROSS JOIN range({COLS}) b(i) LEFT JOIN sums s ON s.image = m.image AND s.y = j AND s.x = i)"
    found = f"taps(dy, dx, f) AS (VALUES {taps}), scored AS (SELECT c.image, c.y, c.x, sum(n.v * f) AS score FROM cells c, taps JOIN cells n ON n.image = c.image AND n.y = c.y + dy AND n.x = c.x + dx GROUP BY ALL), near AS (SELECT a.image, a.y, a.x, any_value(a.score) AS score, max(b.score) AS near FROM scored a JOIN scored b ON a.image = b.image AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (a.y <> b.y OR a.x <> b.x) WHERE a.score > {SCORE} GROUP BY ALL), found AS (SELECT image, score, x, y, 3 AS w, 3 AS h, image * {ROWS * COLS} + y * {COLS} + x AS id FROM near WHERE score > near)"
    return levels, found


def oracle_sql() -> dict[str, str]:
    numbered = "SELECT p_brand AS class, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS component, p_partkey AS part FROM part WHERE "
    parsed = "SELECT event_id, event_type AS name, event_id % 2 <> 0 AS difficult, x, y, w, h FROM boxes UNION ALL SELECT event_id, 'second', false, 1, 2, h, w FROM boxes WHERE event_id % 3 = 0"
    levels, found = statements()
    matched = f"objects AS (SELECT event_id, image // {ROWS} AS image, x, y, w, h FROM boxes WHERE event_type = 'purchase'), p AS (SELECT a.id AS d, a.score, b.event_id AS t, round(({INTER}) / (a.w * a.h + b.w * b.h - {INTER}), 9) AS iou FROM found a JOIN objects b ON a.image = b.image), best AS (SELECT * FROM p WHERE iou >= 0.1 QUALIFY row_number() OVER (PARTITION BY d ORDER BY iou DESC, t) = 1), hit AS (SELECT d FROM best QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, d) = 1), counts AS (SELECT floor(score / 10) AS threshold, count(*) FILTER (id IN (SELECT d FROM hit)) AS t, count(*) FILTER (id NOT IN (SELECT d FROM hit)) AS f FROM found GROUP BY ALL), results AS (SELECT threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp, (SELECT count(*) FROM objects) AS np FROM counts WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"
    half = f"half AS (SELECT dx, dy FROM range({OFFSETS + 1}) a(dx), range(-{OFFSETS}, {OFFSETS + 1}) b(dy) WHERE dx > 0 OR dy >= 0)"
    entries = "entries AS (SELECT p_brand AS path, p_partkey AS k, p_name AS body, 'part_' || p_partkey || '.txt' AS name, strlen(p_name) AS size FROM part)"
    placed = "placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS place, CAST(sum(512 + (size + 511) // 512 * 512) OVER (PARTITION BY path ORDER BY k) - (size + 511) // 512 * 512 AS BIGINT) AS begin FROM entries)"
    scale = "CAST(floor({c} * {s}) AS INTEGER)"
    wide, high = "(1 + event_id % 2)", "2"
    scaled = ", ".join(f"{scale.format(c=c, s=s)} AS {c}" for c, s in (("x", wide), ("y", high), ("w", wide), ("h", high)))
    return {
        "tar_index": f"WITH {entries}, {placed} SELECT path, place, name, 'file' AS type, size, k AS mtime, begin FROM placed",
        "tar_extract": f"WITH {entries} SELECT path, 'part_' || k AS stem, body FROM entries",
        "tar_find": f"WITH {entries} SELECT path, name, size FROM entries WHERE k = 7",
        "annotation_objects": f"WITH {BOXES}, o AS ({parsed}) SELECT event_id, name, difficult, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h FROM o WHERE x > 0 AND y > 0 AND x + w <= 40 AND y + h <= 36",
        "annotation_scaled": f"WITH {BOXES}, o AS ({parsed}), s AS (SELECT event_id, name, difficult, {scaled} FROM o) SELECT event_id, name, x, y, w, h FROM s WHERE NOT difficult AND x > 0 AND y > 0 AND x + w <= 40 * {wide} AND y + h <= 72",
        "export_first": "SELECT source || '_' || doc_id || '.jpg' AS name, lang AS content FROM documents ORDER BY doc_id LIMIT 25",
        "cell_conversions": "SELECT p_partkey, p_size * 8 + 6 AS pixels, CAST(floor((p_partkey - 6) / 8) AS BIGINT) AS cells, CAST(floor((p_partkey - 6) / 8 + 0.5) AS BIGINT) AS nearest, p_size * 8 + 3 AS place, round((p_partkey + 1) / p_size, 9) AS aspect FROM part",
        "crop_boxes": f"WITH {BOXES}, c AS (SELECT event_id, x - 5 AS l, y - 5 AS t, w, h FROM boxes) SELECT event_id, greatest(0, l)::BIGINT AS x, greatest(0, t)::BIGINT AS y, greatest(0, least(24, l + w) - greatest(0, l))::BIGINT AS w, greatest(0, least(20, t + h) - greatest(0, t))::BIGINT AS h FROM c",
        "components_appended": f"WITH a AS ({numbered}p_size <= 25), b AS ({numbered}p_size > 25), top AS (SELECT class, max(component) + 1 AS n FROM a GROUP BY ALL) SELECT * FROM a UNION ALL SELECT b.class, component + coalesce(n, 0), part FROM b LEFT JOIN top ON top.class = b.class",
        "component_removed": f"WITH a AS ({numbered}true) SELECT class, CASE WHEN component > 1 THEN component - 1 ELSE component END AS component, part FROM a WHERE component <> 1",
        "models_deleted": "SELECT p_brand AS class, max(p_size) AS size FROM part GROUP BY ALL HAVING min(p_size) >= 2",
        "model_files": f"SELECT class, component, part * 2.0::DOUBLE AS weight, -part / 4 AS bias FROM ({numbered}true)",
        "positive_mean": "SELECT label, CAST(i AS INTEGER) AS ch, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean FROM embeddings, range(64) r(i) GROUP BY ALL",
        "detect_pyramids": f"WITH {levels}, {found} SELECT image, 't' AS class, score, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h FROM found",
        "evaluate_detected": f"WITH {BOXES}, {levels}, {found}, {matched} SELECT threshold, tp, fp, np, round(2 * tp / (tp + fp + np), 6) AS f1 FROM results",
        "background_learned": f"WITH {levels}, {half}, c AS (SELECT image, y, x, v - (SELECT avg(v) FROM cells) AS v FROM cells) SELECT dx::INTEGER AS dx, dy::INTEGER AS dy, round(avg(a.v * b.v), 3) AS cov FROM c a, half JOIN c b ON a.image = b.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL",
        "covariance_reconstructed": f"WITH {levels}, {half}, c AS (SELECT image, y, x, v - (SELECT avg(v) FROM cells) AS v FROM cells), b AS (SELECT dx, dy, avg(a.v * b.v) AS cov FROM c a, half JOIN c b ON a.image = b.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL), pairs AS (SELECT p, q, i, j, q % {SIDE} - p % {SIDE} AS dx, q // {SIDE} - p // {SIDE} AS dy FROM range({SIDE * SIDE}) r(p), range({SIDE * SIDE}) s(q), range(2) t(i), range(2) u(j)) SELECT p, q, i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = 0 AND j = 0 THEN round(cov, 3) ELSE 0 END AS cov FROM pairs JOIN b ON b.dx = (CASE WHEN pairs.dx > 0 OR (pairs.dx = 0 AND pairs.dy >= 0) THEN 1 ELSE -1 END) * pairs.dx AND b.dy = (CASE WHEN pairs.dx > 0 OR (pairs.dx = 0 AND pairs.dy >= 0) THEN 1 ELSE -1 END) * pairs.dy",
    }
