"""Queries from pixels on: crops, histograms of gradients, detection with boxes in pixels, covariance of templates; with their SQL.

Images are the feature levels of `chain` as 8-bit samples: a line for each user, a column for each day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import detect, engine, hog, learner
from tessera.plans import catalogue, chain
from tessera.plans.fixtures import BOXES, boxes

ROWS, COLS = chain.ROWS, chain.COLS
#: Pixels of a cell of the template that is looked for, and of an image that is a little smaller than its cells.
CELL, WIDTH, HEIGHT = 8, 8 * COLS - 5, 8 * ROWS - 3


def _images(spark, d):
    samples = F.transform("data", lambda v: F.lpad(F.hex((v % 256).cast("long")), 2, "0"))
    return chain._levels(spark, d).select("image", F.lit(ROWS).alias("height"), F.lit(COLS).alias("width"), F.lit(1).alias("depth"), F.unhex(F.array_join(samples, "")).alias("data"))


def image_crops(spark, d):
    """The part of each event's box that lies in its image, as hexadecimal samples."""
    own = boxes(spark, d).select(F.floor(F.col("image") / ROWS).alias("image"), F.col("event_id").alias("box_id"), (F.col("x") - 5).alias("x"), (F.col("image") % ROWS - 4).alias("y"), "w", "h")
    return learner.crops(_images(spark, d), own, "image").select("image", "box_id", "height", "width", F.hex("data").alias("data"))


def hog_cells(spark, d):
    """Histograms of oriented gradients of all images."""
    found = learner.features_of(_images(spark, d), "image", hog.EXTRACTORS["HOG"])
    return found.select("image", F.posexplode("data").alias("i", "v")).select("image", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


def gradient_energy(spark, d):
    """The channels of texture of all cells by image: what is left of a gradient's energy after normalization."""
    found = hog_cells(spark, d).where("i % 32 >= 27 AND i % 32 < 31")
    return found.groupBy("image").agg(F.round(F.sum("v"), 5).alias("texture"), F.count(F.lit(1)).alias("n"))


def boxes_detected(spark, d):
    """From levels to boxes in pixels: local maxima of the template, projected, cut to the image, and suppressed."""
    levels = chain._levels(spark, d)
    images = levels.select("image", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
    found = engine.detect(levels, images, "image", chain._template(), {"t": float(chain.SCORE)}, overlap=0.2, cell=CELL)
    return found.select("image", "class", "component", "score", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")))


def nms_spread(spark, d):
    """Suppression by rounds of joins, for images of any number of boxes."""
    return detect.suppress_spread(boxes(spark, d), ["image", "event_type"], "event_id").select("image", "event_type", "event_id", "score")


_QUERIES = (nms_spread, image_crops, hog_cells, gradient_energy, boxes_detected)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    levels, found = chain.statements()
    pixels = f"{levels}, px AS (SELECT image, y, x, CAST(v AS BIGINT) % 256 AS v FROM cells)"
    rows, cols = (ROWS + 4) // 8, (COLS + 4) // 8
    edge = f"SELECT p.image, p.y, p.x, r.v - l.v AS dx, d.v - u.v AS dy FROM px p JOIN px l ON l.image = p.image AND l.y = p.y AND l.x = greatest(0, p.x - 1) JOIN px r ON r.image = p.image AND r.y = p.y AND r.x = least({COLS - 1}, p.x + 1) JOIN px u ON u.image = p.image AND u.x = p.x AND u.y = greatest(0, p.y - 1) JOIN px d ON d.image = p.image AND d.x = p.x AND d.y = least({ROWS - 1}, p.y + 1)"
    hogs = f"grad AS ({edge}), turned AS (SELECT *, sqrt(dx * dx + dy * dy) AS size, atan2(dy::DOUBLE, dx::DOUBLE) / (2 * pi()) * 18 AS a, (y + 0.5) / 8.0::DOUBLE - 0.5 AS ay, (x + 0.5) / 8.0::DOUBLE - 0.5 AS ax FROM grad), placed AS (SELECT *, a - 18 * floor(a / 18) AS angle, ay - floor(ay) AS fy, ax - floor(ax) AS fx FROM turned), parts AS (SELECT image, least(floor(ay) + 1 + i, {rows + 1})::BIGINT AS cy, least(floor(ax) + 1 + j, {cols + 1})::BIGINT AS cx, (floor(angle) + k)::BIGINT % 18 AS o, size * CASE i WHEN 0 THEN 1 - fy ELSE fy END * CASE j WHEN 0 THEN 1 - fx ELSE fx END * CASE k WHEN 0 THEN 1 - (angle - floor(angle)) ELSE angle - floor(angle) END AS v FROM placed, range(2) q(i), range(2) w(j), range(2) e(k)), hist AS (SELECT m.image, cy, cx, o, coalesce(v, 0) AS v FROM (SELECT DISTINCT image FROM px) m CROSS JOIN range({rows + 2}) a(cy) CROSS JOIN range({cols + 2}) b(cx) CROSS JOIN range(18) c(o) LEFT JOIN (SELECT image, cy, cx, o, sum(v) AS v FROM parts GROUP BY ALL) s USING (image, cy, cx, o)), plain AS (SELECT image, cy, cx, o % 9 AS o, sum(v) AS v FROM hist GROUP BY ALL), energy AS (SELECT image, cy, cx, sum(v * v) AS e FROM plain GROUP BY ALL), block AS (SELECT a.image, a.cy, a.cx, sum(b.e) AS e FROM energy a JOIN energy b ON a.image = b.image AND b.cy - a.cy IN (0, 1) AND b.cx - a.cx IN (0, 1) WHERE a.cy <= {rows} AND a.cx <= {cols} GROUP BY ALL), norms AS (SELECT image, cy + 1 - i AS cy, cx + 1 - j AS cx, 2 * i + j AS k, 1 / sqrt(e + 1.1920928955078125e-07) AS norm FROM (SELECT image, cy, cx, e, i, j FROM block, range(2) q(i), range(2) w(j))), inner_norms AS (SELECT * FROM norms WHERE cy BETWEEN 1 AND {rows} AND cx BETWEEN 1 AND {cols}), signed AS (SELECT image, cy, cx, k, o, least(v * norm, 0.2) AS s FROM hist JOIN inner_norms USING (image, cy, cx)), features AS (SELECT image, cy, cx, o AS ch, 0.5 * sum(s) AS v FROM signed GROUP BY image, cy, cx, o UNION ALL SELECT image, cy, cx, 18 + o, 0.5 * sum(least(v * norm, 0.2)) FROM plain JOIN inner_norms USING (image, cy, cx) GROUP BY image, cy, cx, o UNION ALL SELECT image, cy, cx, 27 + k, 0.2357 * sum(s) FROM signed GROUP BY image, cy, cx, k UNION ALL SELECT image, cy, cx, 31, 0 FROM energy WHERE cy BETWEEN 1 AND {rows} AND cx BETWEEN 1 AND {cols}), hogs AS (SELECT image, CAST(((cy - 1) * {cols} + cx - 1) * 32 + ch AS INTEGER) AS i, round(CAST(v AS FLOAT)::DOUBLE, 5) AS v FROM features)"
    crops = f"c AS (SELECT image // {ROWS} AS image, event_id AS box_id, x - 5 AS l, image % {ROWS} - 4 AS t, w, h FROM boxes), cut AS (SELECT image, box_id, greatest(0, l) AS x, greatest(0, t) AS y, least({COLS}, l + w) - greatest(0, l) AS w, least({ROWS}, t + h) - greatest(0, t) AS h FROM c)"
    placed = f"placed AS (SELECT image, score, x * {CELL} AS x, y * {CELL} AS y, least({WIDTH}, x * {CELL} + {3 * CELL}) - x * {CELL} AS w, least({HEIGHT}, y * {CELL} + {3 * CELL}) - y * {CELL} AS h FROM found), b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, y, x) AS rn FROM placed WHERE w > 0 AND h > 0)"
    kept = "s AS (SELECT image, CAST(1 AS BIGINT) AS rn, [{'x': x, 'y': y, 'w': w, 'h': h, 's': score}] AS kept FROM b WHERE rn = 1 UNION ALL SELECT s.image, b.rn, CASE WHEN len(list_filter(s.kept, lambda a: greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.2 * b.w * b.h)) > 0 THEN s.kept ELSE list_append(s.kept, {'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 's': b.score}) END FROM s JOIN b ON b.image = s.image AND b.rn = s.rn + 1)"
    return {
        "nms_spread": catalogue.oracle_sql()["nms"],
        "image_crops": f"WITH {BOXES}, {pixels}, {crops} SELECT cut.image, box_id, h::INTEGER AS height, w::INTEGER AS width, string_agg(printf('%02X', px.v), '' ORDER BY px.y, px.x) AS data FROM cut JOIN px ON px.image = cut.image AND px.x BETWEEN cut.x AND cut.x + cut.w - 1 AND px.y BETWEEN cut.y AND cut.y + cut.h - 1 WHERE w > 0 AND h > 0 GROUP BY ALL",
        "hog_cells": f"WITH {pixels}, {hogs} SELECT image, i, v FROM hogs",
        "gradient_energy": f"WITH {pixels}, {hogs} SELECT image, round(sum(v), 5) AS texture, count(*) AS n FROM hogs WHERE i % 32 >= 27 AND i % 32 < 31 GROUP BY image",
        "boxes_detected": f"WITH RECURSIVE {levels}, {found}, {placed}, {kept}, l AS (SELECT image, unnest(kept) AS k FROM s QUALIFY rn = max(rn) OVER (PARTITION BY image)) SELECT image, 't' AS class, 0 AS component, k.s AS score, k.x AS x, k.y AS y, k.w AS w, k.h AS h FROM l",
    }
