"""Queries of learning: all classes at once, leave-one-out, background statistics, whitening; with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tessera.operators import engine, evaluate, held_out, hog, keyed, sampling, stats, toeplitz
from tessera.plans.fixtures import BOXES, INTER, boxes, table
from tessera.streaming import cameras

CLUSTERS, ROUNDS, RIDGE = 3, 3, 0.01
#: Rows, columns and channels of the levels that vectors of 64 numbers are taken for, by vec_id modulo 3.
SHAPES = ((4, 8, 2), (8, 4, 2), (2, 16, 2))
REACH = 3
#: Layer, rows, columns, channels, cells of the first layer along a side, and where its numbers begin in a vector.
LAYERS = ((0, 4, 10, 1, 1, 0), (1, 2, 4, 2, 2, 40), (2, 1, 2, 4, 4, 56))
#: Microseconds that a frame keeps a detector busy.
BUSY = 6 * 3600 * 10**6


def _samples(spark, d):
    return table(spark, d, "embeddings").where("label IS NOT NULL")


def _diagonal(samples):
    """Mean of all cells, and their variances with a ridge: the size of a vector."""
    told = samples.agg(Summarizer.metrics("mean", "count").summary(array_to_vector(F.transform("embedding", lambda x: x.cast("double")))).alias("s"), Summarizer.mean(array_to_vector(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")))).alias("q")).first()
    mean = told["s"]["mean"].toArray()
    scale = told["q"].toArray() - mean * mean + RIDGE
    return mean, lambda x: x / scale


def classes_clustered(spark, d):
    """Clusters of all labels, after a fixed number of rounds."""
    samples = _samples(spark, d)
    centers = keyed.kmeans(samples, "label", "vec_id", "embedding", CLUSTERS, ROUNDS, None)
    return keyed.nearest(samples.select("vec_id", "label", "embedding"), centers, "label", "embedding").select("vec_id", "label", "cluster", "distance")


def classes_learned(spark, d):
    """Templates of all labels at once."""
    samples = _samples(spark, d)
    mean, solve = _diagonal(samples)
    found = keyed.learn_classes(samples, "label", "vec_id", "embedding", mean, solve, CLUSTERS, ROUNDS, None)
    return found.select("label", "cluster", "n", F.posexplode("weights").alias("ch", "weight"), "threshold", "f").select("label", "cluster", "n", "ch", *(F.round(c, 5).alias(c) for c in ("weight", "threshold", "f")))


def left_out_thresholds(spark, d):
    """Thresholds of all labels' templates, each sample scored by its label's without itself."""
    samples = _samples(spark, d)
    mean, solve = _diagonal(samples)
    models = keyed.learn_classes(samples, "label", "vec_id", "embedding", mean, solve, 1, 0, None)
    return held_out.best_thresholds(samples, models, "vec_id", "label", "embedding", solve, mean, granularity=20).select("label", "threshold", F.round("f_measure", 6).alias("f_measure"))


def _levels(spark, d):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("data"))
    shape = [F.when(F.col("vec_id") % 3 == 0, SHAPES[0][i]).when(F.col("vec_id") % 3 == 1, SHAPES[1][i]).otherwise(SHAPES[2][i]).alias(n) for i, n in enumerate(("rows", "cols", "channels"))]
    return e.select("vec_id", *shape, "data")


def background_cyclic(spark, d):
    """Autocorrelation of two channels over levels of three sizes that wrap around, by Fourier transforms."""
    b = engine.learn_background_cyclic(_levels(spark, d), most=REACH)
    rows = [(int(dx), int(dy), i, j, float(c[i, j])) for (dx, dy), c in zip(b.offsets, b.cov, strict=True) for i in range(len(b.mean)) for j in range(len(b.mean))]
    return spark.createDataFrame(rows, "dx int, dy int, i int, j int, cov double").withColumn("cov", F.round("cov", 3))


def images_whitened(spark, d):
    """Whitened levels times their covariance, and the mean added: the levels again, so the solver is held against them."""
    levels = _levels(spark, d).where("vec_id % 3 = 0")
    b = engine.learn_background(_levels(spark, d), most=7)
    white = engine.whitened(levels, "vec_id", b, least=1.0, unit=False)
    rows, cols, _ = SHAPES[0]

    def back(x: np.ndarray) -> np.ndarray:
        return toeplitz.Toeplitz(b, rows, cols, 1.0).product(x) + np.tile(b.mean, rows * cols)

    again = keyed.mapped(white.select("vec_id", "white"), "white", "again", back)
    return again.select("vec_id", F.posexplode("again").alias("i", "v")).select("vec_id", "i", F.round("v", 4).cast("long").alias("v"))


def classes_evaluated(spark, d):
    """Detections of all classes against the objects of their class and image: a sweep for each."""
    b = boxes(spark, d)
    swept = evaluate.evaluate_classes(b.where("event_id % 2 = 1"), b.where("event_id % 2 = 0"), "image", "event_type", "event_id", 0.3, 1)
    return swept.select("event_type", "threshold", "tp", "fp", "np", F.round(evaluate.f_measure(1.0), 6).alias("f1"))


def shapes_of_kinds(spark, d):
    """Template sizes of all kinds of boxes at once, from their commonest aspect ratio and the 20th percentile of their areas."""
    b = boxes(spark, d).where("w > 0 AND h > 0")
    aspects = stats.aspect_modes(b, "w", "h", ["event_type"])
    areas = stats.area_quantile(b, F.col("w") * F.col("h"), ["event_type"])
    return aspects.join(areas, "event_type").select("event_type", F.round("aspect", 6).alias("aspect"), "area")


def frames_taken(spark, d):
    """The frames that each user's detector takes, which is busy for six hours with each."""
    found = cameras.taken(table(spark, d, "events"), "user_id", "ts", "event_id", BUSY, 3)
    return found.select("camera", "frame", "arrived", "started", "dropped", F.round("rate", 9).alias("rate"))


def round_robin_whole(spark, d):
    """All parts, two of each kind in turn, until every kind is exhausted."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"))
    return sampling.round_robin(parts, "kind", "p_partkey", 2).select("p_partkey", "kind", "round", "rank", "position")


def layers_joined(spark, d):
    """Three layers of each vector, of whole, half and quarter resolution, put together; the second and third leave an edge."""
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    layers = None
    for layer, rows, cols, channels, cell, begin in LAYERS:
        one = e.select("vec_id", F.lit(layer).alias("layer"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.lit(channels).alias("channels"), F.lit(cell).alias("cell_w"), F.lit(cell).alias("cell_h"), F.slice("embedding", begin + 1, rows * cols * channels).alias("data"))
        layers = one if layers is None else layers.union(one)
    joined = hog.joined_layers(layers, "vec_id")
    return joined.select("vec_id", "channels", F.posexplode("data").alias("i", "v")).select("vec_id", "channels", "i", F.round(F.col("v").cast("double"), 6).alias("v"))


_QUERIES = (round_robin_whole, layers_joined, frames_taken, classes_evaluated, shapes_of_kinds, classes_clustered, classes_learned, left_out_thresholds, background_cyclic, images_whitened)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def _kmeans(cells: str, k: int, rounds: int) -> str:
    """Statements that end in a{rounds} (vec_id, label, cluster, distance) and c{rounds} (label, cluster, ch, v), of cells (vec_id, label, ch, v)."""

    def nearest(name: str, centers: str) -> str:
        return f"d_{name} AS (SELECT s.vec_id, s.label, c.cluster, round(sum((s.v - c.v) * (s.v - c.v)), 6) AS distance FROM {cells} s JOIN {centers} c USING (label, ch) GROUP BY ALL), a_{name} AS (SELECT * FROM d_{name} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"

    parts = [f"s0 AS (SELECT label, 0 AS cluster, ch, v FROM {cells} WHERE vec_id IN (SELECT min(vec_id) FROM {cells} GROUP BY label))"]
    for i in range(1, k):
        parts.append(nearest(f"s{i}", f"s{i - 1}"))
        parts.append(f"f{i} AS (SELECT vec_id FROM a_s{i} WHERE distance > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) = 1)")
        parts.append(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT label, {i}, ch, v FROM {cells} WHERE vec_id IN (SELECT vec_id FROM f{i}))")
    before = f"s{k - 1}"
    for r in range(rounds):
        parts.append(nearest(f"r{r}", before))
        parts.append(f"m{r} AS (SELECT label, cluster, ch, avg(v) AS v FROM {cells} JOIN a_r{r} USING (vec_id, label) GROUP BY ALL)")
        parts.append(f"c{r} AS (SELECT b.label, b.cluster, b.ch, coalesce(m{r}.v, b.v) AS v FROM {before} b LEFT JOIN m{r} USING (label, cluster, ch))")
        before = f"c{r}"
    parts.append(nearest("last", before))
    return ", ".join(parts)


def oracle_sql() -> dict[str, str]:
    cells = "raw AS (SELECT vec_id, label, CAST(i AS INTEGER) AS ch, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i) WHERE label IS NOT NULL)"
    white = f"stats AS (SELECT ch, avg(v) AS m, avg(v * v) - avg(v) * avg(v) + {RIDGE} AS scale FROM raw GROUP BY ch), white AS (SELECT vec_id, label, ch, (v - m) / scale AS v FROM raw JOIN stats USING (ch))"
    shape = " ".join(f"WHEN {i} THEN {{'r': {r}, 'c': {c}, 'n': {n}}}" for i, (r, c, n) in enumerate(SHAPES))
    levels = f"level AS (SELECT vec_id, CAST(i AS BIGINT) AS i, floor(CAST(embedding[i + 1] AS DOUBLE) * 1000) AS v, CASE vec_id % 3 {shape} END AS s FROM embeddings, range(64) t(i) WHERE embedding IS NOT NULL)"
    half = f"half AS (SELECT dx, dy FROM range({REACH + 1}) a(dx), range(-{REACH}, {REACH + 1}) b(dy) WHERE dx > 0 OR dy >= 0)"
    biases = "templates AS (SELECT label, cluster, n, ch, p.v AS pos, m, scale, (p.v - m) / scale AS w FROM positive p JOIN stats USING (ch)), totals AS (SELECT label, cluster, max(abs(w)) AS f, sum(m * m / scale - pos * pos / scale) / 2 AS bias FROM templates GROUP BY ALL)"
    one = "positive AS (SELECT label, 0 AS cluster, count(*) AS n, ch, avg(v) AS v FROM raw GROUP BY label, ch)"
    return {
        "classes_clustered": f"WITH {cells}, {_kmeans('raw', CLUSTERS, ROUNDS)} SELECT vec_id, label, cluster, distance FROM a_last",
        "classes_learned": f"WITH {cells}, {white}, {_kmeans('white', CLUSTERS, ROUNDS)}, sizes AS (SELECT label, cluster, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS total FROM a_last GROUP BY label, cluster), kept AS (SELECT label, cluster, n, row_number() OVER (PARTITION BY label ORDER BY cluster) - 1 AS number FROM sizes WHERE n >= floor(total / 10)), positive AS (SELECT label, number AS cluster, any_value(n) AS n, ch, avg(v) AS v FROM raw JOIN a_last USING (vec_id, label) JOIN kept USING (label, cluster) GROUP BY label, number, ch), {biases} SELECT label, CAST(cluster AS INTEGER) AS cluster, n, ch, round(w / f, 5) AS weight, round(-bias / f, 5) AS threshold, round(f, 5) AS f FROM templates JOIN totals USING (label, cluster)",
        "left_out_thresholds": f"WITH {cells}, {white}, {one}, {biases}, scores AS (SELECT r.vec_id, r.label AS own, t.label, any_value(t.n) AS n, any_value(f) AS f, sum(r.v * t.w / f) AS score, sum(r.v * white.v) AS self FROM raw r JOIN white USING (vec_id, ch) JOIN templates t USING (ch) JOIN totals o ON o.label = t.label GROUP BY ALL), left_out AS (SELECT label, own = label AS hit, CASE WHEN own = label AND n > 1 THEN (score * n * f - self) / ((n - 1) * f) ELSE score END AS score FROM scores), counts AS (SELECT label, floor(score * 20) / 20 AS threshold, count(*) FILTER (hit) AS t, count(*) FILTER (NOT hit) AS f FROM left_out WHERE score >= 0 GROUP BY ALL), swept AS (SELECT label, threshold, sum(t) OVER w AS tp, sum(f) OVER w AS fp, (SELECT count(*) FROM embeddings e WHERE e.label = counts.label) AS np FROM counts WINDOW w AS (PARTITION BY label ORDER BY threshold DESC)) SELECT label, threshold, round(2 * tp / (tp + fp + np), 6) AS f_measure FROM swept QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(2 * tp / (tp + fp + np), 9) DESC, threshold) = 1",
        "background_cyclic": f"WITH {levels}, {half}, cells AS (SELECT vec_id, s.r AS r, s.c AS c, i % s.n AS ch, i // s.n // s.c AS y, i // s.n % s.c AS x, v - avg(v) OVER (PARTITION BY i % s.n) AS v FROM level), pairs AS (SELECT dx, dy, a.ch AS i, b.ch AS j, a.v * b.v AS p FROM cells a, half JOIN cells b ON a.vec_id = b.vec_id AND b.y = (a.y + dy + 2 * a.r) % a.r AND b.x = (a.x + dx) % a.c WHERE a.r // 2 + dy >= 0 AND a.r // 2 + dy < a.r AND a.c // 2 + dx < a.c), found AS (SELECT dx, dy, i, j, avg(p) AS cov FROM pairs GROUP BY ALL) SELECT dx::INTEGER AS dx, dy::INTEGER AS dy, i::INTEGER AS i, j::INTEGER AS j, round(coalesce(cov, 0), 3) AS cov FROM half CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) LEFT JOIN found USING (dx, dy, i, j)",
        "frames_taken": f"WITH RECURSIVE f AS (SELECT user_id AS camera, epoch_us(ts) AS t, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), walk AS (SELECT camera, k, t AS started, 0::BIGINT AS dropped FROM f WHERE k = 1 UNION ALL SELECT w.camera, CASE WHEN min(n.t) >= w.started + {BUSY} THEN w.k + 1 ELSE max(n.k) FILTER (n.t <= w.started + {BUSY}) END, greatest(min(n.t), w.started + {BUSY}), w.dropped + CASE WHEN min(n.t) >= w.started + {BUSY} THEN 0 ELSE max(n.k) FILTER (n.t <= w.started + {BUSY}) - w.k - 1 END FROM walk w JOIN f n ON n.camera = w.camera AND n.k > w.k GROUP BY w.camera, w.k, w.started, w.dropped), timed AS (SELECT *, lag(started, 2) OVER (PARTITION BY camera ORDER BY k) AS first FROM walk) SELECT camera, id AS frame, t AS arrived, started, dropped, round(CASE WHEN started > first THEN 2e6 / (started - first) END, 9) AS rate FROM timed JOIN f USING (camera, k)",
        "round_robin_whole": "WITH r AS (SELECT p_partkey, p_type AS kind, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rank FROM part) SELECT p_partkey, kind, (rank - 1) // 2 AS round, rank, row_number() OVER (ORDER BY (rank - 1) // 2, kind, rank) - 1 AS position FROM r",
        "layers_joined": f"WITH g AS (SELECT y, x, l.* FROM range({LAYERS[0][1]}) a(y), range({LAYERS[0][2]}) b(x), (VALUES {', '.join(map(str, LAYERS))}) l(layer, h, w, n, cell, start)), s AS (SELECT *, greatest(0, least(h - 1, CAST(floor((y - greatest(0, {LAYERS[0][1]} - h * cell) // 2) / cell) AS BIGINT))) AS sy, greatest(0, least(w - 1, CAST(floor((x - greatest(0, {LAYERS[0][2]} - w * cell) // 2) / cell) AS BIGINT))) AS sx, coalesce(sum(n) OVER (PARTITION BY y, x ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY y, x) AS channels FROM g) SELECT vec_id, CAST(channels AS INTEGER) AS channels, CAST((y * {LAYERS[0][2]} + x) * channels + before + c AS INTEGER) AS i, round(CAST(embedding[CAST(start + (sy * w + sx) * n + c + 1 AS BIGINT)] AS DOUBLE), 6) AS v FROM embeddings, s, range(4) k(c) WHERE c < n AND embedding IS NOT NULL",
        "classes_evaluated": f"WITH {BOXES}, d AS (SELECT * FROM boxes WHERE event_id % 2 = 1), t AS (SELECT * FROM boxes WHERE event_id % 2 = 0), p AS (SELECT a.event_id AS d, a.score, b.event_id AS t, round(({INTER}) / (a.w * a.h + b.w * b.h - {INTER}), 9) AS iou FROM d a JOIN t b ON a.image = b.image AND a.event_type = b.event_type), best AS (SELECT * FROM p WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY d ORDER BY iou DESC, t) = 1), hit AS (SELECT d FROM best QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, d) = 1), counts AS (SELECT event_type, floor(score) AS threshold, count(*) FILTER (event_id IN (SELECT d FROM hit)) AS t, count(*) FILTER (event_id NOT IN (SELECT d FROM hit)) AS f FROM d GROUP BY ALL), swept AS (SELECT event_type, threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp, (SELECT count(*) FROM t WHERE t.event_type = counts.event_type) AS np FROM counts WINDOW w AS (PARTITION BY event_type ORDER BY threshold DESC)) SELECT *, round(2 * tp / (tp + fp + np), 6) AS f1 FROM swept",
        "shapes_of_kinds": f"WITH {BOXES}, bins AS (SELECT event_type, greatest(0, least(200, CAST(round(50 * ln(h / w) + 100) AS INTEGER))) AS bin, count(*) AS n FROM boxes GROUP BY ALL), weights AS (SELECT event_type, c, sum(CASE WHEN bin < 200 AND c - bin BETWEEN -99 AND 100 THEN n * exp(-((bin - c) * (bin - c)) / 400.0) ELSE 0 END) AS weight FROM bins, range(201) r(c) GROUP BY ALL), best AS (SELECT event_type, c FROM weights QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(weight, 9) DESC, c) = 1), areas AS (SELECT event_type, w * h AS area, row_number() OVER (PARTITION BY event_type ORDER BY w * h) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM boxes) SELECT event_type, round(exp(0.02 * c - 2), 6) AS aspect, area FROM best JOIN areas USING (event_type) WHERE place = floor(n * 0.2)",
        "images_whitened": f"WITH {levels} SELECT vec_id, i::INTEGER AS i, v::BIGINT AS v FROM level WHERE vec_id % 3 = 0",
    }
