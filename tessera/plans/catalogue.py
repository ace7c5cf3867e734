"""All queries of this package but those of the subpackage llm, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geometry import boxes_or_whole
from tessera.functions.text import class_name
from tessera.operators import cluster, detect, evaluate, harmony, keyed, learn, learner, sampling, score, stats
from tessera.plans.fixtures import BOXES, CELLS, GRID, INTER, SIZES, boxes, grid, sizes, table
from tessera.sources import annotations, model_list
from tessera.streaming import frames

PHRASE = "red widget bolt small widget"
FILTER = {(dy, dx): w for (dy, dx), w in zip([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], (0.1, -0.2, 0.3, -0.4, 1.0, 0.4, -0.3, 0.2, -0.1), strict=True)}
DT = {"a": -0.5, "b": 0.0}
GRANULARITY = 100
MAX_OFFSET = 19
VALUE_STEP = 25


def _synsets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("synset_id"), F.col("p_name").alias("description"), F.col("p_type").alias("kind"))


def _cells(spark, d):
    return stats.cells(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def _r(c, n=6):
    return F.round(c, n)


def synset_list(spark, d):
    return _synsets(spark, d).select("synset_id", "description")


def synset_get(spark, d):
    return _synsets(spark, d).where("synset_id = 7").select("synset_id", "description").limit(1)


def synset_search(spark, d):
    return sampling.search(_synsets(spark, d).drop("kind"), PHRASE, 20)


def mixed_round_robin(spark, d):
    return sampling.round_robin(_synsets(spark, d), "kind", "synset_id", 2, 100).select("kind", "synset_id", "round", "rank")


def annotated_images(spark, d):
    return sampling.annotated(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def negatives_other(spark, d):
    return sampling.negatives(table(spark, d, "documents").select("doc_id", "source"), "source", "src3", "doc_id", 100).select("doc_id", "source", "rank")


def whole_box_fallback(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.struct(F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y"), (10 * F.col("quality")).cast("long").alias("w"), F.lit(5).cast("long").alias("h")).alias("box"))
    found = labels.groupBy("doc_id").agg(F.collect_list("box").alias("boxes"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(found, "doc_id", "left")
    return docs.select("doc_id", F.explode(boxes_or_whole(F.col("boxes"), F.col("n_chars"), F.lit(1))).alias("b")).select("doc_id", "b.x", "b.y", "b.w", "b.h")


def class_from_name(spark, d):
    return _synsets(spark, d).select("synset_id", class_name(F.concat(F.lit("models/"), F.regexp_replace("description", " ", "_"), F.lit("-v2.txt"))).alias("class"))


def channel_mean(spark, d):
    return stats.channel_mean(_cells(spark, d)).select("ch", _r("mean").alias("mean"))


def channel_absmax(spark, d):
    return stats.channel_absmax(_cells(spark, d)).select("ch", _r("absmax").alias("absmax"))


def channel_cov(spark, d):
    return stats.channel_cov(table(spark, d, "embeddings"), "embedding").select("i", "j", _r("cov").alias("cov"))


def autocorr_exact(spark, d):
    g = grid(spark, d)
    mean = g.agg(F.avg("v")).first()[0] or 0.0
    return stats.autocorrelation(g, MAX_OFFSET, mean).select("dx", "dy", _r("cov", 3).alias("cov"), "n")


def autocorr_cyclic(spark, d):
    g = grid(spark, d).withColumn("x", F.col("x") - 1)
    rows = (g.agg(F.max("y")).first()[0] or 0) + 1
    return stats.autocorrelation(g, MAX_OFFSET, 0.0, (rows, 31)).select("dx", "dy", _r("cov", 3).alias("cov"))


def offset_set(spark, d):
    """Offsets of the half plane, and how many pairs of cells all levels have there: a level is a month of a user's days by hours."""
    levels = table(spark, d, "events").groupBy("user_id").agg((F.max(F.dayofmonth("ts")) - F.min(F.dayofmonth("ts")) + 1).alias("rows"), (F.max(F.hour("ts")) - F.min(F.hour("ts")) + 1).alias("cols"))
    return stats.samples_by_offset(levels, 3)


def cell_arith(spark, d):
    return stats.normalized_cells(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "ch", _r("x").alias("x"))


def aspect_mode(spark, d):
    return stats.aspect_weights(stats.aspect_bins(sizes(spark, d), "w", "h")).select(F.col("center").cast("long").alias("center"), _r("weight", 4).alias("weight"), _r(F.exp(0.02 * F.col("center") - 2)).alias("aspect"))


def area_p20(spark, d):
    return stats.area_quantile(sizes(spark, d), F.col("w") * F.col("h"), ["p_type"])


def model_size(spark, d):
    s = sizes(spark, d)
    aspect = stats.common_aspect(stats.aspect_bins(s, "w", "h"))
    area = stats.area_quantile(s.withColumn("all", F.lit(1)), F.col("w") * F.col("h"), ["all"]).first()["area"]
    w, h = stats.model_size(aspect, area)
    return spark.createDataFrame([(w, h)], "width int, height int")


def pyramid_scales(spark, d):
    images = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 32).alias("width"), (F.col("p_size") * 24).alias("height"))
    return score.pyramid_scales(images, "p_partkey", "width", "height").select("p_partkey", F.col("level").cast("long").alias("level"), _r("scale", 9).alias("scale"))


def linear_score(spark, d):
    ramp = F.array(*(F.lit((i - 31.5) / 64) for i in range(64)))
    scored = table(spark, d, "embeddings").select("vec_id", _r(score.dot(F.col("embedding"), ramp)).alias("score"))
    return detect.candidates(scored, 0.0)


def _label_means(spark, d):
    means = _cells(spark, d).groupBy("label", "ch").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("ch", "m"))), lambda p: p["m"]).alias("weights")).withColumnRenamed("label", "component")


def mixture_argmax(spark, d):
    return score.best_component(table(spark, d, "embeddings"), "vec_id", "embedding", _label_means(spark, d)).select("vec_id", F.col("component").alias("label"), "score")


def correlate_grid(spark, d):
    return score.correlate(grid(spark, d), FILTER).select("y", "x", _r("score").alias("score"))


def distance_transform_1d(spark, d):
    return score.distance_transform(grid(spark, d), "y", "x", "v", 1, 31, **DT).select("y", "x", _r("v").alias("v"))


def distance_transform_2d(spark, d):
    g = grid(spark, d)
    last = g.agg(F.max("y")).first()[0] or 0
    rows = score.distance_transform(g, "y", "x", "v", 1, 31, **DT)
    return score.distance_transform(rows, "x", "y", "v", 0, last, **DT).select("y", "x", _r("v").alias("v"))


def part_root_combine(spark, d):
    g = grid(spark, d)
    parts = score.distance_transform(g, "y", "x", "v", 1, 31, **DT)
    return score.combine_part(g, parts, (1, 0), -0.25).select("y", "x", _r("score").alias("score"))


def local_max(spark, d):
    return detect.local_maxima(grid(spark, d))


def box_project(spark, d):
    e = table(spark, d, "events")
    b = e.select("event_id", F.dayofmonth("ts").alias("x"), F.hour("ts").alias("y"), (4 + F.col("event_id") % 9).cast("int").alias("w"), (4 + (F.col("event_id") * 7) % 11).cast("int").alias("h"), F.pow(F.lit(2.0), -(F.col("event_id") % 4).cast("double")).alias("scale"))
    return detect.project_boxes(b, "scale", 640, 480, border=2).select("event_id", "px", "py", "pw", "ph")


def box_overlap(spark, d):
    return detect.overlaps(boxes(spark, d), ["image"], "event_id").select("image", "a_event_id", "b_event_id", "inter", _r("covered").alias("covered"), _r("iou").alias("iou"))


def nms(spark, d):
    return detect.suppress(boxes(spark, d), ["image", "event_type"], "event_id").select("image", "event_type", "event_id", "score")


def topk_detections(spark, d):
    return detect.top_k(boxes(spark, d), ["image"], "event_id", 3).select("image", "event_id", "score", "rank")


def detect_max(spark, d):
    return detect.global_best(boxes(spark, d), "event_type", "event_id")


def distinct_extractors(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(F.countDistinct("p_brand", "p_type").alias("n"))


def _first_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center")).select(F.col("label").alias("cluster"), "center")


def _assigned(spark, d):
    return cluster.assign(table(spark, d, "embeddings"), "vec_id", "embedding", _first_vectors(spark, d))


def kmeans_assign(spark, d):
    return _assigned(spark, d).select("vec_id", "cluster", "distance")


def kmeans_step(spark, d):
    return cluster.new_centroids(_assigned(spark, d), "vec_id", "embedding").select("cluster", "ch", _r("center").alias("center"))


def kmeans_error(spark, d):
    return _assigned(spark, d).agg(_r(F.sum("distance"), 4).alias("error"), F.count(F.lit(1)).alias("n"))


def kmeans_fit(spark, d):
    return cluster.fit(table(spark, d, "embeddings"), "embedding", 10, [1, 2, 3])


def merge_clusters(spark, d):
    """Bins of aspect ratios of each kind of part, those near each other merged: all kinds at once."""
    ratio = F.round(50 * F.log(F.col("h") / F.col("w"))) / 50
    bins = sizes(spark, d).groupBy("p_type", F.floor(ratio * 4).alias("bin")).agg(F.avg(ratio).alias("center"), F.count(F.lit(1)).alias("n"))
    centers = bins.select("p_type", F.col("bin").alias("cluster"), F.array("center").alias("center"), "n")
    return centers.join(keyed.merged(centers, "p_type", 0.2), ["p_type", "cluster"]).select("p_type", F.col("cluster").alias("bin"), "n", F.col("into").alias("cluster"))


def cluster_sizes(spark, d):
    return cluster.cluster_sizes(table(spark, d, "embeddings"), "label")


def lda_diag(spark, d):
    return learn.diagonal_discriminant(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("label", "ch", _r("weight").alias("weight"), _r("f", 4).alias("f"), _r("threshold", 4).alias("threshold"))


def lda_full(spark, d):
    return learn.full_discriminants(table(spark, d, "embeddings"), "embedding", "label")


def loo_score(spark, d):
    return learn.leave_one_out(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "label", _r("score").alias("score"))


def lda_three(spark, d):
    """Discriminants of all labels in the first three channels."""
    return learn.full_discriminants(table(spark, d, "embeddings").withColumn("embedding", F.slice("embedding", 1, 3)), "embedding", "label").select("label", F.posexplode("weights").alias("ch", "weight"), "threshold", "f").select("label", "ch", *(_r(c, 5).alias(c) for c in ("weight", "threshold", "f")))


def pca_two(spark, d):
    """The first two channels on their axes."""
    found = learn.project_pca(table(spark, d, "embeddings").withColumn("embedding", F.slice("embedding", 1, 2)), "vec_id", "embedding", 2)
    return found.select("vec_id", *(_r(F.col("projected")[i], 6).alias(f"p{i}") for i in range(2)))


def pca_project(spark, d):
    return learn.project_pca(table(spark, d, "embeddings"), "vec_id", "embedding", 4)


def _split(spark, d):
    b = boxes(spark, d)
    return b.where("event_type = 'click'"), b.where("event_type = 'purchase'")


def match_tp_fp(spark, d):
    return evaluate.match(*_split(spark, d), "image", "event_id", 0.3)


def _results(spark, d):
    scored = boxes(spark, d).select("score", (F.col("event_type") == "purchase").alias("hit"))
    n = scored.where("hit").count()
    return evaluate.sweep(scored, n, GRANULARITY)


def threshold_sweep(spark, d):
    return _results(spark, d).select("threshold", "tp", "fp", "np", _r(evaluate.precision()).alias("precision"), _r(evaluate.recall()).alias("recall"))


def fmeasure_curve(spark, d):
    return _results(spark, d).select("threshold", _r(evaluate.f_measure(1.0)).alias("f1"), _r(evaluate.f_measure(2.0)).alias("f2"))


def max_fmeasure(spark, d):
    return evaluate.max_f_measure(_results(spark, d)).select("threshold", _r("f_measure").alias("f_measure"))


def fmeasure_at(spark, d):
    return evaluate.f_measure_at(_results(spark, d), 50.0).select("threshold", _r("f_measure").alias("f_measure"))


def pr_interpolated(spark, d):
    return evaluate.interpolated(_results(spark, d)).select(_r("recall").alias("recall"), _r("precision").alias("precision"))


def average_precision(spark, d):
    return evaluate.average_precision(_results(spark, d)).select(_r("average_precision").alias("average_precision"))


def average_precision_shown(spark, d):
    return evaluate.average_precision(_results(spark, d), as_shown=True).select(_r("average_precision").alias("average_precision"))


def _run(spark, d):
    """Detections against objects: matched, then counted by threshold."""
    found, objects = _split(spark, d)
    return evaluate.sweep(evaluate.match(found, objects, "image", "event_id", 0.3), objects.count(), GRANULARITY)


def evaluate_run(spark, d):
    return _run(spark, d).select("threshold", "tp", "fp", "np", _r(evaluate.precision()).alias("precision"), _r(evaluate.recall()).alias("recall"), _r(evaluate.f_measure(1.0)).alias("f1"))


def average_precision_detected(spark, d):
    return evaluate.average_precision(_run(spark, d)).select(_r("average_precision").alias("average_precision"))


def model_size_range(spark, d):
    """Sizes of templates over the classes of parts: rows of a part's size, columns of its key."""
    templates = table(spark, d, "part").select(F.col("p_brand").alias("class"), F.col("p_size").cast("long").alias("rows"), (1 + F.col("p_partkey") % 20).alias("cols"))
    return learner.size_range(templates, "class")


def models_replaced(spark, d):
    """Models by class, of which those of small items are learned anew."""
    old = table(spark, d, "part").groupBy(F.col("p_brand").alias("class")).agg(F.max("p_size").alias("size"))
    new = table(spark, d, "part").where("p_size < 3").groupBy(F.col("p_brand").alias("class")).agg(F.min("p_size").alias("size"))
    return sampling.replace_by_key(old, new, "class")


def _two_models(spark, d):
    """Objects are image and hour of purchases; models are clicks and views of even and odd ids, with the value as score."""
    b = boxes(spark, d)
    objects = b.where("event_type = 'purchase'").select("image", "x").distinct()
    hits = b.where("event_type IN ('click', 'view')").select((F.col("event_type") == "view").cast("int").alias("model"), "image", "x", F.least(F.lit(16), F.floor(F.col("score") / VALUE_STEP)).cast("int").alias("bin"))
    return objects, hits


def threshold_grid(spark, d):
    objects, hits = _two_models(spark, d)
    return harmony.joint_f_grid(objects, hits, ["image", "x"], 17).select("bin_a", "bin_b", "tp", "fp", _r("f_measure").alias("f_measure"))


def threshold_harmony(spark, d):
    objects, hits = _two_models(spark, d)
    found = harmony.search(objects, hits, ["image", "x"], [17, 17], seed=1)
    return found.select(F.col("thresholds")[0].alias("bin_a"), F.col("thresholds")[1].alias("bin_b"), _r("f_measure").alias("f_measure"))


def model_list_parse(spark, d):
    lines = _synsets(spark, d).select(
        "synset_id",
        F.when(F.col("synset_id") % 7 == 0, F.concat(F.lit("# "), F.lit('"'), "description", F.lit('" m'), F.col("synset_id").cast("string"), F.lit(".txt 0.5")))
        .when(F.col("synset_id") % 7 == 1, F.lit("# a remark"))
        .otherwise(F.concat(F.lit('"'), "description", F.lit('" m'), F.col("synset_id").cast("string"), F.lit(".txt "), (F.col("synset_id") % 10 / 10).cast("string"), F.lit(" n"), F.col("synset_id").cast("string")))
        .alias("value"),
    )
    return model_list.parse(lines, "value").select("synset_id", "classname", "modelfile", "threshold", "synset", "disabled")


def annotation_parse(spark, d):
    return annotations.attributes(table(spark, d, "pages"), "page_id", "html", "a", "href")


def latest_frame(spark, d):
    return frames.latest(table(spark, d, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")), ["user_id", "hour"], "ts", "event_id")


def rate_last_n(spark, d):
    return frames.rate(table(spark, d, "events"), "user_id", "ts", "event_id", 10).select("user_id", "event_id", _r("rate").alias("rate"))


_NOT_QUERIES = {"boxes", "grid", "sizes", "table", "boxes_or_whole", "class_name", "queries", "oracle_sql"}


def queries() -> dict:
    return {k: v for k, v in globals().items() if callable(v) and not k.startswith("_") and k not in _NOT_QUERIES and getattr(v, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    phrase = ", ".join(f"'{w}'" for w in PHRASE.split())
    lists = "list_filter(regexp_split_to_array(lower(p_name), '[ .,;]+'), lambda w: w <> '')"
    taps = ", ".join(f"({dy}, {dx}, CAST({f} AS DOUBLE))" for (dy, dx), f in FILTER.items())
    half = "half AS (SELECT dx, dy FROM range(20) a(dx), range(-19, 20) b(dy) WHERE dx > 0 OR dy >= 0)"
    bins = "bins AS (SELECT greatest(0, least(200, CAST(round(50 * ln(h / w) + 100) AS BIGINT))) AS bin, count(*) AS n FROM sizes WHERE w > 0 AND h > 0 GROUP BY ALL)"
    weights = "weights AS (SELECT c AS center, coalesce((SELECT sum(n * exp(-CAST((bin - c) * (bin - c) AS DOUBLE) / 400)) FROM bins WHERE bin < 200 AND bin - c BETWEEN -100 AND 99), 0) AS weight FROM range(201) r(c))"
    ranked = "ranked AS (SELECT {by} w * h AS area, row_number() OVER ({part} ORDER BY w * h) AS rn, count(*) OVER ({part}) AS n FROM sizes)"
    means = "means AS (SELECT label, ch, avg(x) AS m FROM cells GROUP BY ALL)"
    centers = "centers AS (SELECT label AS cluster, arg_min(embedding, vec_id) AS center FROM embeddings GROUP BY label)"
    assigned = "told AS (SELECT vec_id, embedding, cluster, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(center[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(center[i] AS DOUBLE)))), 6) AS distance FROM embeddings, centers), assigned AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
    results = "counts AS (SELECT floor(score * 100) / 100 AS threshold, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS f FROM boxes GROUP BY ALL), results AS (SELECT threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp, (SELECT count(*) FROM boxes WHERE event_type = 'purchase') AS np FROM counts WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN np > 0 THEN tp / np END AS r FROM results)"
    f = "CASE WHEN {b} * {b} * p + r > 0 THEN (1 + {b} * {b}) * p * r / ({b} * {b} * p + r) WHEN {b} * {b} * p + r = 0 THEN 0 END"
    curve = "points AS (SELECT round(r, 9) AS recall, max(p) AS p FROM pr GROUP BY ALL), curve AS (SELECT recall, max(p) OVER (ORDER BY recall DESC ROWS UNBOUNDED PRECEDING) AS precision FROM points)"
    matched = f"d AS (SELECT * FROM boxes WHERE event_type = 'click'), t AS (SELECT * FROM boxes WHERE event_type = 'purchase'), p AS (SELECT a.event_id AS d, a.score, b.event_id AS t, round(({INTER}) / (a.w * a.h + b.w * b.h - {INTER}), 9) AS iou FROM d a JOIN t b ON a.image = b.image), best AS (SELECT * FROM p WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY d ORDER BY iou DESC, t) = 1), hit AS (SELECT d FROM best QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, d) = 1), scored AS (SELECT event_id, score, event_id IN (SELECT d FROM hit) AS hit FROM d)"
    run = matched + ", " + results.replace("event_type = 'purchase' THEN 1", "hit THEN 1").replace("event_type = 'purchase' THEN 0", "hit THEN 0").replace("FROM boxes GROUP", "FROM scored GROUP")
    line = "SELECT {line}, t.i AS {along}, max(v + -0.5 * (t.i - {along}) * (t.i - {along})) AS v FROM {src}, range({a}, {b}) t(i) GROUP BY ALL"
    dt1 = line.format(line="y", along="x", src="grid", a=1, b=32)
    columns = "SELECT x, CAST(t.i AS BIGINT) AS y, max(v + -0.5 * (t.i - y) * (t.i - y)) AS v FROM r, (SELECT unnest(range((SELECT max(y) + 1 FROM grid))) AS i) t GROUP BY ALL"
    pairs = f"{BOXES}, o AS (SELECT DISTINCT image, x FROM boxes WHERE event_type = 'purchase'), h AS (SELECT event_type, image, x, least(16, CAST(floor(score / {VALUE_STEP}) AS INTEGER)) AS bin FROM boxes WHERE event_type IN ('click', 'view')), best AS (SELECT o.image, o.x, coalesce(max(bin) FILTER (event_type = 'click'), -1) AS a, coalesce(max(bin) FILTER (event_type = 'view'), -1) AS b FROM o LEFT JOIN h ON h.image = o.image AND h.x = o.x GROUP BY ALL), miss AS (SELECT event_type, bin FROM h WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image = h.image AND o.x = h.x)), g AS (SELECT CAST(i AS INTEGER) AS bin_a, CAST(j AS INTEGER) AS bin_b FROM range(17) a(i), range(17) b(j)), c AS (SELECT bin_a, bin_b, (SELECT count(*) FROM best WHERE a >= bin_a OR b >= bin_b) AS tp, (SELECT count(*) FROM miss WHERE (event_type = 'click' AND bin >= bin_a) OR (event_type = 'view' AND bin >= bin_b)) AS fp, (SELECT count(*) FROM o) AS np FROM g)"
    joint = "CASE WHEN tp + fp + np > 0 THEN 2 * tp / (tp + fp + np) ELSE 0 END"
    out = {
        "synset_list": "SELECT p_partkey AS synset_id, p_name AS description FROM part",
        "synset_get": "SELECT p_partkey AS synset_id, p_name AS description FROM part WHERE p_partkey = 7",
        "synset_search": f"SELECT * FROM (SELECT p_partkey AS synset_id, p_name AS description, len(list_filter([{phrase}], lambda w: list_contains({lists}, w))) AS score FROM part) WHERE score > 0 ORDER BY score DESC, synset_id LIMIT 20",
        "mixed_round_robin": "SELECT kind, synset_id, (rank - 1) // 2 AS round, rank FROM (SELECT p_type AS kind, p_partkey AS synset_id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rank FROM part) ORDER BY round, kind, rank LIMIT 100",
        "annotated_images": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "negatives_other": "SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source <> 'src3') ORDER BY rank, source LIMIT 100",
        "whole_box_fallback": "SELECT d.doc_id, CASE WHEN good THEN 1 ELSE 0 END::BIGINT AS x, CASE WHEN good THEN 2 ELSE 0 END::BIGINT AS y, CASE WHEN good THEN 10 ELSE n_chars END::BIGINT AS w, CASE WHEN good THEN 5 ELSE 1 END::BIGINT AS h FROM documents d LEFT JOIN (SELECT doc_id, quality > 0 AS good FROM labels) l ON d.doc_id = l.doc_id",
        "class_from_name": "SELECT p_partkey AS synset_id, array_to_string(list_transform(string_split(lower(p_name) || ' v2', ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS class FROM part",
        "channel_mean": f"WITH {CELLS} SELECT ch, round(avg(x), 6) AS mean FROM cells GROUP BY ch",
        "channel_absmax": f"WITH {CELLS} SELECT ch, round(max(abs(x)), 6) AS absmax FROM cells GROUP BY ch",
        "channel_cov": f"WITH {CELLS} SELECT a.ch AS i, b.ch AS j, round(covar_pop(a.x, b.x), 6) AS cov FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.ch <= b.ch GROUP BY ALL",
        "autocorr_exact": f"WITH {GRID}, {half}, c AS (SELECT y, x, v - (SELECT avg(v) FROM grid) AS v FROM grid), sent AS (SELECT y + dy AS y, x + dx AS x, v, dx, dy FROM c, half) SELECT dx, dy, round(avg(a.v * b.v), 3) AS cov, count(*) AS n FROM sent a JOIN c b ON a.y = b.y AND a.x = b.x GROUP BY ALL",
        "autocorr_cyclic": f"WITH {GRID}, {half}, c AS (SELECT y, x - 1 AS x, v FROM grid), s AS (SELECT max(y) + 1 AS rows FROM c), sent AS (SELECT ((y + dy) % rows + rows) % rows AS y, (x + dx) % 31 AS x, v, dx, dy, rows FROM c, s, half) SELECT dx, dy, round(sum(a.v * b.v) / (any_value(rows) * 31), 3) AS cov FROM sent a JOIN c b ON a.y = b.y AND a.x = b.x GROUP BY ALL",
        "lda_three": f"WITH {CELLS}, v AS (SELECT vec_id, label, max(x) FILTER (ch = 0) AS x, max(x) FILTER (ch = 1) AS y, max(x) FILTER (ch = 2) AS z FROM cells WHERE ch < 3 GROUP BY ALL), m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, var_pop(x) + 0.01 AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, var_pop(y) + 0.01 AS d, covar_pop(y, z) AS e, var_pop(z) + 0.01 AS g FROM v), inv AS (SELECT *, d * g - e * e AS i, c * e - b * g AS j, b * e - c * d AS k, a * g - c * c AS l, b * c - a * e AS o, a * d - b * b AS p FROM m), det AS (SELECT *, a * i + b * j + c * k AS det FROM inv), own AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v GROUP BY label), s AS (SELECT label, o.x AS px, o.y AS py, o.z AS pz, q.x AS mx, q.y AS my, q.z AS mz, [(i * o.x + j * o.y + k * o.z) / det, (j * o.x + l * o.y + q.o * o.z) / det, (k * o.x + q.o * o.y + p * o.z) / det] AS sp, [(i * q.x + j * q.y + k * q.z) / det, (j * q.x + l * q.y + q.o * q.z) / det, (k * q.x + q.o * q.y + p * q.z) / det] AS sm FROM own o, det q), w AS (SELECT label, [sp[1] - sm[1], sp[2] - sm[2], sp[3] - sm[3]] AS w, (mx * sm[1] + my * sm[2] + mz * sm[3] - px * sp[1] - py * sp[2] - pz * sp[3]) / 2 AS bias FROM s), f AS (SELECT *, greatest(abs(w[1]), abs(w[2]), abs(w[3])) AS f FROM w) SELECT label, CAST(ch AS INTEGER) AS ch, round(w[ch + 1] / f, 5) AS weight, round(-bias / f, 5) AS threshold, round(f, 5) AS f FROM f, range(3) r(ch)",
        "pca_two": f"WITH {CELLS}, v AS (SELECT vec_id, max(x) FILTER (ch = 0) AS x, max(x) FILTER (ch = 1) AS y FROM cells WHERE ch < 2 GROUP BY vec_id), m AS (SELECT avg(x) AS x, avg(y) AS y, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM v), e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS top FROM m), u AS (SELECT x AS mx, y AS my, b / sqrt(b * b + (top - a) * (top - a)) AS ux, (top - a) / sqrt(b * b + (top - a) * (top - a)) AS uy FROM e), s AS (SELECT *, CASE WHEN abs(ux) >= abs(uy) THEN sign(ux) ELSE sign(uy) END AS s0, CASE WHEN abs(uy) >= abs(ux) THEN sign(-uy) ELSE sign(ux) END AS s1 FROM u) SELECT vec_id, round(s0 * ((x - mx) * ux + (y - my) * uy), 6) AS p0, round(s1 * ((y - my) * ux - (x - mx) * uy), 6) AS p1 FROM v, s",
        "offset_set": "WITH l AS (SELECT max(day(ts)) - min(day(ts)) + 1 AS r, max(hour(ts)) - min(hour(ts)) + 1 AS c FROM events GROUP BY user_id) SELECT dx, dy, CAST(sum(greatest(0, r - abs(dy)) * greatest(0, c - dx)) AS BIGINT) AS n FROM l, range(4) a(dx), range(-3, 4) b(dy) WHERE dx > 0 OR dy >= 0 GROUP BY dx, dy",
        "cell_arith": f"WITH {CELLS}, {means}, tops AS (SELECT ch, max(abs(x)) AS t FROM cells GROUP BY ch) SELECT vec_id, c.ch, round((x - m) / t, 6) AS x FROM cells c JOIN means m ON c.label = m.label AND c.ch = m.ch JOIN tops t ON t.ch = c.ch",
        "aspect_mode": f"WITH {SIZES}, {bins}, {weights} SELECT center, round(weight, 4) AS weight, round(exp(0.02 * center - 2), 6) AS aspect FROM weights",
        "area_p20": f"WITH {SIZES}, {ranked.format(by='p_type,', part='PARTITION BY p_type')} SELECT p_type, area FROM ranked WHERE rn = floor(n * 0.2) + 1",
        "model_size": f"WITH {SIZES}, {bins}, {weights}, {ranked.format(by='', part='')}, b AS (SELECT exp(0.02 * arg_max(center, round(weight, 9) * 1000 - center / 1e6) - 2) AS aspect FROM weights), a AS (SELECT least(greatest(floor(area), 5000), 7000) AS area FROM ranked WHERE rn = floor(n * 0.2) + 1), s AS (SELECT aspect, area, greatest(area / (aspect * 25600), area * aspect / 25600) AS over FROM a, b), t AS (SELECT aspect, CASE WHEN over > 1 THEN floor(area / over) ELSE area END AS area FROM s) SELECT CAST(greatest(floor(sqrt(area / aspect) / 8 + 0.5), 1) AS INTEGER) AS width, CAST(greatest(floor(sqrt(area / aspect) * aspect / 8 + 0.5), 1) AS INTEGER) AS height FROM t",
        "pyramid_scales": "WITH t AS (SELECT p_partkey, CAST(10 * ceil(round(log2(p_size * 24 / 40.0), 9)) AS BIGINT) AS top FROM part) SELECT p_partkey, level, round(pow(2.0, 1 - level / 10.0), 9) AS scale FROM t, LATERAL (SELECT unnest(range(top + 1)) AS level) WHERE top >= 10",
        "linear_score": f"WITH {CELLS} SELECT vec_id, round(sum(x * ((ch - 31.5) / 64)), 6) AS score FROM cells GROUP BY vec_id HAVING round(sum(x * ((ch - 31.5) / 64)), 6) > 0",
        "mixture_argmax": f"WITH {CELLS}, {means}, s AS (SELECT c.vec_id, m.label, round(sum(c.x * m.m), 6) AS score FROM cells c JOIN means m ON c.ch = m.ch GROUP BY ALL) SELECT vec_id, label, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1",
        "correlate_grid": f"WITH {GRID}, taps(dy, dx, f) AS (VALUES {taps}) SELECT g.y, g.x, round(sum(n.v * f), 6) AS score FROM grid g, taps JOIN grid n ON n.y = g.y + dy AND n.x = g.x + dx GROUP BY ALL",
        "distance_transform_1d": f"WITH {GRID} SELECT y, x, round(v, 6) AS v FROM ({line.format(line='y', along='x', src='grid', a=1, b=32)})",
        "distance_transform_2d": f"WITH {GRID}, r AS ({dt1}) SELECT y, x, round(v, 6) AS v FROM ({columns})",
        "part_root_combine": f"WITH {GRID}, r AS ({dt1}) SELECT g.y, g.x, round(g.v + r.v - 0.25, 6) AS score FROM grid g JOIN r ON r.y = 2 * g.y + 1 AND r.x = 2 * g.x",
        "local_max": f"WITH {GRID} SELECT y, x, v FROM grid g WHERE NOT EXISTS (SELECT 1 FROM grid n, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE (dy <> 0 OR dx <> 0) AND n.y = g.y + dy AND n.x = g.x + dx AND n.v >= g.v)",
        "box_project": "WITH b AS (SELECT event_id, day(ts) AS x, hour(ts) AS y, 4 + event_id % 9 AS w, 4 + (event_id * 7) % 11 AS h, pow(2.0, -(event_id % 4)) AS s FROM events), p AS (SELECT event_id, CAST(floor(x / s + 0.5) AS INTEGER) * 8 + 2 AS l, CAST(floor(y / s + 0.5) AS INTEGER) * 8 + 2 AS t, CAST(floor(w / s + 0.5) AS INTEGER) * 8 AS w, CAST(floor(h / s + 0.5) AS INTEGER) * 8 AS h FROM b), q AS (SELECT event_id, greatest(0, l) AS px, greatest(0, t) AS py, least(640, l + w) - greatest(0, l) AS pw, least(480, t + h) - greatest(0, t) AS ph FROM p) SELECT * FROM q WHERE pw > 0 AND ph > 0",
        "box_overlap": f"WITH {BOXES}, p AS (SELECT a.image, a.event_id AS a_event_id, b.event_id AS b_event_id, {INTER} AS inter, a.w * a.h AS aa, b.w * b.h AS ba FROM boxes a JOIN boxes b ON a.image = b.image AND (a.score > b.score OR (a.score = b.score AND a.event_id < b.event_id))) SELECT image, a_event_id, b_event_id, inter, round(inter / ba, 6) AS covered, round(inter / (aa + ba - inter), 6) AS iou FROM p WHERE inter > 0",
        "nms": f"WITH RECURSIVE {BOXES}, b AS (SELECT *, row_number() OVER (PARTITION BY image, event_type ORDER BY score DESC, event_id) AS rn FROM boxes), s AS (SELECT image, event_type, CAST(1 AS BIGINT) AS rn, [{{'e': event_id, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM b WHERE rn = 1 UNION ALL SELECT s.image, s.event_type, b.rn, CASE WHEN len(list_filter(s.kept, lambda a: greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.5 * b.w * b.h)) > 0 THEN s.kept ELSE list_append(s.kept, {{'e': b.event_id, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) END FROM s JOIN b ON b.image = s.image AND b.event_type = s.event_type AND b.rn = s.rn + 1), l AS (SELECT image, event_type, unnest(kept).e AS event_id FROM s QUALIFY rn = max(rn) OVER (PARTITION BY image, event_type)) SELECT l.image, l.event_type, l.event_id, boxes.score FROM l JOIN boxes ON boxes.event_id = l.event_id",
        "topk_detections": f"WITH {BOXES} SELECT image, event_id, score, row_number() OVER (PARTITION BY image ORDER BY score DESC, event_id) AS rank FROM boxes QUALIFY rank <= 3",
        "detect_max": f"WITH {BOXES} SELECT event_type, event_id, score FROM boxes QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) = 1",
        "distinct_extractors": "SELECT p_size, count(DISTINCT (p_brand, p_type)) AS n FROM part GROUP BY p_size",
        "kmeans_assign": f"WITH {centers}, {assigned} SELECT vec_id, cluster, distance FROM assigned",
        "kmeans_step": f"WITH {centers}, {assigned} SELECT cluster, CAST(i AS INTEGER) AS ch, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS center FROM assigned, range(64) r(i) GROUP BY ALL",
        "kmeans_error": f"WITH {centers}, {assigned} SELECT round(sum(distance), 4) AS error, count(*) AS n FROM assigned",
        "cluster_sizes": "SELECT label, count(*) AS n, count(*) < floor((SELECT count(*) FROM embeddings) / 10) AS small FROM embeddings GROUP BY label",
        "lda_diag": f"WITH {CELLS}, o AS (SELECT ch, avg(x) AS m0, var_pop(x) AS var FROM cells GROUP BY ch), w AS (SELECT label, m.ch, m0, m AS m1, (m - m0) / (var + 0.01) AS w, (m0 * m0 - m * m) / (var + 0.01) / 2 AS part FROM (SELECT label, ch, avg(x) AS m FROM cells GROUP BY ALL) m JOIN o ON o.ch = m.ch), t AS (SELECT label, max(abs(w)) AS f, sum(part) AS bias FROM w GROUP BY label) SELECT w.label, ch, round(w / f, 6) AS weight, round(f, 4) AS f, round(-bias / f, 4) AS threshold FROM w JOIN t ON w.label = t.label",
        "loo_score": f"WITH {CELLS}, t AS (SELECT label, ch, sum(x) AS s, count(*) AS n FROM cells GROUP BY ALL) SELECT vec_id, c.label, round(sum(x * (s - x)) / (any_value(n) - 1), 6) AS score FROM cells c JOIN t ON t.label = c.label AND t.ch = c.ch WHERE n > 1 GROUP BY ALL",
        "match_tp_fp": f"WITH {BOXES}, {matched} SELECT event_id, score, hit FROM scored",
        "threshold_sweep": f"WITH {BOXES}, {results} SELECT threshold, tp, fp, np, round(p, 6) AS precision, round(r, 6) AS recall FROM pr",
        "fmeasure_curve": f"WITH {BOXES}, {results} SELECT threshold, round({f.format(b=1)}, 6) AS f1, round({f.format(b=2)}, 6) AS f2 FROM pr",
        "max_fmeasure": f"WITH {BOXES}, {results} SELECT threshold, round(v, 6) AS f_measure FROM (SELECT threshold, round({f.format(b=1)}, 9) AS v FROM pr) ORDER BY v DESC, threshold LIMIT 1",
        "fmeasure_at": f"WITH {BOXES}, {results} SELECT threshold, round({f.format(b=1)}, 6) AS f_measure FROM pr WHERE threshold >= 50 ORDER BY threshold LIMIT 1",
        "pr_interpolated": f"WITH {BOXES}, {results}, {curve} SELECT round(recall, 6) AS recall, round(precision, 6) AS precision FROM curve",
        "average_precision": f"WITH {BOXES}, {results}, {curve} SELECT round(sum(s), 6) AS average_precision FROM (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY recall), 0)) * precision AS s FROM curve)",
        "average_precision_shown": f"WITH {BOXES}, {results}, {curve} SELECT round(sum(s), 6) AS average_precision FROM (SELECT (recall - coalesce(lag(recall) OVER w, 0)) * coalesce(lag(precision) OVER w, precision) AS s FROM curve WINDOW w AS (ORDER BY recall))",
        "evaluate_run": f"WITH {BOXES}, {run} SELECT threshold, tp, fp, np, round(p, 6) AS precision, round(r, 6) AS recall, round({f.format(b=1)}, 6) AS f1 FROM pr",
        "average_precision_detected": f"WITH {BOXES}, {run}, {curve} SELECT round(sum(s), 6) AS average_precision FROM (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY recall), 0)) * precision AS s FROM curve)",
        "models_replaced": "WITH new AS (SELECT p_brand AS class, min(p_size) AS size FROM part WHERE p_size < 3 GROUP BY ALL) SELECT p_brand AS class, max(p_size) AS size FROM part WHERE p_brand NOT IN (SELECT class FROM new) GROUP BY ALL UNION ALL SELECT class, size FROM new",
        "model_size_range": "SELECT p_brand AS class, min(p_size)::BIGINT AS min_rows, min(1 + p_partkey % 20) AS min_cols, max(p_size)::BIGINT AS max_rows, max(1 + p_partkey % 20) AS max_cols FROM part GROUP BY ALL",
        "threshold_grid": f"WITH {pairs} SELECT bin_a, bin_b, tp, fp, round({joint}, 6) AS f_measure FROM c",
        "threshold_harmony": f"WITH {pairs} SELECT bin_a, bin_b, round({joint}, 6) AS f_measure FROM c ORDER BY {joint} DESC, bin_a, bin_b LIMIT 1",
        "model_list_parse": "SELECT p_partkey AS synset_id, p_name AS classname, 'm' || p_partkey || '.txt' AS modelfile, CASE WHEN p_partkey % 7 = 0 THEN 0.5 ELSE (p_partkey % 10)::DOUBLE / 10 END::DOUBLE AS threshold, CASE WHEN p_partkey % 7 <> 0 THEN 'n' || p_partkey END AS synset, p_partkey % 7 = 0 AS disabled FROM part WHERE p_partkey % 7 <> 1",
        "annotation_parse": "SELECT page_id, CAST(count(*) AS BIGINT) AS n, min(v) AS first, max(v) AS last FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS v FROM pages) GROUP BY page_id",
        "latest_frame": "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL",
        "rate_last_n": "SELECT user_id, event_id, round(CASE WHEN ts > first THEN 9e6 / (epoch_us(ts) - epoch_us(first)) END, 6) AS rate FROM (SELECT user_id, event_id, ts, lag(ts, 9) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events) WHERE first IS NOT NULL",
    }
    return out
