"""Queries against statements and brute force over the whole input: all rows, columns, pairs and thresholds."""

import duckdb
import numpy as np
import pytest

from tessera.operators import evaluate, score, stats
from tessera.plans import catalogue
from tessera.plans.fixtures import BOXES, CELLS, GRID
from tests.conftest import plain

DATA = "/root/testdata/sf0.01"

LINE = "SELECT {line}, t.i AS {along}, max(v + -0.5 * (t.i - {along}) * (t.i - {along})) AS v FROM {src}, range({a}, {b}) t(i) GROUP BY ALL"
ROWS = f"r AS ({LINE.format(line='y', along='x', src='grid', a=1, b=32)})"
COLUMNS = "SELECT x, CAST(t.i AS BIGINT) AS y, max(v + -0.5 * (t.i - y) * (t.i - y)) AS v FROM r, (SELECT unnest(range((SELECT max(y) + 1 FROM grid))) AS i) t GROUP BY ALL"

RESULTS = "counts AS (SELECT floor(score * 100) / 100 AS threshold, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS f FROM boxes GROUP BY ALL), results AS (SELECT threshold, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp, (SELECT count(*) FROM boxes WHERE event_type = 'purchase') AS np FROM counts WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN np > 0 THEN tp / np END AS r FROM results)"
F_MEASURE = "CASE WHEN {b} * {b} * p + r > 0 THEN (1 + {b} * {b}) * p * r / ({b} * {b} * p + r) WHEN {b} * {b} * p + r = 0 THEN 0 END"
HALF = "half AS (SELECT dx, dy FROM range(20) a(dx), range(-19, 20) b(dy) WHERE dx > 0 OR dy >= 0)"
CURVE = "points AS (SELECT round(r, 9) AS recall, max(p) AS p FROM pr GROUP BY ALL), curve AS (SELECT recall, max(p) OVER (ORDER BY recall DESC ROWS UNBOUNDED PRECEDING) AS precision FROM points)"

WHOLE = {
    "distance_transform_2d": f"WITH {GRID}, {ROWS} SELECT y, x, round(v, 6) AS v FROM ({COLUMNS})",
    "part_root_combine": f"WITH {GRID}, {ROWS} SELECT g.y, g.x, round(g.v + r.v - 0.25, 6) AS score FROM grid g JOIN r ON r.y = 2 * g.y + 1 AND r.x = 2 * g.x",
    "channel_cov": f"WITH {CELLS} SELECT a.ch AS i, b.ch AS j, round(covar_pop(a.x, b.x), 6) AS cov FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.ch <= b.ch GROUP BY ALL",
    "autocorr_exact": f"WITH {GRID}, {HALF}, c AS (SELECT y, x, v - (SELECT avg(v) FROM grid) AS v FROM grid), sent AS (SELECT y + dy AS y, x + dx AS x, v, dx, dy FROM c, half) SELECT dx, dy, round(avg(a.v * b.v), 3) AS cov, count(*) AS n FROM sent a JOIN c b ON a.y = b.y AND a.x = b.x GROUP BY ALL",
    "autocorr_cyclic": f"WITH {GRID}, {HALF}, c AS (SELECT y, x - 1 AS x, v FROM grid), s AS (SELECT max(y) + 1 AS rows FROM c), sent AS (SELECT (y + dy + rows) % rows AS y, (x + dx) % 31 AS x, v, dx, dy, rows FROM c, s, half) SELECT dx, dy, round(sum(a.v * b.v) / (any_value(rows) * 31), 3) AS cov FROM sent a JOIN c b ON a.y = b.y AND a.x = b.x GROUP BY ALL",
    "threshold_sweep": f"WITH {BOXES}, {RESULTS} SELECT threshold, tp, fp, np, round(p, 6) AS precision, round(r, 6) AS recall FROM pr",
    "fmeasure_curve": f"WITH {BOXES}, {RESULTS} SELECT threshold, round({F_MEASURE.format(b=1)}, 6) AS f1, round({F_MEASURE.format(b=2)}, 6) AS f2 FROM pr",
    "max_fmeasure": f"WITH {BOXES}, {RESULTS} SELECT threshold, round(v, 6) AS f_measure FROM (SELECT threshold, round({F_MEASURE.format(b=1)}, 9) AS v FROM pr) ORDER BY v DESC, threshold LIMIT 1",
    "fmeasure_at": f"WITH {BOXES}, {RESULTS} SELECT threshold, round({F_MEASURE.format(b=1)}, 6) AS f_measure FROM pr WHERE threshold >= 50 ORDER BY threshold LIMIT 1",
    "pr_interpolated": f"WITH {BOXES}, {RESULTS}, {CURVE} SELECT round(recall, 6) AS recall, round(precision, 6) AS precision FROM curve",
    "average_precision": f"WITH {BOXES}, {RESULTS}, {CURVE} SELECT round(sum(s), 6) AS average_precision FROM (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY recall), 0)) * precision AS s FROM curve)",
    "average_precision_shown": f"WITH {BOXES}, {RESULTS}, {CURVE} SELECT round(sum(s), 6) AS average_precision FROM (SELECT (recall - coalesce(lag(recall) OVER w, 0)) * coalesce(lag(precision) OVER w, precision) AS s FROM curve WINDOW w AS (ORDER BY recall))",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_covers_the_whole_input(name, spark):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DATA)
    wanted = con.execute(WHOLE[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in wanted.fetchall())


@pytest.mark.parametrize(("a", "b", "top"), [(-0.5, 0.0, 10), (-0.01, 0.3, 500), (-2.0, -1.5, 3000)])
def test_distance_transform_in_blocks(spark, a, b, top):
    """Gaps of several blocks, a peak that reaches over several blocks, places out of range, repeated places."""
    rng = np.random.default_rng(5)
    rows = [(line, int(y), float(rng.integers(0, top))) for line in range(3) for y in [*range(-9, 40), *range(120, 130, line + 1), 199, 199, 230] if rng.random() < 0.8]
    rows += [(1, 21, 50.0 * top), (7, 64, 1.0)]
    df = spark.createDataFrame(rows, "x long, y long, v double")
    got = {(r.x, r.y): r.v for r in score.distance_transform(df, "x", "y", "v", 2, 210, a, b, block=8).collect()}
    want = {(x, i): max(v + a * (i - y) ** 2 + b * (i - y) for k, y, v in rows if k == x) for x in {r[0] for r in rows} for i in range(2, 211)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_scores_within_one_unit_have_thresholds_of_their_own(spark):
    scored = spark.createDataFrame([(1.5, True), (1.25, False), (1.0, True)], "score double, hit boolean")
    assert sorted(tuple(r) for r in evaluate.sweep(scored, 2).collect()) == [(1.0, 2, 1, 2), (1.25, 1, 1, 2), (1.5, 1, 0, 2)]


def test_covariance_of_all_channels_with_gaps(spark):
    rows = [([1.0, 2.0, 4.0],), ([2.0, None, 1.0],), ([4.0, 1.0],), (None,), ([3.0, 5.0, 2.0],)]
    got = {(r.i, r.j): r.cov for r in stats.channel_cov(spark.createDataFrame(rows, "v array<float>"), "v").collect()}
    whole = [v + [None] * (3 - len(v)) for (v,) in rows if v]
    for i in range(3):
        for j in range(i, 3):
            p = np.array([(v[i], v[j]) for v in whole if v[i] is not None and v[j] is not None])
            assert got.pop((i, j)) == pytest.approx(np.mean(p[:, 0] * p[:, 1]) - p[:, 0].mean() * p[:, 1].mean())
    assert not got


@pytest.mark.parametrize("size", [None, (70, 5), (3, 140)])
def test_autocorrelation_across_tiles(spark, size):
    """More offsets than the grid has rows or columns, and several tiles."""
    rng = np.random.default_rng(2)
    high, wide = size or (70, 70)
    cells = {(y, x): float(rng.integers(-5, 6)) for y in range(high) for x in range(wide) if rng.random() < 0.3}
    got = {(r.dx, r.dy): (r.cov, r.n) for r in stats.autocorrelation(spark.createDataFrame([(*k, v) for k, v in cells.items()], "y long, x long, v double"), 7, 0.0, size).collect()}
    for dx in range(8):
        for dy in range(-7, 8):
            if dx or dy >= 0:
                p = [v * cells[k] for (y, x), v in cells.items() if (k := ((y + dy) % high, (x + dx) % wide) if size else (y + dy, x + dx)) in cells]
                assert got.pop((dx, dy), (None, 0)) == ((pytest.approx(sum(p) / (high * wide if size else len(p))), len(p)) if p else (None, 0))
    assert not got
