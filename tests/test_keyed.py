"""Learning of many classes against one class at a time; leave-one-out against relearning; Toeplitz systems and cyclic statistics against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine, evaluate, harmony, held_out, hog, keyed, sampling, toeplitz
from tessera.operators.learn import discriminant, factor
from tessera.sources.models import Background, Component, Model, Part, reconstruct


def offsets(m):
    return [(dx, dy) for dx in range(m + 1) for dy in range(-m, m + 1) if dx or dy >= 0]


def background(n=2, m=6, seed=0):
    """Of a moving average of noise, so that every covariance is positive definite."""
    rng = np.random.default_rng(seed)
    taps = rng.normal(size=(3, 3, n, n)) * 0.5

    def cov(dx, dy):
        pairs = [(y, x) for y in range(3) for x in range(3) if 0 <= y - dy < 3 and 0 <= x - dx < 3]
        return sum((taps[y, x] @ taps[y - dy, x - dx].T for y, x in pairs), np.zeros((n, n))) + (0.3 * np.eye(n) if not dx and not dy else 0)

    return Background((8, 8), rng.normal(size=n), np.array([cov(*o) for o in offsets(m)]), np.array(offsets(m)))


@pytest.mark.parametrize(("rows", "cols", "n"), [(1, 1, 1), (3, 5, 2), (6, 4, 3), (7, 7, 1)])
def test_toeplitz_equals_cholesky(rows, cols, n):
    b = background(n)
    full = reconstruct(b, rows, cols)
    v = np.random.default_rng(1).normal(size=(3, len(full)))
    assert np.allclose(toeplitz.Toeplitz(b, rows, cols).product(v), v @ full, atol=1e-12)
    lower = factor(full)
    wanted = np.linalg.solve(lower.T, np.linalg.solve(lower, v.T)).T
    assert np.abs(toeplitz.Solver(b, rows, cols)(v) - wanted).max() < 1e-8
    assert (toeplitz.Solver(b, rows, cols)(np.zeros((1, len(full)))) == 0).all()


def test_toeplitz_that_is_not_positive_definite_and_too_large():
    b = background()
    b.cov[0] -= 2 * np.eye(2)
    solve, v = toeplitz.Solver(b, 4, 4), np.random.default_rng(1).normal(size=(2, 32))
    x = solve(v)
    assert solve.matrix.ridge > 0 and np.allclose(solve.matrix.product(x), v, atol=1e-8)
    with pytest.raises(ValueError):
        toeplitz.Toeplitz(b, 8, 3)


def test_what_a_large_template_keeps_is_far_below_its_square():
    b = background(8, 19)
    matrix = toeplitz.Toeplitz(b, 20, 20)
    v = np.random.default_rng(2).normal(size=(1, 3200))
    assert matrix.spectrum.nbytes < 10 << 20 < 3200 * 3200 * 8
    assert np.allclose(matrix.product(matrix.solve(v)), v, atol=1e-8)


def test_whitened_images_of_several_sizes(spark):
    b, rng = background(), np.random.default_rng(5)
    data = {(i, r, c): rng.normal(size=r * c * 2) for i, (r, c) in enumerate([(3, 4), (5, 2), (3, 4), (1, 6)])}
    df = spark.createDataFrame([(*k, 2, x.tolist()) for k, x in data.items()] + [(9, 0, 0, 2, [])], "id int, rows int, cols int, channels int, data array<double>")
    got = {r.id: np.array(r.white) for r in engine.whitened(df, "id", b).collect()}
    assert set(got) == {0, 1, 2, 3}
    for (i, r, c), x in data.items():
        wanted = np.linalg.solve(reconstruct(b, r, c) + 0.01 * np.eye(2 * r * c), x - np.tile(b.mean, r * c))
        assert np.allclose(got[i], wanted / np.abs(wanted).max(), atol=1e-8)


def test_cyclic_statistics_equal_rolled_levels(spark):
    rng = np.random.default_rng(6)
    levels = [rng.normal(size=s) for s in ((4, 6, 2), (5, 3, 2), (4, 6, 2), (1, 1, 2))]
    df = spark.createDataFrame([(*x.shape, x.ravel().tolist()) for x in levels] + [(0, 3, 2, [])], "rows int, cols int, channels int, data array<double>").repartition(3)
    b = engine.learn_background_cyclic(df, most=3)
    mean = np.concatenate([x.reshape(-1, 2) for x in levels]).mean(0)
    assert np.allclose(b.mean, mean)
    for (dx, dy), c in zip(b.offsets.tolist(), b.cov, strict=True):
        total, n = np.zeros((2, 2)), 0
        for x in levels:
            r, k, _ = x.shape
            if 0 <= r // 2 + dy < r and k // 2 + dx < k:
                y = np.roll(x, (-dy, -dx), (0, 1)) - mean
                total += (x - mean).reshape(-1, 2).T @ y.reshape(-1, 2)
                n += r * k
        assert np.allclose(c, total / n if n else 0)
    assert len(engine.learn_background_cyclic(df.limit(0), most=1).mean) == 0


def points(classes, seed=3):
    """Two clouds and a straggler in each class, of different sizes."""
    rng, rows = np.random.default_rng(seed), []
    for c in range(classes):
        for i in range(20 + 3 * c):
            center = (6.0 if i % 3 else -6.0) * (1 + c)
            rows.append((f"c{c}", 1000 * c + i, (center + rng.normal(size=4) * 0.1).tolist()))
        rows.append((f"c{c}", 1000 * c + 999, [500.0, -500.0, 0.0, float(c)]))
    return rows


SCHEMA = "cls string, id long, data array<double>"


def test_classes_learned_together_equal_those_learned_alone(spark):
    b = background(2)
    cov, mean = reconstruct(b, 1, 2), np.tile(b.mean, 2)
    rows = points(4)
    df = spark.createDataFrame([*rows, (None, 1, [0.0] * 4), ("c0", 2, None)], SCHEMA).repartition(5)
    found = keyed.learn_classes(df, "cls", "id", "data", mean, toeplitz.Solver(b, 1, 2), 3).collect()
    for c in range(4):
        own = [np.array(x) for cls, i, x in rows if cls == f"c{c}" and i % 1000 != 999]
        groups = sorted(([x for x in own if x[0] > 0], [x for x in own if x[0] < 0]), key=len)
        got = sorted((r for r in found if r.cls == f"c{c}"), key=lambda r: r.n)
        assert [r.n for r in got] == [len(g) for g in groups] and sorted(r.cluster for r in got) == [0, 1]
        for r, g in zip(got, groups, strict=True):
            w, threshold, f = discriminant(np.mean(g, 0), mean, cov)
            assert np.allclose(r.weights, w) and r.threshold == pytest.approx(threshold) and r.f == pytest.approx(f)


def test_number_of_jobs_is_that_of_one_class(spark):
    def jobs(classes):
        df = spark.createDataFrame([r for r in points(classes)], SCHEMA)
        spark.sparkContext.setJobGroup(f"n{classes}", "")
        keyed.kmeans(df, "cls", "id", "data", 2, 2, None).collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"n{classes}"))

    assert jobs(1) == jobs(9)


def test_clusters_of_few_different_samples_ties_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0]), ("b", 3, [0.0]), ("b", 4, [4.0]), ("b", 5, [2.0])], SCHEMA)
    got = sorted((r.cls, r.cluster, r.center[0]) for r in keyed.kmeans(df, "cls", "id", "data", 2, 1, None).collect())
    assert got == [("a", 0, 1.0), ("b", 0, 1.0), ("b", 1, 4.0)]  # 2.0 is as near to both, and goes to the first
    assert keyed.kmeans(df.limit(0), "cls", "id", "data", 2).count() == 0


def test_centers_of_classes_are_merged_apart(spark):
    rows = [("a", 0, [0.0], 3), ("a", 1, [0.1], 1), ("a", 2, [5.0], 1), ("b", 0, [0.0], 1), ("b", 1, [5.0], 1)]
    df = spark.createDataFrame(rows, "cls string, cluster int, center array<double>, n long")
    assert sorted(map(tuple, keyed.merged(df, "cls", 0.2).collect())) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0), ("b", 1, 1)]


def test_left_out_templates_equal_relearning(spark):
    b, rng = background(2), np.random.default_rng(7)
    cov, mean = reconstruct(b, 1, 2), np.tile(b.mean, 2)
    solve = toeplitz.Solver(b, 1, 2)
    raw = {i: rng.normal(size=4) + 2 for i in range(7)}  # samples 0 and 1 are of one image
    w, threshold, f = discriminant(np.mean(list(raw.values()), 0), mean, cov)
    models = spark.createDataFrame([("k", 0, 7, w.tolist(), f), ("one", 0, 1, w.tolist(), f)], "class string, component int, n long, weights array<double>, f double")
    white = {i: solve(x - mean)[0] for i, x in raw.items()}
    samples = spark.createDataFrame([(max(i, 1), "k", 0, white[i].tolist()) for i in raw] + [(1, "one", 0, white[0].tolist())], "image int, class string, component int, white array<double>")
    got = {(r.image, r["class"]): np.array(r.weights) for r in held_out.changed_models(models, samples, "image").collect()}
    assert set(got) == {(i, "k") for i in range(1, 7)}  # a template of one sample has nothing to be learned from
    for i in range(1, 7):
        again, _, f2 = discriminant(np.mean([x for k, x in raw.items() if max(k, 1) != i], 0), mean, cov)
        assert np.allclose(got[i, "k"] * f, again * f2)
    # The detector takes them for their image only.
    levels = spark.createDataFrame([(i, 0, 1.0, 4, 5, 2, rng.normal(size=40).tolist()) for i in (1, 2, 50)], "image int, level int, scale double, rows int, cols int, channels int, data array<double>")
    model = {"k": Model([Component([Part(w.reshape(1, 2, 2).astype(np.float32))], 0.0)])}
    changes = held_out.changed_models(models, samples, "image")
    found = engine.candidates(levels, "image", model, {"k": -100.0}, changes=changes).collect()
    for r in levels.collect():
        weights = got.get((r.image, "k"), w).reshape(1, 2, 2).astype(np.float32)
        scores = engine.correlation(np.array(r.data).reshape(4, 5, 2), weights)
        own = [x for x in found if x.image == r.image]
        assert own and all(x.score == pytest.approx(scores[x.y, x.x]) for x in own)


def test_thresholds_by_leave_one_out_equal_loops(spark):
    b, rng = background(2), np.random.default_rng(8)
    mean, solve = np.tile(b.mean, 2), toeplitz.Solver(b, 1, 2)
    raw = [(f"c{i % 3}", i, rng.normal(size=4) + np.eye(4)[i % 3] * 2) for i in range(30)] + [("single", 99, np.ones(4))]
    df = spark.createDataFrame([(c, i, x.tolist()) for c, i, x in raw], SCHEMA)
    models = keyed.learn_classes(df, "cls", "id", "data", mean, solve, 1, 0, None)
    got = {r.cls: (r.threshold, r.f_measure) for r in held_out.best_thresholds(df, models, "id", "cls", "data", solve, mean, granularity=50).collect()}
    learned = {r.cls: r for r in models.collect()}
    for c in {c for c, _, _ in raw}:
        f, scored = learned[c].f, []
        for own, i, x in raw:
            rest = [y for k, j, y in raw if k == c and j != i] or [x]
            w, _, f2 = discriminant(np.mean(rest, 0), mean, reconstruct(b, 1, 2))
            score = float(x @ w) * f2 / f
            if score >= 0:
                scored.append((np.floor(score * 50) / 50, own == c))
        total = sum(k == c for k, _, _ in raw)
        values = {t: 2 * sum(h for s, h in scored if s >= t) / (sum(s >= t for s, _ in scored) + total) for t, _ in scored}
        if not values:
            assert c not in got
            continue
        assert got[c][1] == pytest.approx(max(values.values())) and values[got[c][0]] == pytest.approx(max(values.values()))


def test_sweeps_of_all_models_at_once(spark):
    rng = np.random.default_rng(9)
    rows = [("abc"[i % 3], float(rng.integers(0, 20)) / 7, bool(rng.integers(0, 2))) for i in range(90)]
    df = spark.createDataFrame(rows, "m string, score double, hit boolean")
    totals = spark.createDataFrame([("a", 40), ("b", 31)], "m string, np long")
    got = {(r.m, r.threshold): (r.tp, r.fp, r.np) for r in evaluate.sweep(df, totals, 10, ("m",)).collect()}
    for m, n in (("a", 40), ("b", 31), ("c", 0)):
        one = evaluate.sweep(df.where(F.col("m") == m), n, 10).collect()
        assert {k[1]: v for k, v in got.items() if k[0] == m} == {r.threshold: (r.tp, r.fp, r.np) for r in one}
    best = {r.m: r.f_measure for r in evaluate.max_f_measure(evaluate.sweep(df, totals, 10, ("m",)), by=("m",)).collect()}
    assert best["a"] == evaluate.max_f_measure(evaluate.sweep(df.where("m = 'a'"), 40, 10)).first().f_measure


def test_layers_of_several_resolutions(spark):
    """Each layer is enlarged, shifted by half of what it falls short of, and its edges are filled."""
    rng, rows = np.random.default_rng(4), []
    shapes = {"a": [(5, 7, 2, 1, 1), (2, 3, 1, 2, 2), (1, 1, 3, 4, 4)], "b": [(4, 4, 1, 1, 1), (3, 2, 2, 2, 2)], "c": [(2, 2, 1, 1, 1), (0, 2, 1, 2, 2)]}
    made = {k: [rng.normal(size=s[:3]) for s in v] for k, v in shapes.items()}
    for k, v in shapes.items():
        rows += [(k, i, *s, made[k][i].ravel().tolist()) for i, s in enumerate(v)]
    df = spark.createDataFrame([*rows, ("d", 1, 1, 1, 1, 2, 2, [1.0])], "id string, layer int, rows int, cols int, channels int, cell_w int, cell_h int, data array<double>").repartition(4)
    got = {r.id: np.array(r.data).reshape(r.rows, r.cols, r.channels) for r in hog.joined_layers(df, "id").collect()}
    assert set(got) == {"a", "b"}
    for k, out in got.items():
        first, at = made[k][0], 0
        for x, (h, w, n, cw, ch) in zip(made[k], shapes[k], strict=True):
            big = np.repeat(np.repeat(x, ch, 0), cw, 1)
            short = [max(0, first.shape[i] - big.shape[i]) for i in (0, 1)]
            big = np.pad(big, [(s // 2, s - s // 2) for s in short] + [(0, 0)], mode="edge")[: first.shape[0], : first.shape[1]]
            assert np.array_equal(out[..., at : at + n], big)
            at += n


def test_runs_until_all_groups_are_exhausted(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(i)) for i, g in enumerate(rng.choice([1, 1, 1, 1, 2, 3, 9], 200))] + [(None, 500), (None, 501)]
    df = spark.createDataFrame(rows, "g int, id long").repartition(7)
    for n in (1, 3):
        got = [(r.g, r.id) for r in sampling.round_robin(df, "g", "id", n).orderBy("position").collect()]
        groups = {g: sorted(i for h, i in rows if h == g) for g in (None, 1, 2, 3, 9)}
        wanted = [(g, i) for k in range(0, 200, n) for g, ids in groups.items() for i in ids[k : k + n]]
        assert got == wanted
    assert sampling.round_robin(df.limit(0), "g", "id", 2).count() == 0
    assert [r.position for r in sampling.negatives(df, "g", 1, "id").orderBy("position").collect()] == list(range(sum(g not in (1, None) for g, _ in rows)))


def test_joint_thresholds_on_a_fine_grid(spark):
    rng, bins = np.random.default_rng(6), 1000
    objects = spark.range(300).withColumnRenamed("id", "o")
    hits = [(int(o), int(m), int(b)) for o, m, b in zip(rng.integers(0, 400, 900), rng.integers(0, 2, 900), rng.integers(0, bins, 900), strict=True)]
    got = harmony.joint_f_grid(objects, spark.createDataFrame(hits, "o long, model int, bin int"), ["o"], bins).toPandas()
    assert len(got) == bins * bins
    best = np.full((300, 2), -1)
    false = np.zeros((2, bins), int)
    for o, m, b in hits:
        if o < 300:
            best[o, m] = max(best[o, m], b)
        else:
            false[m, b] += 1
    above = false[:, ::-1].cumsum(1)[:, ::-1]
    for r in got.sample(300, random_state=1).itertuples():
        tp = int(((best[:, 0] >= r.bin_a) | (best[:, 1] >= r.bin_b)).sum())
        assert (r.tp, r.fp) == (tp, above[0, r.bin_a] + above[1, r.bin_b])


def test_other_strategies_and_nothing_left_out(spark):
    b, rng = background(2), np.random.default_rng(10)
    mean, solve = np.tile(b.mean, 2), toeplitz.Solver(b, 1, 2)
    raw = [("a", i, rng.normal(size=4) + 1) for i in range(6)] + [("b", 10 + i, rng.normal(size=4) - 1) for i in range(4)]
    df = spark.createDataFrame([(c, i, x.tolist()) for c, i, x in raw], SCHEMA)
    models = keyed.learn_classes(df, "cls", "id", "data", mean, solve, 1, 0, None, keyed.by_mean)
    for r in models.collect():
        m = np.mean([x for c, _, x in raw if c == r.cls], 0)
        w = m - mean
        assert np.allclose(np.array(r.weights) * r.f, w) and r.threshold * r.f == pytest.approx((m @ m - mean @ mean) / 2)
        assert (m @ r.weights > r.threshold) and (mean @ r.weights < r.threshold)
    white = keyed.mapped(df, "data", "white", lambda x: solve(x - mean))
    weights = {r.cls: np.array(r.weights) for r in models.collect()}
    plain = {r.id: r.score for r in held_out.own_scores(white, models, "id", "cls", "data", "white", held_out.none_left_out).collect()}
    assert all(plain[i] == pytest.approx(x @ weights[c]) for c, i, x in raw)
