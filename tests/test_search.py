"""The boosted trees and the searches against plain versions."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barwright.operators import boosting as B
from barwright.operators import linear_search as L
from barwright.operators import metrics
from barwright.operators import train as T

WIDTH = 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, WIDTH)).round(2)
    x[:, 3] = rng.integers(0, 3, 240)
    x[:, 4] = 7.0
    y = (x[:, 0] * x[:, 1] + 0.5 * (x[:, 3] == 2) + rng.normal(0, 0.4, 240) > 0.2).astype(float)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(i + 1, float(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "place long, y double, x array<double>").repartition(3)


def plain_booster(x, y, place, edges, s):
    """Every row, column and cut tried one by one."""
    margin, trees = [B.prior(sum(y), len(y))] * len(y), []

    def value(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for t in range(s.n_estimators):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        columns = B.columns_of(t, len(edges), s.colsample_bytree, s.seed)

        def grow(members, depth):
            whole_g, whole_h = sum(g[i] for i in members), sum(h[i] for i in members)
            score = lambda a, b: a * a / (b + s.reg_lambda)
            best = None
            for c in columns if depth < s.max_depth else ():
                for e in edges[c]:
                    left = [i for i in members if x[i][c] <= e]
                    lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                    if min(lh, whole_h - lh) >= s.min_child_weight:
                        gain = round(score(lg, lh) + score(whole_g - lg, whole_h - lh) - score(whole_g, whole_h), 9)
                        if best is None or gain > best[0]:
                            best = gain, int(c), float(e)
            if best is None or best[0] <= 1e-6:
                return -s.learning_rate * whole_g / (whole_h + s.reg_lambda)
            _, c, e = best
            return c, e, grow([i for i in members if x[i][c] <= e], depth + 1), grow([i for i in members if x[i][c] > e], depth + 1)

        trees.append(grow([i for i in range(len(y)) if s.subsample >= 1 or B.drawn(int(place[i]), t, s.subsample, s.seed)], 0))
        margin = [m + value(trees[-1], row) for m, row in zip(margin, x, strict=True)]
    return trees, margin


def same_tree(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == pytest.approx(b[:2]) and same_tree(a[2], b[2]) and same_tree(a[3], b[3])
    return a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("s", [B.Settings(6, 3, 0.3), B.Settings(6, 2, 0.2, 0.7, 0.6), B.Settings(3, 1, 1.0, 1.0, 0.2), B.Settings(2, 3, 0.5, min_child_weight=1e9)])
def test_local_and_distributed_trees_equal_a_plain_booster(data, rows, s):
    x, y = data
    edges = B.bin_edges(rows, WIDTH)
    want, margin = plain_booster(x.tolist(), y.tolist(), np.arange(1, 241), edges, s)
    for local_cells in (10**6, 0):
        got = B.fit_trees(rows, 240, WIDTH, s, local_cells)
        assert all(same_tree(a, b) for a, (_, b) in zip(want, got.nested(), strict=True))
        assert np.allclose(got.margin(x), margin)
        assert np.allclose(B.Trees.from_json(got.to_json()).margin(x), margin)


def test_draws_take_their_share():
    place = np.arange(1, 200_001)
    for rate in (0.1, 0.7, 0.8):
        shares = [B.drawn(place, t, rate, 42).mean() for t in range(5)]
        assert all(abs(a - rate) < 0.01 for a in shares)
    both = (B.drawn(place, 1, 0.5, 42) & B.drawn(place, 2, 0.5, 42)).mean()
    assert abs(both - 0.25) < 0.01


def test_boosted_search_equals_one_fit_after_the_other(data, rows):
    x, y = data
    folds = [(80, 80), (160, 80)]
    points = T.grid({"n_estimators": (3, 6), "max_depth": (1, 2), "learning_rate": (0.3,), "subsample": (0.8,), "colsample_bytree": (1.0,)})
    edges = [B.bin_edges(rows.where(F.col("place") <= cut), WIDTH) for cut, _ in folds]
    want = [[None] * len(points) for _ in folds]
    for k, (cut, size) in enumerate(folds):
        for i, p in enumerate(points):
            trees, _ = B.grow(B.binned(x[:cut], edges[k]), y[:cut], np.arange(1, cut + 1), edges[k], B.Settings(**p))
            score, label = trees.margin(x[cut : cut + size]), y[cut : cut + size]
            pairs = [(a > b) + (a == b) / 2 for a, i1 in zip(score, label, strict=True) if i1 for b, i0 in zip(score, label, strict=True) if not i0]
            want[k][i] = sum(pairs) / len(pairs)
    assert np.allclose(B.search(rows, WIDTH, folds, points), want)
    assert np.allclose(B.search(rows, WIDTH, folds[:1], points[:2], local_cells=0), [want[0][:2]])


def test_stage_of_a_pipeline_is_stored_and_read(spark, data, tmp_path):
    x, y = data
    frame = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "position long, label double, a double, b double, c double, d double, e double")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list("abcde"), outputCol="features"), B.BoostedTrees.of(n_estimators=30, learning_rate=0.3)])
    pipeline.write().overwrite().save(f"{tmp_path}/untrained")
    model = Pipeline.load(f"{tmp_path}/untrained").fit(frame)
    model.write().overwrite().save(f"{tmp_path}/model")
    a, b = (m.transform(frame).orderBy("position").select("rawPrediction", "probability", "prediction").collect() for m in (model, PipelineModel.load(f"{tmp_path}/model")))
    assert a == b
    assert all(r.prediction == float(r.probability[1] > 0.5) and r.rawPrediction[1] == -r.rawPrediction[0] for r in a)
    assert sum(r.prediction == v for r, v in zip(a, y, strict=True)) > 190
    with pytest.raises(ValueError, match="unknown settings"):
        B.BoostedTrees.of(depth=3)
    with pytest.raises(ValueError, match="no rows"):
        pipeline.fit(frame.limit(0))


def test_all_linear_models_equal_sparks_own(spark, data, rows, monkeypatch):
    x, _ = data
    monkeypatch.setattr(L, "FAN_IN", 2)
    x = x[:, :4]
    windows = [L.Window(cut, 60, x[:cut].mean(0), 1 / x[:cut].std(0, ddof=1)) for cut in (120, 180)]
    penalties = [(c, share) for c in (0.01, 0.3, 10.0) for share in (0.0, 0.5, 1.0)]
    narrow = rows.withColumn("x", F.slice("x", 1, 4)).repartition(7)
    got = L.fit_all(narrow, windows, penalties)
    areas = L.search(narrow, windows, penalties)
    for k, w in enumerate(windows):
        scaled = narrow.select("place", "y", *[((F.col("x")[i] - float(w.shift[i])) * float(w.factor[i])).alias(f"x{i}") for i in range(4)])
        ready = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(scaled).coalesce(1).cache()
        for m, (c, share) in enumerate(penalties):
            fitted = LogisticRegression(labelCol="y", maxIter=1000, tol=1e-12, regParam=1 / (c * w.cut), elasticNetParam=share, standardization=False).fit(ready.where(F.col("place") <= w.cut))
            assert np.allclose(got[k, m], [*fitted.coefficients, fitted.intercept], atol=2e-4)
        y = {r.place: r.y for r in narrow.select("place", "y").collect()}
        z = {r.place: (np.array(r.x) - w.shift) * w.factor for r in narrow.select("place", "x").collect()}
        inside = [p for p in y if w.cut < p <= w.cut + w.size]
        for m in range(len(penalties)):
            assert areas[k][m] == pytest.approx(B.area(np.array([y[p] for p in inside]), np.array([z[p] @ got[k, m, :-1] for p in inside])))


def test_least_of_a_penalised_quadratic():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m = rng.normal(size=(8, 8))
        a = m @ m.T * 10.0 ** rng.integers(-3, 2) + np.eye(8) * 1e-3
        c, l1 = rng.normal(size=8), np.append(np.full(7, 10.0 ** rng.integers(-3, 1)), 0.0)
        u = L.least(c, a, l1, rng.normal(size=8) * (rng.random(8) < 0.5))
        slope = a @ u + c
        assert np.allclose(slope[u != 0], -(l1 * np.sign(u))[u != 0], atol=1e-7)
        assert (np.abs(slope[u == 0]) <= l1[u == 0] + 1e-7).all()


def test_areas_of_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(rng.integers(0, 2)), float(rng.integers(0, 6))) for g in rng.integers(0, 4, 200)] + [(9, 1.0, 0.5), (9, 1.0, 0.7)]
    got = {r.model: r.area for r in metrics.areas(spark.createDataFrame(rows, "model int, y double, p double"), "model").collect()}
    for g in range(4):
        y, p = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        assert got[g] == pytest.approx(B.area(y, p))
    assert got[9] is None and B.area(np.ones(3), np.arange(3.0)) is None


def test_scaling_is_that_of_the_pipeline(spark, data):
    x, y = data
    names = ["a", "relative_volume_5", "c", "d", "e"]
    frame = spark.createDataFrame([(i + 1, "AB"[i % 2], "Monday", float(b), *map(float, v)) for i, (v, b) in enumerate(zip(x, y, strict=True))], "position long, Ticker string, day_of_week string, label double, " + ", ".join(f"{n} double" for n in names))
    pipeline = T.lr_pipeline([*names, "Ticker", "day_of_week"], rows=240)
    from barwright.scratch import Scratch

    rows, width = T.encoded_rows(pipeline, frame, Scratch(spark, "test"))
    shift, factor = T.scaling(pipeline, frame, width)
    plain = {r.place: (np.array(r.x) - shift) * factor for r in rows.collect()}
    model = Pipeline(stages=pipeline.getStages()[:-1]).fit(frame)
    for r in model.transform(frame).select("position", "features").collect():
        assert np.allclose(r.features.toArray(), plain[r.position])
