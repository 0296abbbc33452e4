"""Training, scoring, attribution and streams on small frames."""

import datetime as dt
import time
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from barwright.operators import inference as I
from barwright.operators import train as T
from barwright.operators import tree_attribution as A
from barwright.schema import BAR, MODEL_VERSION
from barwright.sources.store import Store
from barwright.streaming import bars as S


@pytest.fixture(scope="module")
def frame(spark):
    rng, rows = np.random.default_rng(5), []
    day, i = dt.date(2024, 1, 1), 0
    while i < 150:
        if day.weekday() < 5:
            for t in ("A", "B"):
                a, b = rng.normal(0, 1), rng.gamma(2, 1)
                rows.append((day, t, T.WEEKDAYS[day.weekday()], f"{day:%m}", float(a), float(b), float(a + 0.3 * b + rng.normal(0, 0.4) > 0.6)))
            i += 1
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "Date date, Ticker string, day_of_week string, month string, a double, relative_volume_5 double, market_movement double")


def test_expanding_folds(spark):
    placed = spark.range(1, 26).withColumnRenamed("id", "position")
    got = [(n, a.count(), sorted(r.position for r in b.collect())) for n, a, b in T.expanding_folds(placed, 25, 5)]
    assert got == [(5 + 4 * k, 5 + 4 * k, list(range(6 + 4 * k, 10 + 4 * k))) for k in range(5)]
    with pytest.raises(ValueError):
        list(T.expanding_folds(placed, 3, 5))


def test_train_serve_and_log(spark, frame, tmp_path):
    early, late = frame.where("Date < '2024-06-15'"), frame.where("Date >= '2024-06-15'")
    got = T.train_model(early, late, "lr", values={"C": (0.1, 10.0), "l1_ratio": (0.0,)}, folds=2)
    assert got.metrics["roc_auc"] > 0.85 and got.cv_roc_auc > 0.8 and got.params["C"] in (0.1, 10.0)
    got.model.write().overwrite().save(f"{tmp_path}/model")
    store = Store(spark, f"{tmp_path}/store")
    store.write("runs", got.run(spark, "x", {"model": "lr"}))
    store.write("model_versions", spark.createDataFrame([("m", 1, got.run_id, f"{tmp_path}/model", "champion")], MODEL_VERSION))
    p = I.VolatilityPredictor.champion(store, "lr")
    assert p.stats["roc_auc"] == pytest.approx(got.metrics["roc_auc"])
    bars = frame.select("Date", "Ticker", *[(F.col("a") + 9).alias(c) for c in ("Open", "High", "Low", "Close")], F.lit(1).cast("long").alias("Volume"))
    features = frame.drop("market_movement").withColumns({"spy_lag_return_1": F.col("a"), "vix_level": F.lit(19.0)})
    rows = {r.Ticker: r for r in p.payload(bars, features, 2, 50).collect()}
    assert set(rows) == {"A", "B"} and all(0 <= r.probability <= 1 and r.market.regime == "Elevated" and len(r.ohlcv) == 150 == len(r.bollinger.upper) for r in rows.values())
    assert {x.feature for x in rows["A"].attribution} == {"a", "relative_volume_5"}
    assert p.log(store, p.predict(features)) and store.prediction_logs().count() == 2
    assert not p.log(Store(spark, "/proc/nowhere"), p.predict(features))
    with pytest.raises(LookupError):
        I.VolatilityPredictor.champion(store, "lr", "nobody")
    with pytest.raises(LookupError):
        I.check_ticker("zz", ["A"])
    # the weights by column give the model's own margin, up to a constant
    w = I.coefficients(PipelineModel.load(f"{tmp_path}/model"))
    assert set(w) == {"a", "relative_volume_5", "day_of_week_number", "month_number"} and w["a"] > 0
    ready = PipelineModel.load(f"{tmp_path}/model").transform(frame.where("Ticker = 'A'")).limit(40).collect()
    rest = [r.rawPrediction[1] - sum(x * float(r[c]) for c, x in w.items()) for r in ready]
    assert np.allclose(rest, rest[0])


def test_boosted_trees(frame):
    early, late = frame.where("Date < '2024-06-15'"), frame.where("Date >= '2024-06-15'")
    got = T.train_model(early, late, "xgb", values={"n_estimators": (10,), "max_depth": (2,), "learning_rate": (0.2,)}, folds=2)
    assert got.metrics["roc_auc"] > 0.8
    # contributions sum up to the margin at the last row over the mean margin of the background
    trees = [(got.model.stages[-1].read_trees().start, 1.0), *A.read_trees(got.model.stages[-1])]
    out = A.tree_attribution(frame.drop("market_movement"), got.model, 99, 30).toPandas()
    last = got.model.transform(frame).orderBy("Date").select("Ticker", "features", "rawPrediction").collect()[-60:]
    for ticker in ("A", "B"):
        rows = [r for r in last if r.Ticker == ticker]
        margins = [sum(w * A.tree_value(t, r.features.toArray()) for w, t in trees) for r in rows]
        assert np.allclose(margins, [r.rawPrediction[1] for r in rows])
        assert out[out.Ticker == ticker].contribution.sum() == pytest.approx(margins[-1] - np.mean(margins))
    assert {"a", "relative_volume_5", "day_of_week", "Ticker=A"} <= set(out.feature)
    payload = I.VolatilityPredictor(got.model, "xgb", "m", 1).payload(
        frame.select("Date", "Ticker", *[F.lit(1.0).alias(c) for c in ("Open", "High", "Low", "Close")], F.lit(1).cast("long").alias("Volume")),
        frame.drop("market_movement").withColumns({"spy_lag_return_1": F.lit(0.0), "vix_level": F.lit(30.0)}), 3, 10)
    assert all(len(r.attribution) == 3 and r.market.regime == "Risk Off" for r in payload.collect())
    with pytest.raises(ValueError):
        T.train_model(early, late, "none")


def test_serving_frames(spark):
    def walk(tickers, n=300):
        rng, rows = np.random.default_rng(1), []
        for t in tickers:
            c = 100 + rng.normal(0, 1, n).cumsum() * 0.5
            rows += [(dt.date(2023, 1, 2) + dt.timedelta(i), t, float(x), float(x + 1), float(x - 1), float(x + 0.3), int(1000 + i)) for i, x in enumerate(c)]
        return spark.createDataFrame(rows, BAR)

    stock, spy, vix = walk(["A", "B"]), walk(["SPY"]), walk(["^VIX"])
    lr = I.engineer_data(stock, spy, vix, "lr")
    assert "market_movement" not in lr.columns and lr.where("is_outlier = 1").count() > 0 and lr.count() == 600
    assert "is_outlier" not in I.engineer_data(stock, spy, vix, "xgb").columns
    assert lr.dropna("any").count() == 2 * (300 - 252)
    with pytest.raises(ValueError):
        I.engineer_data(stock, spy, vix, "none")


def test_shapley_equals_all_coalitions():
    rng = np.random.default_rng(9)

    def grow(depth):
        return (int(rng.integers(4)), float(rng.normal()), grow(depth - 1), grow(depth - 1)) if depth and rng.random() < 0.9 else float(rng.normal())

    for _ in range(30):
        trees, x, rows = [(1.0, grow(4)), (0.5, grow(3)), (2.0, 1.5)], rng.normal(size=4), rng.normal(size=(3, 4))
        rows[0, 0] = x[0]
        want = np.zeros(4)
        for (w, root), z in product(trees, rows):
            for order in permutations(range(4)):
                at = z.copy()
                for f in order:
                    before = A.tree_value(root, at)
                    at[f] = x[f]
                    want[f] += w * (A.tree_value(root, at) - before) / 24 / len(rows)
        assert np.allclose(A.shapley(A.Leaves.of(trees), x, rows), want)


def test_shapley_of_many_trees_is_quick():
    rng = np.random.default_rng(10)
    grow = lambda depth: (int(rng.integers(100)), float(rng.normal()), grow(depth - 1), grow(depth - 1)) if depth else float(rng.normal())
    trees, rows = [(0.1, grow(4)) for _ in range(500)], rng.normal(size=(150, 100))
    began = time.perf_counter()
    got = A.shapley(A.Leaves.of(trees), rows[0], rows)
    assert time.perf_counter() - began < 20
    value = lambda x: sum(w * A.tree_value(t, x) for w, t in trees)
    assert got.sum() == pytest.approx(value(rows[0]) - np.mean([value(z) for z in rows]))


def test_levels(spark):
    df = spark.createDataFrame([(0.95,), (0.75,), (0.7,), (0.6,), (0.4,)], "p double")
    assert [r[0] for r in df.select(I.confidence(F.col("p"))).collect()] == ["High", "High", "Medium", "Medium", "Low"]
    df = spark.createDataFrame([(30.0,), (25.0,), (18.0,), (17.9,), (None,)], "v double")
    assert [r[0] for r in df.select(I.market_regime(F.col("v"))).collect()] == ["Risk Off", "Risk Off", "Elevated", "Risk On", "Risk On"]


def test_probabilities_are_checked(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "p double")
    assert df.select(I.checked_probability(F.col("p"))).count() == 2
    with pytest.raises(Exception, match="not a probability: 1.5"):
        spark.createDataFrame([(1.5,)], "p double").select(I.checked_probability(F.col("p"))).collect()


def test_attribution(spark):
    rows = [("A", dt.date(2024, 1, d), float(d), float(-2 * d) if d != 3 else None) for d in range(1, 11)]
    got = I.linear_attribution(spark.createDataFrame(rows, "Ticker string, Date date, x double, y double"), {"x": 1.0, "y": 2.0}, 5, 4)
    assert [(r.rank, r.feature, r.contribution) for r in got.collect()] == [(1, "y", 2 * (-20 + 17)), (2, "x", 1.5)]
    why = I.reasons(got).first()
    assert why.dominant == "y" and why.reasons == ["y", "x"] and why.share == pytest.approx(6 / 7.5)


def test_streams(spark, tmp_path):
    src, out = f"{tmp_path}/events", f"{tmp_path}/bars"
    make = lambda rows: spark.createDataFrame([(i, dt.datetime(2024, 1, d, h), 1, "x", float(v), None) for i, d, h, v in rows], S.EVENT_SCHEMA)
    make([(1, 1, 9, 5), (2, 1, 12, 7), (3, 1, 18, 6), (4, 2, 9, 3)]).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        S.insert_new(S.bars_of(S.read_events(spark, src), late="1 hour"), out, f"{tmp_path}/check")
    first = spark.read.parquet(out).collect()
    assert [(r.Open, r.High, r.Low, r.Close, r.Volume) for r in first] == [(5.0, 7.0, 5.0, 6.0, 3)]
    make([(5, 1, 10, 99), (6, 4, 9, 4)]).coalesce(1).write.mode("append").parquet(src)  # the first one is late
    S.insert_new(S.bars_of(S.read_events(spark, src), late="1 hour"), out, f"{tmp_path}/check")
    assert sorted((r.Date.day, r.High, r.Volume) for r in spark.read.parquet(out).collect()) == [(1, 7.0, 3), (2, 3.0, 1)]


def test_smoothed_stream_takes_rows_in_order(spark, tmp_path):
    """Shuffled, repeated and null rows over several runs give what a sorted series gives; a row too late is kept apart."""
    import pandas as pd

    from barwright.streaming import smoothing

    rng = np.random.default_rng(6)
    x, schema, src, out = rng.normal(10, 1, 300), "Ticker string, Date date, Close double", f"{tmp_path}/in", f"{tmp_path}/out"
    x[100:105] = x[100]  # neither gains nor losses
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", smoothing.ROCKS_DB)
    row = lambda t, i: (t, dt.date(2024, 1, 1) + dt.timedelta(int(i)), float(x[i]))
    for k, part in enumerate((range(0, 200), range(190, 300), [299])):
        rows = [row(t, i) for t in "AB" for i in rng.permutation(list(part))] + [("A", dt.date(2024, 1, 1) + dt.timedelta(max(part)), None)]
        if k == 1:
            rows.append(("A", dt.date(2023, 12, 1), 1000.0))  # long past
        if k == 2:
            rows = [("end", dt.date(2030, 1, 1), 1.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = smoothing.smoothed(spark.readStream.schema(schema).parquet(src), 5, 14, "15 days")
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
    s = pd.Series(x)
    d = s.diff()
    gain, loss = (v.where(d.notna()).ewm(alpha=1 / 14, adjust=False, ignore_na=True, min_periods=14).mean() for v in (d.clip(lower=0), (-d).clip(lower=0)))
    for t in "AB":
        got = spark.read.parquet(out).where(F.col("Ticker") == t).orderBy("Date").collect()
        assert [r.Close for r in got] == x.tolist()
        of = lambda c: [np.nan if r[c] is None else r[c] for r in got]  # noqa: B023, E731
        assert np.allclose(of("ema"), s.ewm(span=5, adjust=False, min_periods=5).mean(), equal_nan=True)
        assert np.allclose(of("rsi"), 100 - 100 / (1 + gain / loss), equal_nan=True)
    assert smoothing.rsi_of(np.array([0.0, 1.0, 1.0]), np.array([0.0, 0.0, 1.0])).tolist() == [50.0, 100.0, 50.0]


def test_late_rows_are_written_once(spark, tmp_path):
    src = f"{tmp_path}/events"
    make = lambda rows: spark.createDataFrame([(i, dt.datetime(2024, 1, d, h), 1, "x", 1.0, None) for i, d, h in rows], S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    for rows in ([(1, 1, 9), (2, 5, 9)], [(3, 4, 9), (4, 4, 10), (5, 5, 1), (6, 8, 0)], [(7, 6, 23), (8, 7, 1)]):
        make(rows)
        S.admit(S.read_events(spark, src), f"{tmp_path}/e", f"{tmp_path}/check", "1 day")
    S.admit(S.read_events(spark, src), f"{tmp_path}/e", f"{tmp_path}/check", "1 day")
    assert sorted(r.event_id for r in S.read_late(spark, f"{tmp_path}/e").collect()) == [3, 7]
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/e/kept").collect()) == [1, 2, 4, 5, 6, 8]


def test_model_queries_search_the_default_grids_over_all_days(spark, frame, monkeypatch):
    from barwright.queries import QUERIES

    seen = []
    monkeypatch.setattr(T, "train_model", lambda early, late, kind, **more: seen.append((early, kind, more)) or 1 / 0)
    for name in ("m03_lr_scores", "m04_gbt_scores"):
        with pytest.raises(ZeroDivisionError):
            QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [(kind, more) for _, kind, more in seen] == [("lr", {}), ("xgb", {})]
    assert seen[0][0].where("day_of_week in ('Saturday', 'Sunday')").count() > 0


def test_weekend_days_have_numbers(spark):
    stages, _ = T._encoders((), ("day_of_week",), ("day_of_week",))
    rows = spark.createDataFrame([(d,) for d in T.DAYS], "day_of_week string")
    assert [r.day_of_week_number for r in stages[0].transform(rows).collect()] == [float(i) for i in range(7)]
    with pytest.raises(Exception, match="unknown day_of_week"):
        stages[0].transform(spark.createDataFrame([("x",)], "day_of_week string")).collect()
