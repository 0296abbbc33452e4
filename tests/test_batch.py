"""One call from a source of bars to an aliased model, and from that to a logged prediction."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright import batch
from barwright.operators import inference as I
from barwright.operators import selection
from barwright.schema import BAR, MODEL_ALIAS, MODEL_VERSION
from barwright.sources import bars as B
from barwright.sources.store import Store

DAYS = 420
FIRST = dt.date(2023, 1, 2)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rng, rows = np.random.default_rng(11), []
    for t, level in (("A", 100), ("B", 60), ("SPY", 400), ("^VIX", 40)):
        close = level + rng.normal(0, 1, DAYS + 3).cumsum() * 0.3
        rows += [(FIRST + dt.timedelta(i), t, float(c), float(c + 0.5 + abs(rng.normal())), float(c - 0.5 - abs(rng.normal())), float(c + 0.2), int(rng.integers(500, 1500))) for i, c in enumerate(close)]
    path = str(tmp_path_factory.mktemp("bars"))
    spark.createDataFrame(rows, BAR).coalesce(1).write.mode("overwrite").parquet(path)
    return B.parquet_source(spark, path)


def test_batch_to_logged_prediction(spark, source, tmp_path):
    store = Store(spark, str(tmp_path))
    end = str(FIRST + dt.timedelta(DAYS))
    params = {"tickers": ["a", "B"], "raw_data_start_date": str(FIRST), "raw_data_end_date": end, "folds": 2,
              "lr_param_grid": {"C": (0.01,), "l1_ratio": (0.0,)}, "xgb_param_grid": {"n_estimators": (2,), "max_depth": (1,)}}
    b = batch.run_batch(store, source, params)
    assert store.read("stock_data").count() == 2 * DAYS and store.read("spy_data").count() == DAYS == store.read("vix_data").count()
    assert b.read("lr_X_train").count() + b.read("lr_X_test").count() == b.read("lr_features").dropna("any").count() > 100
    assert "is_outlier" in b.read("lr_X_test_clipped").columns and "market_movement" not in b.read("xgb_X_test").columns
    runs = store.read("runs").collect()
    assert {r.tags["model"] for r in runs} == {"lr", "xgb"} and all(r.tags["train_data"].startswith(str(tmp_path)) and 0 <= r.metrics["roc_auc"] <= 1 for r in runs)
    best = max(runs, key=lambda r: (r.metrics["roc_auc"], r.start_time))
    versions = {r.run_id: (r.version, r.alias) for r in store.versions().collect()}
    assert sorted(v for v, _ in versions.values()) == [1, 2] and [i for i, (_, a) in versions.items() if a == "champion"] == [best.run_id]
    assert [type(s).__name__ for s in store.load_pipeline("xgb_pipeline").getStages()][-1] == "BoostedTrees"
    assert [(r.experiment, r.runs) for r in selection.experiments(store.read("runs")).collect()] == [("market-regimes", 2)]
    listed = selection.models(store.versions()).first()
    assert (listed.versions, listed.latest, list(map(tuple, listed.aliases))) == (2, 2, [("champion", versions[best.run_id][0])])

    with pytest.raises(ValueError):
        batch.run_batch(store, source, params, ["nothing"])
    batch.run_batch(store, source, params, ["data_ingestion"])  # all is there: nothing is loaded or added
    assert store.read("stock_data").count() == 2 * DAYS

    p = I.VolatilityPredictor.champion(store)
    assert p.model_type == best.tags["model"]
    today = FIRST + dt.timedelta(DAYS + 2)
    got = p.predict_ticker(store, source, "a", 500, today).collect()
    assert len(got) == 1 and got[0].Ticker == "A" and got[0].Date == today and got[0].model_type == p.model_type
    last = source(["A"], str(today), str(today + dt.timedelta(1))).first()
    assert got[0].close_price == last.Close and store.read("stock_data").where("Ticker = 'A'").count() == DAYS + 3
    bars, features = p.prepare_features(store, source, "A", 500, today)
    row = p.latest_features(bars, features).first()
    assert len(row.ohlcv) == len(row.bollinger.upper) == bars.count() and row.features["Date"] == str(today)
    rich = p.get_prediction(store, source, "A", 500, 4, 50, today).first()
    assert rich.close_price == last.Close and rich.model_type == p.model_type and rich.probability == got[0].probability and len(rich.attribution) == 4
    why = p.explain(store, source, "A", 500, 4, 50, today).collect()
    assert [(r.rank, r.feature) for r in why] == [(a["rank"], a.feature) for a in rich.attribution]
    assert spark.read.parquet(best.tags["evaluated_data"]).where("prediction in (0, 1) and probability between 0 and 1").count() == spark.read.parquet(best.tags["evaluated_data"]).count() > 0
    assert p.log(store, p.predict(features)) and store.prediction_logs().first().ticker == "A"
    for other in ("lr", "xgb"):
        v = next(version for version, _ in versions.values() if version != versions[best.run_id][0])
        store.set_alias("volatility-regime", v if other != p.model_type else versions[best.run_id][0])
        assert I.VolatilityPredictor.champion(store).model_type == other


def test_downloads(spark, source):
    first, end = str(FIRST), str(FIRST + dt.timedelta(10))
    got = B.download_ohlcv_data(source, ["a", "B"], first, end)
    assert got.columns == list(BAR.names) and got.count() == 20
    assert B.download_ohlcv_data(source, ["a"], "", end).count() == 0 == B.download_market_data(source, "", end).count()
    for tickers, start, error in (([], first, ValueError), ([1], first, TypeError), (["A"], end, ValueError), (["none"], first, ValueError)):
        with pytest.raises(error):
            B.download_ohlcv_data(source, tickers, start, end)
    assert {r.Ticker for r in B.download_market_data(source, first, end).select("Ticker").distinct().collect()} == {"SPY", "^VIX"}
    assert B.download_market_data(source, first, end, ["none"]).count() == 0
    plain = lambda tickers, a, b: source(tickers, a, b).drop("Ticker")
    assert B.download_market_data(plain, first, end, ["SPY"]).select("Ticker").distinct().collect()[0][0] == "SPY"
    side = lambda tickers, a, b: B.wide(source(tickers, a, b), tickers)
    assert sorted(map(tuple, B.download_ohlcv_data(side, ["A", "B"], first, end).collect())) == sorted(map(tuple, got.collect()))


def test_aliases_move(spark):
    versions = spark.createDataFrame([("m", 1, "a", "p", "champion"), ("m", 2, "b", "p", None), ("n", 1, "c", "p", "champion")], MODEL_VERSION)
    given = spark.createDataFrame([("m", "champion", 1, 1), ("m", "champion", 2, 2), ("m", "old", 1, 3)], MODEL_ALIAS)
    assert sorted((r.name, r.version, r.alias) for r in selection.with_aliases(versions, given).collect()) == [("m", 1, "old"), ("m", 2, "champion"), ("n", 1, "champion")]
    assert sorted((r.name, r.alias) for r in selection.with_aliases(versions, given.limit(0)).where(F.col("alias").isNotNull()).collect()) == [("m", "champion"), ("n", "champion")]
