"""Feature functions against pandas, and the shape of their plans."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barwright.plans import parameters as P
from barwright.plans.features import REGISTRY, add_features, compile_features
from barwright.plans.frames import merge_dataframes, model_frame, project
from barwright.plans.window_plan import WindowPlan
from barwright.schema import BAR


def bars(n=80, tickers=("AAPL", "MSFT"), seed=42):
    rng, out = np.random.default_rng(seed), []
    days = pd.bdate_range("2024-01-01", periods=n)
    for t in tickers:
        close = 150 + rng.normal(0, 2, n).cumsum()
        open_ = close + rng.normal(0, 0.5, n)
        out.append(pd.DataFrame({"Date": days.date, "Ticker": t, "Open": open_, "High": np.maximum(open_, close) + rng.random(n), "Low": np.minimum(open_, close) - rng.random(n), "Close": close, "Volume": rng.integers(1e6, 1e7, n)}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def pdf():
    return bars()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1), BAR)


def run(df, name, **kwargs):
    return add_features(df, [{"function": f"create_{name}", "kwargs": kwargs}], ()).toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)


def each(pdf, f):
    return pdf.groupby("Ticker", group_keys=False).apply(f, include_groups=False).reset_index(drop=True)


GK = lambda g: 0.5 * np.log(g.High / g.Low) ** 2 - (2 * np.log(2) - 1) * np.log(g.Close / g.Open) ** 2
PK = lambda g: np.log(g.High / g.Low) ** 2 / (4 * np.log(2))
RS = lambda g: np.log(g.High / g.Close) * np.log(g.High / g.Open) + np.log(g.Low / g.Close) * np.log(g.Low / g.Open)


def yz(g, k):
    w = 0.34 / (1.34 + 21 / 19)
    night, day = np.log(g.Open / g.Close.shift(k + 1)), np.log(g.Close / g.Open)
    return night.rolling(20).var() + w * day.rolling(20).var() + (1 - w) * RS(g).shift(k).rolling(20).mean()


def rsi(g, n):
    d = g.Close.diff()
    up, down = (x.ewm(alpha=1 / n, adjust=False, ignore_na=True, min_periods=n).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
    return 100 - 100 / (1 + up / down)


def target(g):
    v = GK(g)
    ahead, base = v.shift(-1).rolling(5).mean().shift(-4), v.rolling(20).mean()
    return (ahead > base).astype(float).where(ahead.notna() & base.notna())


CASES = [
    ("market_movement_target", {}, {"market_movement": target}),
    ("close_lag_feature", {"lag": 2}, {"close_lag_2": lambda g: g.Close.shift(2)}),
    ("momentum_feature", {"lag": 3}, {"momentum_3": lambda g: g.Close.diff(3)}),
    ("lag_return_feature", {"lag": 2}, {"return_lag_2": lambda g: g.Close / g.Close.shift(2) - 1}),
    ("log_return_lag_feature", {"lag": 1}, {"log_return_lag_1": lambda g: np.log(g.Close / g.Close.shift(1))}),
    ("simple_moving_average_feature", {"window_size": 5}, {"SMA_5": lambda g: g.Close.rolling(5).mean()}),
    ("log_distance_from_sma_feature", {"window_size": 5}, {"log_distance_close_vs_SMA_5": lambda g: np.log(g.Close / g.Close.rolling(5).mean())}),
    ("ema_feature", {"window_size": 12}, {"ema_12": lambda g: g.Close.ewm(span=12, adjust=False, min_periods=12).mean()}),
    ("ema_crossover_feature", {"short_span": 5, "long_span": 20}, {"ema5_minus_ema20": lambda g: g.Close.ewm(span=5, adjust=False, min_periods=5).mean() - g.Close.ewm(span=20, adjust=False, min_periods=20).mean()}),
    ("rsi_feature", {"window_size": 7}, {"rsi_7": lambda g: rsi(g, 7)}),
    ("bollinger_bands_features", {"window_size": 10}, {"bollinger_bandwidth_10": lambda g: 4 * g.Close.rolling(10).std() / g.Close.rolling(10).mean()}),
    ("rolling_window_mdd_feature", {"window_size": 6}, {"rolling_window_mdd_6": lambda g: (g.Close / g.Close.rolling(6).max() - 1).rolling(6).min()}),
    ("rolling_sharpe_ratio_feature", {"window_size": 6}, {"sharpe_6": lambda g: g.Close.pct_change().rolling(6).mean() / g.Close.pct_change().rolling(6).std()}),
    ("gk_regime_feature", {"short_span": 3, "long_span": 9}, {"gk_regime_3_9": lambda g: GK(g).shift(1).rolling(3).mean() / GK(g).shift(1).rolling(9).mean()}),
    ("parkinson_volatility_feature", {"window_size": 4, "lag": 2}, {"parkinson_vol_of_vol_4_lag_2": lambda g: (PK(g).shift(2).rolling(4).mean() ** 0.5).rolling(20).mean()}),
    ("rogers_satchell_variance_rolling_mean_feature", {"window_size": 4, "lag": 2}, {"rs_variance_mean_4_lag_2": lambda g: RS(g).shift(2).rolling(4).mean()}),
    ("yang_zhang_variance_feature", {"lag": 2}, {"yz_variance_lag_2": lambda g: yz(g, 2)}),
    ("yang_zhang_volatility_feature", {"lag": 1, "window_size": 3}, {"yz_vol_of_vol_3_lag_1": lambda g: (yz(g, 1).rolling(3).mean() ** 0.5).rolling(20).mean()}),
    ("vix_percentile_feature", {"window_size": 15}, {"vix_percentile_15": lambda g: g.Close.rolling(15).apply(lambda x: x.rank(pct=True).iloc[-1])}),
    ("relative_volume_feature", {"window_size": 5}, {"relative_volume_5": lambda g: g.Volume / g.Volume.rolling(5).mean()}),
]


@pytest.mark.parametrize(("name", "kwargs", "want"), CASES, ids=[c[0] for c in CASES])
def test_equals_pandas(df, pdf, name, kwargs, want):
    got = run(df, name, **kwargs)
    for column, f in want.items():
        expected = each(pdf, f).to_numpy(float)
        mine = got[column].to_numpy(float)
        assert (np.isnan(mine) == np.isnan(expected)).all()
        assert np.allclose(mine, expected, atol=1e-10, equal_nan=True)


def test_registry_and_lists():
    assert len(REGISTRY) == 56 and all(n.startswith("create_") for n in REGISTRY)
    assert (len(P.STOCK_FEATURES), len(P.SPY_FEATURES), len(P.VIX_FEATURES)) == (80, 8, 8)
    assert (len(P.LR_FEATURES), len(P.XGB_FEATURES), len(P.MLP_FEATURES)) == (73, 105, 73)
    with pytest.raises(ValueError, match="create_close_lag_feature"):
        compile_features([{"function": "create_nothing"}])


BAD = [("close_lag_feature", {"lag": 0}), ("rsi_feature", {"window_size": 1}), ("gk_regime_feature", {"short_span": 5, "long_span": 5}), ("ema_crossover_feature", {"short_span": 5, "long_span": 5}),
       ("garman_klass_variance_feature", {"lag": 1.5}), ("spy_return_zscore_feature", {"window_size": 1}), ("simple_moving_average_feature", {"window_size": 0}), ("yang_zhang_volatility_ratio_feature", {"short_span": 9, "long_span": 3})]


@pytest.mark.parametrize(("name", "kwargs"), BAD)
def test_bad_arguments(name, kwargs):
    with pytest.raises(ValueError):
        compile_features([{"function": f"create_{name}", "kwargs": kwargs}])


def test_one_row_windows_warn():
    with pytest.warns(UserWarning):
        compile_features([{"function": "create_simple_moving_average_feature", "kwargs": {"window_size": 1}}])


def test_one_shuffle_and_shared_steps(df):
    plan = compile_features(P.STOCK_FEATURES)
    once = compile_features([s for s in P.STOCK_FEATURES if "yang_zhang" in s["function"]])
    assert sum(s.startswith("yz(") for s in once.steps) == 1
    text = plan.apply(df, ("Ticker", "Date"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(Ticker") == 1 and "Python" not in text


def test_pruned_plan(df):
    wide = compile_features(P.STOCK_FEATURES).apply(df, ("Ticker", "Date")).select("Ticker", "momentum_1")
    text = wide._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 1 and "collect_list" not in text


@pytest.mark.parametrize("span", [1, 2, 5, 26, 60, 150])
def test_averages_over_many_blocks(spark, span):
    n = 3000
    x = pd.Series(100 + np.random.default_rng(span).normal(0, 1, n).cumsum())
    x[[0, 1, 70, 1030, 1031, 2047]] = np.nan
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(n)]
    df = spark.createDataFrame([(d, "A", None if v != v else float(v)) for d, v in zip(days, x, strict=True)], "Date date, Ticker string, Close double")
    plan = WindowPlan()
    plan.output("e", plan.smooth("Close", 2 / (span + 1), span))
    got = plan.apply(df).orderBy("Date").toPandas()["e"]
    want = x.ewm(span=span, adjust=False, ignore_na=True, min_periods=span).mean().where(x.notna())
    assert (got.isna().to_numpy() == want.isna().to_numpy()).all() and np.allclose(got.astype(float), want, rtol=1e-12, atol=1e-10, equal_nan=True)


def test_yaml_replaces_defaults(spark, tmp_path, df):
    (tmp_path / "b.yml").write_text("max_gap_days: 3\nstock_features_config:\n  - function: create_momentum_feature\n    kwargs:\n      lag: 4\n  - function: create_date_features\n")
    (tmp_path / "c.yml").write_text("max_gap_days: 5\n")
    got = P.load_parameters(tmp_path)
    assert got["max_gap_days"] == 5 and got["training_proportion"] == 0.8
    assert add_features(df, got["stock_features_config"]).columns == ["Date", "Ticker", "momentum_4", "day_of_week", "month"]


def test_zero_divisors_are_null(spark):
    rows = [(dt.date(2024, 1, i), "A", 0.0, 1.0, 0.0, 0.0, 0) for i in range(1, 30)]
    out = add_features(spark.createDataFrame(rows, BAR), P.STOCK_FEATURES, ())
    assert out.count() == 29
    assert out.where("body_percentage is not null or volume_pct_change_1 is not null or log_return_lag_1 is not null").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.integers(2, 9), st.integers(1, 4))
def test_null_prefix_and_ticker_isolation(spark, n, k):
    pdf = bars(30, ("X", "Y"), seed=n * 10 + k)
    both = run(spark.createDataFrame(pdf, BAR), "gk_variance_rolling_mean_feature", window_size=n, lag=k)
    alone = run(spark.createDataFrame(pdf[pdf.Ticker == "Y"], BAR), "gk_variance_rolling_mean_feature", window_size=n, lag=k)
    c = f"gk_variance_mean_{n}_lag_{k}"
    mine = both[both.Ticker == "Y"][c].reset_index(drop=True)
    assert mine.isna().sum() == n + k - 1 and np.allclose(mine, alone[c], equal_nan=True)


def test_merge_and_project(spark):
    a = spark.createDataFrame([("2024-01-01", 1, True), ("2024-01-02", 2, True)], "Date string, f1 int, `Repaired?` boolean")
    b, c = (spark.createDataFrame([("2024-01-01", x)], f"Date string, {n} int") for n, x in (("spy1", 5), ("vix1", 6)))
    out = merge_dataframes(a, b, c)
    assert sorted(map(tuple, out.collect())) == [("2024-01-01", 1, 5, 6), ("2024-01-02", 2, None, None)]
    assert sorted(map(tuple, merge_dataframes(a, b, c, broadcast_rows=0).collect())) == sorted(map(tuple, out.collect()))
    with pytest.raises(KeyError):
        project(out, ["nope"])


def test_model_frames(df, spark):
    spy = spark.createDataFrame(bars(80, ("SPY",)), BAR)
    vix = spark.createDataFrame(bars(80, ("^VIX",)), BAR)
    for model, n in (("lr", 73), ("xgb", 105), ("mlp", 73)):
        assert len(model_frame(df, spy, vix, model).columns) == n + 1
    assert "market_movement" not in model_frame(df, spy, vix, "lr", serving=True).columns
    with pytest.raises(ValueError):
        model_frame(df, spy, vix, "none")


@pytest.fixture(scope="module")
def long_series(spark):
    rng, rows, series = np.random.default_rng(21), [], {}
    for t, n in (("A", 1500), ("B", 700), ("C", 40)):
        x = pd.Series(rng.normal(0, 1, n).cumsum().round(1) + 50)
        x[rng.integers(0, n, 2 if n > 100 else 0)] = np.nan
        series[t] = x
        rows += [(dt.date(2000, 1, 1) + dt.timedelta(i), t, None if v != v else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "Date date, Ticker string, Close double").repartition(5), series


@pytest.mark.parametrize("n", [1, 2, 128, 129, 200, 500])
def test_extremes_and_ranks_of_windows_of_any_width(long_series, n):
    df, series = long_series
    plan = WindowPlan()
    for name in ("max", "min", "rank"):
        plan.output(name, getattr(plan, name)("Close", n))
    got = plan.apply(df).toPandas().sort_values("Date")
    for t, x in series.items():
        mine = got[got.Ticker == t].set_index(x.index)
        for name, want in (("max", x.rolling(n).max()), ("min", x.rolling(n).min()), ("rank", x.rolling(n).rank(pct=True))):
            assert np.allclose(mine[name].astype(float), want, equal_nan=True), (t, name)


def test_wide_windows_cost_as_much_as_narrow_ones():
    from barwright.plans.ranks import rolling_ranks

    x = np.random.default_rng(1).normal(size=300_000).round(3)
    seconds = []
    for n in (1_000, 100_000):
        began = time.perf_counter()
        got = rolling_ranks(x, n)
        seconds.append(time.perf_counter() - began)
    window = x[200_001 - 100_000 : 200_001]
    assert got[200_000] == ((window < x[200_000]).sum() + ((window == x[200_000]).sum() + 1) / 2) / 100_000
    assert seconds[1] < 3 * seconds[0] + 1


def test_wide_extremes_need_no_walk(df):
    plan = WindowPlan()
    plan.output("x", plan.max("Close", 5000))
    text = plan.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "-4999, currentrow" not in text and "Python" not in text


def test_original_colname(df):
    specs = lambda **k: [{"function": "create_spy_lag_return_feature", "kwargs": {"lag": 2, **k}}]
    plain = compile_features(specs()).apply(df, ("Ticker", "Date"))
    assert plain.columns == ["Ticker", "Date", "spy_lag_return_2"] == compile_features(specs(original_colname="return_lag_2")).apply(df, ("Ticker", "Date")).columns
    other = compile_features(specs(original_colname="Open")).apply(df, ("Ticker", "Date", "Open"))
    assert other.columns == ["Ticker", "Date", "spy_lag_return_2", "return_lag_2"]
    assert sorted(map(str, other.select("Ticker", "Date", "return_lag_2").collect())) == sorted(str(r).replace("spy_lag_return_2", "return_lag_2") for r in plain.collect())
    assert compile_features(specs(original_colname="none")).apply(df, ("Ticker", "Date")).columns == ["Ticker", "Date", "return_lag_2"]
    both = [{"function": "create_momentum_feature", "kwargs": {"lag": 1}}, *specs(original_colname="momentum_1")]
    assert compile_features(both).apply(df, ("Ticker",)).columns == ["Ticker", "spy_lag_return_2", "return_lag_2"]
