"""The feature functions: each adds its steps and output columns to a plan. Names are those of feature lists."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .window_plan import WindowPlan

O, H, L, C, V = "Open", "High", "Low", "Close", "Volume"  # noqa: E741
#: Rows of the Yang-Zhang estimator and of a volatility's own average.
YZ_ROWS, VOL_OF_VOL_ROWS = 20, 20
YZ_WEIGHT = 0.34 / (1.34 + (YZ_ROWS + 1) / (YZ_ROWS - 1))
#: Columns of the merged frame that tell rows apart or are the answer.
TARGET = "market_movement"

REGISTRY: dict[str, Callable] = {}


def feature(f: Callable) -> Callable:
    REGISTRY[f.__name__] = f
    return f


def _at_least(least: int, **args: int) -> None:
    for name, v in args.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < least:
            raise ValueError(f"{name} must be a whole number of at least {least}, not {v!r}")


def _window(n: int) -> None:
    _at_least(1, window_size=n)
    if n == 1:
        warnings.warn("a window of one row gives the value itself", stacklevel=3)


def _spans(short: int, long: int) -> None:
    _at_least(1, short_span=short, long_span=long)
    if short >= long:
        raise ValueError(f"short_span must be less than long_span, not {short} and {long}")


# variances of one bar


def _gk(p: WindowPlan) -> str:
    hl, co = p.log_ratio(H, L), p.log_ratio(C, O)
    return p.step("gk", lambda a, b: 0.5 * a * a - (2 * math.log(2) - 1) * b * b, hl, co)


def _pk(p: WindowPlan) -> str:
    return p.step("pk", lambda a: a * a / (4 * math.log(2)), p.log_ratio(H, L))


def _rs(p: WindowPlan) -> str:
    return p.step("rs", lambda a, b, c, d: a * b + c * d, p.log_ratio(H, C), p.log_ratio(H, O), p.log_ratio(L, C), p.log_ratio(L, O))


def _yz(p: WindowPlan, lag: int) -> str:
    """Open of the bar against the close lag + 1 bars before; open to close of the bar itself; lagged Rogers-Satchell."""
    night = p.var(p.log_ratio(O, p.lag(C, lag + 1)), YZ_ROWS)
    day = p.var(p.log_ratio(C, O), YZ_ROWS)
    rs = p.mean(p.lag(_rs(p), lag), YZ_ROWS)
    return p.step(f"yz({lag})", lambda a, b, c: a + YZ_WEIGHT * b + (1 - YZ_WEIGHT) * c, night, day, rs)


# the answer


@feature
def create_market_movement_target(p: WindowPlan, forward_window: int = 5, lookback_window: int = 20) -> None:
    """1 where the mean variance of the next bars is over that of the last ones, else 0."""
    _at_least(1, forward_window=forward_window, lookback_window=lookback_window)
    g = _gk(p)
    up = p.step(f"rises({g},{forward_window},{lookback_window})", lambda a, b: (a > b).cast("double"), p.mean_ahead(g, forward_window), p.mean(g, lookback_window))
    p.output(TARGET, up)


# prices and returns


@feature
def create_close_lag_feature(p: WindowPlan, lag: int = 1) -> None:
    _at_least(1, lag=lag)
    p.output(f"close_lag_{lag}", p.lag(C, lag))


@feature
def create_momentum_feature(p: WindowPlan, lag: int = 1) -> None:
    _at_least(1, lag=lag)
    p.output(f"momentum_{lag}", p.change(C, lag))


@feature
def create_lag_return_feature(p: WindowPlan, lag: int = 1, name: str = "return_lag") -> None:
    _at_least(1, lag=lag)
    p.output(f"{name}_{lag}", p.simple_return(C, lag))


@feature
def create_log_return_lag_feature(p: WindowPlan, lag: int = 1) -> None:
    _at_least(1, lag=lag)
    p.output(f"log_return_lag_{lag}", p.log_return(C, lag))


# trend


@feature
def create_simple_moving_average_feature(p: WindowPlan, window_size: int = 2, name: str = "SMA") -> None:
    _window(window_size)
    p.output(f"{name}_{window_size}", p.mean(C, window_size))


@feature
def create_distance_from_sma_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"distance_close_vs_SMA_{window_size}", p.step(f"distance({window_size})", lambda r: r - 1, p.ratio(C, p.mean(C, window_size))))


@feature
def create_log_distance_from_sma_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"log_distance_close_vs_SMA_{window_size}", p.log_ratio(C, p.mean(C, window_size)))


def _ema(p: WindowPlan, n: int) -> str:
    return p.smooth(C, 2 / (n + 1), n)


@feature
def create_ema_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"ema_{window_size}", _ema(p, window_size))


@feature
def create_ema_crossover_feature(p: WindowPlan, short_span: int, long_span: int) -> None:
    _at_least(1, short_span=short_span, long_span=long_span)
    if short_span == long_span:
        raise ValueError("the spans must differ")
    gap = p.step(f"gap({short_span},{long_span})", lambda a, b: a - b, _ema(p, short_span), _ema(p, long_span))
    p.output(f"ema{short_span}_minus_ema{long_span}", gap)


# volatility of returns, bands, oscillator


@feature
def create_simple_return_volatility_feature(p: WindowPlan, window_size: int = 2, name: str = "simple_return_volatility") -> None:
    _at_least(2, window_size=window_size)
    p.output(f"{name}_{window_size}", p.std(p.simple_return(C, 1), window_size))


@feature
def create_log_return_volatility_feature(p: WindowPlan, window_size: int = 2) -> None:
    _at_least(2, window_size=window_size)
    p.output(f"log_return_volatility_{window_size}", p.std(p.log_return(C, 1), window_size))


@feature
def create_bollinger_bands_features(p: WindowPlan, window_size: int = 20) -> None:
    _at_least(2, window_size=window_size)
    m, s = p.mean(C, window_size), p.std(C, window_size)
    parts = {
        "upper_distance": lambda c, m, s: F.try_divide(m + 2 * s - c, c),
        "lower_distance": lambda c, m, s: F.try_divide(c - (m - 2 * s), c),
        "bandwidth": lambda c, m, s: F.try_divide(4 * s, m),
    }
    for part, f in parts.items():
        p.output(f"bollinger_{part}_{window_size}", p.step(f"bollinger({part},{window_size})", f, C, m, s))


@feature
def create_rsi_feature(p: WindowPlan, window_size: int = 14) -> None:
    _at_least(2, window_size=window_size)
    d = p.change(C, 1)
    gain = p.step("gain", lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))), d)
    loss = p.step("loss", lambda x: F.when(x.isNotNull(), F.greatest(-x, F.lit(0.0))), d)
    g, s = p.smooth(gain, 1 / window_size, window_size), p.smooth(loss, 1 / window_size, window_size)

    def index(g, s):
        return F.when((s == 0) & (g > 0), 100.0).when((s == 0) & (g == 0), 50.0).otherwise(100 - 100 / (1 + F.try_divide(g, s)))

    p.output(f"rsi_{window_size}", p.step(f"rsi({window_size})", index, g, s))


# candles


def _candle(name: str, make: Callable, *needs: str) -> Callable:
    def add(p: WindowPlan) -> None:
        p.output(name, p.step(name, make, *needs))

    return add


REGISTRY |= {
    "create_daily_range_feature": _candle("daily_range", lambda h, x: h - x, H, L),
    "create_range_percentage_feature": _candle("range_percentage", lambda h, x, c: F.try_divide(h - x, c), H, L, C),
    "create_candle_body_feature": _candle("candle_body", lambda o, c: c - o, O, C),
    "create_body_percentage_feature": _candle("body_percentage", lambda o, c: F.try_divide(c - o, o), O, C),
    "create_upper_shadow_feature": _candle("upper_shadow", lambda o, c, h: h - F.greatest(o, c), O, C, H),
    "create_lower_shadow_feature": _candle("lower_shadow", lambda o, c, x: F.least(o, c) - x, O, C, L),
    "create_upper_shadow_percentage_feature": _candle("upper_shadow_pct", lambda o, c, h: F.try_divide(h - F.greatest(o, c), c), O, C, H),
    "create_lower_shadow_percentage_feature": _candle("lower_shadow_pct", lambda o, c, x: F.try_divide(F.least(o, c) - x, c), O, C, L),
}


# volume


@feature
def create_volume_pct_change_feature(p: WindowPlan, lag: int = 1) -> None:
    _at_least(1, lag=lag)
    p.output(f"volume_pct_change_{lag}", p.step(f"volume_change({lag})", F.try_divide, p.change(V, lag), p.lag(V, lag)))


@feature
def create_volume_sma_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"volume_sma_{window_size}", p.mean(V, window_size))


@feature
def create_relative_volume_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"relative_volume_{window_size}", p.ratio(V, p.mean(V, window_size)))


@feature
def create_return_x_volume_feature(p: WindowPlan) -> None:
    p.output("return_x_volume", p.step("return_x_volume", lambda v, d: v * d, V, p.change(C, 1)))


# risk


def _drawdown(p: WindowPlan, n: int) -> str:
    return p.step(f"drawdown({n})", lambda r: r - 1, p.ratio(C, p.max(C, n)))


@feature
def create_drawdown_feature(p: WindowPlan, window_size: int = 2, name: str = "drawdown") -> None:
    _at_least(2, window_size=window_size)
    p.output(f"{name}_{window_size}", _drawdown(p, window_size))


@feature
def create_rolling_window_mdd_feature(p: WindowPlan, window_size: int = 2) -> None:
    _at_least(2, window_size=window_size)
    p.output(f"rolling_window_mdd_{window_size}", p.min(_drawdown(p, window_size), window_size))


@feature
def create_rolling_sharpe_ratio_feature(p: WindowPlan, window_size: int = 2) -> None:
    _at_least(2, window_size=window_size)
    r = p.simple_return(C, 1)
    p.output(f"sharpe_{window_size}", p.ratio(p.mean(r, window_size), p.std(r, window_size)))


# calendar


@feature
def create_date_features(p: WindowPlan) -> None:
    p.output("day_of_week", p.step("day_of_week", lambda d: F.date_format(d, "EEEE"), "Date"))
    p.output("month", p.step("month", lambda d: F.date_format(d, "MM"), "Date"))


# range-based variances: (bar variance, prefix of its own columns, prefix of its means and volatilities)

FAMILIES = {"garman_klass": (_gk, "gk", "gk"), "parkinson": (_pk, "parkinson", "parkinson"), "rogers_satchell": (_rs, "rogers_satchell", "rs")}


def _variance(base: Callable, long_name: str) -> Callable:
    def add(p: WindowPlan, lag: int = 1) -> None:
        _at_least(1, lag=lag)
        p.output(f"{long_name}_variance_lag_{lag}", p.lag(base(p), lag))

    return add


def _mean_variance(base: Callable, name: str) -> Callable:
    def add(p: WindowPlan, window_size: int = 2, lag: int = 1) -> None:
        _at_least(1, window_size=window_size, lag=lag)
        p.output(f"{name}_variance_mean_{window_size}_lag_{lag}", p.mean(p.lag(base(p), lag), window_size))

    return add


def _regime(base: Callable, name: str) -> Callable:
    def add(p: WindowPlan, short_span: int, long_span: int) -> None:
        _spans(short_span, long_span)
        x = base(p)
        p.output(f"{name}_regime_{short_span}_{long_span}", p.ratio(p.mean(x, short_span), p.mean(x, long_span)))

    return add


def _volatility(p: WindowPlan, x: str, name: str, n: int, lag: int, second: bool = True) -> None:
    vol = p.root(p.mean(x, n))
    p.output(f"{name}_volatility_{n}_lag_{lag}", vol)
    if second:
        p.output(f"{name}_vol_of_vol_{n}_lag_{lag}", p.mean(vol, VOL_OF_VOL_ROWS))


def _range_volatility(base: Callable, name: str) -> Callable:
    def add(p: WindowPlan, window_size: int = 2, lag: int = 1) -> None:
        _at_least(1, window_size=window_size, lag=lag)
        _volatility(p, p.lag(base(p), lag), name, window_size, lag)

    return add


for _family, (_base, _own, _short) in FAMILIES.items():
    _lagged = lambda p, base=_base: p.lag(base(p), 1)
    _mean_name = "gk" if _family == "garman_klass" else _family
    REGISTRY[f"create_{_family}_variance_feature"] = _variance(_base, _own)
    REGISTRY[f"create_{_mean_name}_variance_rolling_mean_feature"] = _mean_variance(_base, _short)
    REGISTRY[f"create_{_mean_name}_regime_feature"] = _regime(_lagged, _short)
    if _family != "garman_klass":
        REGISTRY[f"create_{_family}_volatility_feature"] = _range_volatility(_base, _short)


@feature
def create_yang_zhang_variance_feature(p: WindowPlan, lag: int = 1) -> None:
    _at_least(1, lag=lag)
    p.output(f"yz_variance_lag_{lag}", _yz(p, lag))


@feature
def create_yang_zhang_variance_rolling_mean_feature(p: WindowPlan, lag: int = 1, window_size: int = 1) -> None:
    _at_least(1, window_size=window_size, lag=lag)
    p.output(f"yz_variance_mean_{window_size}_lag_{lag}", p.mean(_yz(p, lag), window_size))


REGISTRY["create_yang_zhang_regime_feature"] = _regime(lambda p: _yz(p, 1), "yz")


@feature
def create_yang_zhang_volatility_feature(p: WindowPlan, lag: int = 1, window_size: int = 1) -> None:
    _at_least(1, window_size=window_size, lag=lag)
    _volatility(p, _yz(p, lag), "yz", window_size, lag)


@feature
def create_yang_zhang_volatility_ratio_feature(p: WindowPlan, short_span: int = 5, long_span: int = 20) -> None:
    _spans(short_span, long_span)
    short, long = (p.root(p.mean(_yz(p, 1), n)) for n in (short_span, long_span))
    p.output(f"yz_volatility_ratio_{short_span}_{long_span}", p.ratio(short, long))


@feature
def create_yang_zhang_volatility_features(p: WindowPlan, lag: int = 1, window_size: int = 1) -> None:
    create_yang_zhang_variance_feature(p, lag)
    create_yang_zhang_variance_rolling_mean_feature(p, lag, window_size)
    _volatility(p, _yz(p, lag), "yz", window_size, lag, second=False)


# market context: features of other names; original_colname tells which column of the frame is given the new name, if not
# the feature's own


def _renamed(p: WindowPlan, create: Callable[..., None], own: str, new: str, size: int, original: str | None) -> None:
    if original is None or original == f"{own}_{size}":
        create(p, size, new)
    else:
        create(p, size, own)
        p.rename(original, f"{new}_{size}")


@feature
def create_spy_lag_return_feature(p: WindowPlan, lag: int = 1, original_colname: str | None = None) -> None:
    _renamed(p, create_lag_return_feature, "return_lag", "spy_lag_return", lag, original_colname)


@feature
def create_spy_volatility_feature(p: WindowPlan, window_size: int = 2, original_colname: str | None = None) -> None:
    _renamed(p, create_simple_return_volatility_feature, "simple_return_volatility", "spy_volatility", window_size, original_colname)


@feature
def create_spy_drawdown_feature(p: WindowPlan, window_size: int = 2, original_colname: str | None = None) -> None:
    _renamed(p, create_drawdown_feature, "drawdown", "spy_drawdown", window_size, original_colname)


@feature
def create_spy_sma_ratio_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"spy_sma_ratio_{window_size}", p.ratio(C, p.mean(C, window_size)))


@feature
def create_spy_return_zscore_feature(p: WindowPlan, window_size: int = 2) -> None:
    _at_least(2, window_size=window_size)
    r = p.simple_return(C, 1)
    z = p.step(f"zscore({r},{window_size})", lambda x, m, s: F.try_divide(x - m, s), r, p.mean(r, window_size), p.std(r, window_size))
    p.output(f"spy_return_zscore_{window_size}", z)


@feature
def create_vix_level_feature(p: WindowPlan) -> None:
    p.output("vix_level", C)


@feature
def create_vix_lag_return_feature(p: WindowPlan, lag: int = 1, original_colname: str | None = None) -> None:
    _renamed(p, create_lag_return_feature, "return_lag", "vix_return_lag", lag, original_colname)


@feature
def create_vix_sma_feature(p: WindowPlan, window_size: int = 2, original_colname: str | None = None) -> None:
    _renamed(p, create_simple_moving_average_feature, "SMA", "vix_SMA", window_size, original_colname)


@feature
def create_vix_percentile_feature(p: WindowPlan, window_size: int = 2) -> None:
    _window(window_size)
    p.output(f"vix_percentile_{window_size}", p.rank(C, window_size))


def compile_features(specs: Iterable[dict]) -> WindowPlan:
    """A plan of the features in a list of {function, kwargs}; unknown names are an error that lists the known ones."""
    plan = WindowPlan()
    for spec in specs:
        name = spec["function"]
        if name not in REGISTRY:
            raise ValueError(f"unknown feature function {name!r}; known are {', '.join(sorted(REGISTRY))}")
        REGISTRY[name](plan, **(spec.get("kwargs") or {}))
    return plan


def add_features(bars: DataFrame, specs: Iterable[dict], drop: tuple[str, ...] = ("Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """The bars with all features of the list, less the columns to drop (those that aren't there don't matter)."""
    plan = compile_features(specs)
    return plan.apply(bars, tuple(c for c in bars.columns if c not in drop))
