"""One query for each feature function, and its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.plans import parameters as P
from barwright.plans.features import compile_features
from barwright.plans.frames import model_frame
from barwright.plans.window_plan import ema_rows
from barwright.sources import bars as B

from .sql import BARS, div, ln, roll, staged
from .sql import lag as _lag

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SOURCES = {"bars": B.stock_bars, "spy": B.spy_bars, "vix": B.vix_bars, "bars_evt": B.event_bars}


C1 = {"c1": _lag('"Close"', 1)}
GK = {"gk": f"0.5 * pow({ln(div('"High"', '"Low"'))}, 2) - (2 * ln(2) - 1) * pow({ln(div('"Close"', '"Open"'))}, 2)"}
PK = {"pk": f"pow({ln(div('"High"', '"Low"'))}, 2) / (4 * ln(2))"}
RS = {"rs": f"({ln(div('"High"', '"Close"'))}) * ({ln(div('"High"', '"Open"'))}) + ({ln(div('"Low"', '"Close"'))}) * ({ln(div('"Low"', '"Open"'))})"}
RET = [C1, {"r": f"{div('"Close"', 'c1')} - 1", "lr": ln(div('"Close"', "c1"))}]


def yz(k: int) -> list[dict[str, str]]:
    kappa = 0.34 / (1.34 + 21 / 19)
    return [
        {**RS, "far": _lag('"Close"', k + 1)},
        {"rsk": _lag("rs", k), "night": ln(div('"Open"', "far")), "day": ln(div('"Close"', '"Open"'))},
        {"yz": f"({roll('var_samp', 'night', 20)}) + {kappa!r} * ({roll('var_samp', 'day', 20)}) + {1 - kappa!r} * ({roll('avg', 'rsk', 20)})"},
    ]


def fold(x: str, alpha: float, wait: int) -> str:
    """The recursive average over non-null values of the rows that still count."""
    k = ema_rows(alpha)
    w = f'OVER (PARTITION BY "Ticker" ORDER BY "Date" ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)'
    seen = f'count({x}) OVER (PARTITION BY "Ticker" ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
    return f"CASE WHEN {x} IS NOT NULL AND {seen} >= {wait} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {w}, lambda e, v: e * {1 - alpha!r} + v * {alpha!r}) END"


#: Stages and outputs of each function by its arguments, in SQL.
SQL: dict[str, Callable[..., tuple[list[dict[str, str]], dict[str, str]]]] = {}
AHEAD = 'OVER (PARTITION BY "Ticker" ORDER BY "Date" ROWS BETWEEN 1 FOLLOWING AND {} FOLLOWING)'
O, H, L, C, V = ('"Open"', '"High"', '"Low"', '"Close"', '"Volume"')  # noqa: E741


def _target(forward_window: int = 5, lookback_window: int = 20):
    ahead = AHEAD.format(forward_window)
    return [GK, {"f": f"CASE WHEN count(gk) {ahead} = {forward_window} THEN avg(gk) {ahead} END", "b": roll("avg", "gk", lookback_window)}], {"market_movement": "CAST(f > b AS DOUBLE)"}


def _return(name: str):
    return lambda lag: ([{"p": _lag(C, lag)}], {f"{name}_{lag}": f"{div(C, 'p')} - 1"})


def _mean(name: str, out: Callable[[str], str] = lambda m: m, x: str = C):
    return lambda window_size: ([{"m": roll("avg", x, window_size)}], {f"{name}_{window_size}": out("m")})


def _plain(name: str, x: str):
    return lambda: ([], {name: x})


def _bollinger(window_size: int):
    bands = {"upper_distance": div(f"m + 2 * s - {C}", C), "lower_distance": div(f"{C} - (m - 2 * s)", C), "bandwidth": div("4 * s", "m")}
    return [{"m": roll("avg", C, window_size), "s": roll("stddev_samp", C, window_size)}], {f"bollinger_{k}_{window_size}": x for k, x in bands.items()}


def _rsi(window_size: int):
    parts = {"up": "CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END", "dn": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END"}
    smooth = {"g": fold("up", 1 / window_size, window_size), "l": fold("dn", 1 / window_size, window_size)}
    return [C1, {"d": f"{C} - c1"}, parts, smooth], {f"rsi_{window_size}": "CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l = 0 AND g = 0 THEN 50.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END"}


def _drawdown(name: str, deepest: bool = False):
    return lambda window_size: ([{"k": roll("max", C, window_size)}, {"dd": div(f"{C} - k", "k")}], {f"{name}_{window_size}": roll("min", "dd", window_size) if deepest else "dd"})


def _spread(name: str, x: str):
    return lambda window_size: (RET, {f"{name}_{window_size}": roll("stddev_samp", x, window_size)})


def _ratio(name: str, over: str):
    return lambda window_size: ([*RET, {"m": roll("avg", "r", window_size), "s": roll("stddev_samp", "r", window_size)}], {f"{name}_{window_size}": div(over, "s")})


ROOT = {"vol": "CASE WHEN m >= 0 THEN sqrt(m) END"}


def _regime(name: str, x: Callable[[], list], v: str):
    return lambda short_span, long_span: ([*x(), {"a": roll("avg", v, short_span), "b": roll("avg", v, long_span)}], {f"{name}_regime_{short_span}_{long_span}": div("a", "b")})


def _volatility(name: str, x: Callable[[int], list], v: str):
    def out(window_size: int, lag: int = 1):
        return [*x(lag), {"m": roll("avg", v, window_size)}, ROOT], {f"{name}_volatility_{window_size}_lag_{lag}": "vol", f"{name}_vol_of_vol_{window_size}_lag_{lag}": roll("avg", "vol", 20)}

    return out


def _yz_ratio(short_span: int, long_span: int):
    root = lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END"
    return [*yz(1), {"a": roll("avg", "yz", short_span), "b": roll("avg", "yz", long_span)}], {f"yz_volatility_ratio_{short_span}_{long_span}": div(root("a"), root("b"))}


def _ema_gap(short_span: int, long_span: int):
    return [{"a": fold(C, 2 / (short_span + 1), short_span), "b": fold(C, 2 / (long_span + 1), long_span)}], {f"ema{short_span}_minus_ema{long_span}": "a - b"}


def _percentile(window_size: int):
    values = f'list("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date" ROWS BETWEEN {window_size - 1} PRECEDING AND CURRENT ROW)'
    share = f"(len(list_filter(a, lambda v: v < {C})) + (len(list_filter(a, lambda v: v = {C})) + 1) / 2) / {window_size}"
    return [{"a": values}], {f"vix_percentile_{window_size}": f"CASE WHEN len(a) = {window_size} THEN {share} END"}


SQL |= {
    "market_movement_target": _target,
    "close_lag": lambda lag: ([], {f"close_lag_{lag}": _lag(C, lag)}),
    "momentum": lambda lag: ([], {f"momentum_{lag}": f"{C} - {_lag(C, lag)}"}),
    "lag_return": _return("return_lag"),
    "spy_lag_return": _return("spy_lag_return"),
    "vix_lag_return": _return("vix_return_lag"),
    "log_return_lag": lambda lag: ([{"p": _lag(C, lag)}], {f"log_return_lag_{lag}": ln(div(C, "p"))}),
    "simple_moving_average": _mean("SMA"),
    "vix_sma": _mean("vix_SMA"),
    "distance_from_sma": _mean("distance_close_vs_SMA", lambda m: div(f"{C} - {m}", m)),
    "log_distance_from_sma": _mean("log_distance_close_vs_SMA", lambda m: ln(div(C, m))),
    "spy_sma_ratio": _mean("spy_sma_ratio", lambda m: div(C, m)),
    "volume_sma": _mean("volume_sma", x=V),
    "relative_volume": _mean("relative_volume", lambda m: div(V, m), V),
    "ema": lambda window_size: ([], {f"ema_{window_size}": fold(C, 2 / (window_size + 1), window_size)}),
    "ema_crossover": _ema_gap,
    "simple_return_volatility": _spread("simple_return_volatility", "r"),
    "log_return_volatility": _spread("log_return_volatility", "lr"),
    "spy_volatility": _spread("spy_volatility", "r"),
    "bollinger_bands": _bollinger,
    "rsi": _rsi,
    "daily_range": _plain("daily_range", f"{H} - {L}"),
    "range_percentage": _plain("range_percentage", div(f"{H} - {L}", C)),
    "candle_body": _plain("candle_body", f"{C} - {O}"),
    "body_percentage": _plain("body_percentage", div(f"{C} - {O}", O)),
    "upper_shadow": _plain("upper_shadow", f"{H} - greatest({O}, {C})"),
    "lower_shadow": _plain("lower_shadow", f"least({O}, {C}) - {L}"),
    "upper_shadow_percentage": _plain("upper_shadow_pct", div(f"{H} - greatest({O}, {C})", C)),
    "lower_shadow_percentage": _plain("lower_shadow_pct", div(f"least({O}, {C}) - {L}", C)),
    "volume_pct_change": lambda lag: ([{"p": _lag(V, lag)}], {f"volume_pct_change_{lag}": div(f"{V} - p", "p")}),
    "return_x_volume": lambda: ([C1], {"return_x_volume": f"{V} * ({C} - c1)"}),
    "drawdown": _drawdown("drawdown"),
    "spy_drawdown": _drawdown("spy_drawdown"),
    "rolling_window_mdd": _drawdown("rolling_window_mdd", True),
    "rolling_sharpe_ratio": _ratio("sharpe", "m"),
    "spy_return_zscore": _ratio("spy_return_zscore", "r - m"),
    "dates": lambda: ([], {"day_of_week": "strftime(\"Date\", '%A')", "month": "strftime(\"Date\", '%m')"}),
    "yang_zhang_variance": lambda lag: (yz(lag), {f"yz_variance_lag_{lag}": "yz"}),
    "yang_zhang_variance_rolling_mean": lambda lag, window_size: (yz(lag), {f"yz_variance_mean_{window_size}_lag_{lag}": roll("avg", "yz", window_size)}),
    "yang_zhang_regime": _regime("yz", lambda: yz(1), "yz"),
    "yang_zhang_volatility": _volatility("yz", yz, "yz"),
    "yang_zhang_volatility_ratio": _yz_ratio,
    "yang_zhang_volatilitys": lambda lag, window_size: ([*yz(lag), {"m": roll("avg", "yz", window_size)}, ROOT], {f"yz_variance_lag_{lag}": "yz", f"yz_variance_mean_{window_size}_lag_{lag}": "m", f"yz_volatility_{window_size}_lag_{lag}": "vol"}),
    "vix_level": _plain("vix_level", C),
    "vix_percentile": _percentile,
}
for _x, _family, _mean_name, _own, _short in ((GK, "garman_klass", "gk", "gk", "gk"), (PK, "parkinson", "parkinson", "parkinson", "parkinson"), (RS, "rogers_satchell", "rogers_satchell", "rogers_satchell", "rs")):
    _v = next(iter(_x))
    _lagged = lambda k, x=_x, v=_v: [x, {"lagged": _lag(v, k)}]
    SQL[f"{_family}_variance"] = lambda lag, f=_lagged, o=_own: (f(lag), {f"{o}_variance_lag_{lag}": "lagged"})
    SQL[f"{_mean_name}_variance_rolling_mean"] = lambda window_size, lag, f=_lagged, s=_short: (f(lag), {f"{s}_variance_mean_{window_size}_lag_{lag}": roll("avg", "lagged", window_size)})
    SQL[f"{_mean_name}_regime"] = _regime(_short, lambda f=_lagged: f(1), "lagged")
    SQL[f"{_family}_volatility"] = _volatility(_short, _lagged, "lagged")

#: Decimals to compare at where six are too many for the size of the values; None for values that are exact.
DIGITS = {"market_movement": None, "close_lag": None, "momentum": None, "daily_range": None, "candle_body": None, "upper_shadow": None, "lower_shadow": None, "return_x_volume": None, "day_of_week": None, "month": None,
          "vix_level": None, "SMA": 4, "vix_SMA": 4, "ema": 4, "rsi": 5}


def digits_of(column: str) -> int | None:
    if column in DIGITS:
        return DIGITS[column]
    name = re.sub(r"(_?\d+)+(_lag_\d+)?$", "", column)
    return 4 if column.startswith("ema") else DIGITS.get(name, 6)


def _parts(spec: dict) -> tuple[list[dict[str, str]], dict[str, str]]:
    name = spec["function"].removeprefix("create_").replace("_features", "s").removesuffix("_feature")
    name = {"bollinger_bandss": "bollinger_bands"}.get(name, name)
    return SQL[name](**(spec.get("kwargs") or {}))


def sql_of(spec: dict, table: str = "bars", known: bool = False) -> str:
    """The function's SQL; `known`: the table is a view that stands already."""
    stages, outputs = _parts(spec)
    return staged(stages, {c: (x, digits_of(c)) for c, x in outputs.items()}, table, known)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to the decimals at which they are compared."""
    return df.select(*[F.round(c, digits_of(c)).alias(c) if t == "double" and digits_of(c) is not None else F.col(c) for c, t in df.dtypes])


def _query(key: str, function: str, table: str = "bars", **kwargs) -> None:
    spec = {"function": f"create_{function}", "kwargs": kwargs}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(compile_features([spec]).apply(SOURCES[table](spark, sf_dir), ("Ticker", "Date")))

    QUERIES[key] = run
    ORACLE_SQL[key] = sql_of(spec, table)


_query("f01_market_movement", "market_movement_target")
_query("f02_close_lag", "close_lag_feature", lag=3)
_query("f03_momentum", "momentum_feature", lag=10)
_query("f04_return_lag", "lag_return_feature", lag=2)
_query("f05_log_return_lag", "log_return_lag_feature", lag=5)
_query("f06_sma", "simple_moving_average_feature", window_size=20)
_query("f07_distance_sma", "distance_from_sma_feature", window_size=20)
_query("f08_log_distance_sma", "log_distance_from_sma_feature", window_size=20)
_query("f09_ema", "ema_feature", window_size=5)
_query("f10_ema_crossover", "ema_crossover_feature", short_span=5, long_span=20)
_query("f11_return_volatility", "simple_return_volatility_feature", window_size=10)
_query("f12_log_return_volatility", "log_return_volatility_feature", window_size=10)
_query("f13_bollinger", "bollinger_bands_features", window_size=20)
_query("f14_rsi", "rsi_feature", window_size=14)
for _key, _name, _table in (
    ("f15_daily_range", "daily_range", "bars"), ("f16_range_percentage", "range_percentage", "bars_evt"), ("f17_candle_body", "candle_body", "bars"), ("f18_body_percentage", "body_percentage", "bars_evt"),
    ("f19_upper_shadow", "upper_shadow", "bars"), ("f20_lower_shadow", "lower_shadow", "bars"), ("f21_upper_shadow_pct", "upper_shadow_percentage", "bars"), ("f22_lower_shadow_pct", "lower_shadow_percentage", "bars"),
):
    _query(_key, f"{_name}_feature", _table)
_query("f23_volume_pct_change", "volume_pct_change_feature", lag=1)
_query("f24_volume_sma", "volume_sma_feature", window_size=20)
_query("f25_relative_volume", "relative_volume_feature", window_size=5)
_query("f26_return_x_volume", "return_x_volume_feature")
_query("f27_drawdown", "drawdown_feature", window_size=20)
_query("f28_rolling_mdd", "rolling_window_mdd_feature", window_size=20)
_query("f29_sharpe", "rolling_sharpe_ratio_feature", window_size=10)
_query("f30_date_features", "date_features")
for _i, _family, _mean_name, _short in ((31, "garman_klass", "gk", "gk"), (34, "parkinson", "parkinson", "parkinson"), (38, "rogers_satchell", "rogers_satchell", "rs")):
    _query(f"f{_i}_{_short}_variance", f"{_family}_variance_feature", lag=5)
    _query(f"f{_i + 1}_{_short}_variance_mean", f"{_mean_name}_variance_rolling_mean_feature", window_size=10, lag=2)
    _query(f"f{_i + 2}_{_short}_regime", f"{_mean_name}_regime_feature", short_span=5, long_span=20)
    if _family != "garman_klass":
        _query(f"f{_i + 3}_{_short}_volatility", f"{_family}_volatility_feature", window_size=10, lag=1)
_query("f42_yz_variance", "yang_zhang_variance_feature", lag=2)
_query("f43_yz_variance_mean", "yang_zhang_variance_rolling_mean_feature", lag=1, window_size=5)
_query("f44_yz_regime", "yang_zhang_regime_feature", short_span=5, long_span=20)
_query("f45_yz_volatility", "yang_zhang_volatility_feature", lag=1, window_size=5)
_query("f46_yz_volatility_ratio", "yang_zhang_volatility_ratio_feature", short_span=12, long_span=26)
_query("f47_yz_all", "yang_zhang_volatility_features", lag=1, window_size=10)
_query("f48_spy_return", "spy_lag_return_feature", "spy", lag=5)
_query("f49_spy_volatility", "spy_volatility_feature", "spy", window_size=20)
_query("f50_spy_drawdown", "spy_drawdown_feature", "spy", window_size=252)
_query("f51_spy_sma_ratio", "spy_sma_ratio_feature", "spy", window_size=50)
_query("f52_spy_zscore", "spy_return_zscore_feature", "spy", window_size=252)
_query("f53_vix_level", "vix_level_feature", "vix")
_query("f54_vix_return", "vix_lag_return_feature", "vix", lag=20)
_query("f55_vix_sma", "vix_sma_feature", "vix", window_size=60)
_query("f56_vix_percentile", "vix_percentile_feature", "vix", window_size=252)


# the merged frames of the three models, from the features of all three series


def _frame(key: str, model: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(model_frame(B.stock_bars(spark, sf_dir), B.spy_bars(spark, sf_dir), B.vix_bars(spark, sf_dir), model))

    wanted = P.PROJECTIONS[model]
    parts, joins, columns = [], [], {"Date": '"bars"."Date"', "Ticker": '"bars"."Ticker"'}
    for table, specs in (("bars", P.STOCK_FEATURES), ("spy", P.SPY_FEATURES), ("vix", P.VIX_FEATURES)):
        for spec in specs:
            made = [c for c in _parts(spec)[1] if c in wanted]
            if made:
                name = f"x{len(parts)}"
                parts.append(f"{name} AS ({sql_of(spec, table, known=True)})")
                joins.append(f'LEFT JOIN {name} ON {name}."Date" = "bars"."Date"' + f' AND {name}."Ticker" = "bars"."Ticker"' * (table == "bars"))
                columns |= {c: f'{name}."{c}"' for c in made}
    views = [f"{t} AS MATERIALIZED ({BARS[t]})" for t in ("bars", "spy", "vix")]
    shown = ", ".join(f'{columns[c]} AS "{c}"' for c in ("Date", *wanted))
    QUERIES[key] = run
    ORACLE_SQL[key] = f"WITH {', '.join([*views, *parts])} SELECT {shown} FROM bars {' '.join(joins)}"


_frame("p02_lr_frame", "lr")
_frame("p03_xgb_frame", "xgb")
_frame("p04_mlp_frame", "mlp")
