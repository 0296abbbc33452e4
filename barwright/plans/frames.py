"""The wide frames that models learn from: features of stocks, joined with those of the two market series."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.scratch import Scratch

from . import parameters as P
from .features import TARGET, add_features

OHLCV = ("Open", "High", "Low", "Close", "Volume")
#: Days of a market series; while there are no more rows than this (a row a day), it is broadcast.
BROADCAST_ROWS = 200_000


def merge_dataframes(stock: DataFrame, spy: DataFrame, vix: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Both market series joined to the stocks by date, rows without a market day kept. A series has one row a day; it is
    written once, both side by side, broadcast while it has no more than `broadcast_rows` (its files know), and else
    joined by sort."""
    out, scratch = stock, Scratch(stock.sparkSession, "market")
    with ThreadPoolExecutor(2) as pool:
        sides = list(pool.map(lambda s: scratch.keep_counted(s[1].drop("Ticker"), s[0]), (("spy", spy), ("vix", vix))))
    for side, rows in sides:
        out = out.join(F.broadcast(side) if rows <= broadcast_rows else side, "Date", "left")
    return out.drop("Repaired?")


def project(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("Date",)) -> DataFrame:
    """The keys that the frame has, and the columns; a column that it hasn't is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*[k for k in keys if k in df.columns and k not in columns], *columns)


def all_features(stock: DataFrame, spy: DataFrame, vix: DataFrame, stock_specs: Iterable[dict] = tuple(P.STOCK_FEATURES), spy_specs: Iterable[dict] = tuple(P.SPY_FEATURES), vix_specs: Iterable[dict] = tuple(P.VIX_FEATURES)) -> DataFrame:
    """Bars to the merged frame. Unused features cost nothing: what a projection doesn't ask for is pruned."""
    return merge_dataframes(add_features(stock, stock_specs, OHLCV), add_features(spy, spy_specs, ("Ticker", *OHLCV)), add_features(vix, vix_specs, ("Ticker", *OHLCV)))


def model_frame(stock: DataFrame, spy: DataFrame, vix: DataFrame, model: str, serving: bool = False) -> DataFrame:
    """The frame of a model (`lr`, `xgb` or `mlp`); for serving, without the answer."""
    if model not in P.PROJECTIONS:
        raise ValueError(f"unknown model type {model!r}; known are {', '.join(P.PROJECTIONS)}")
    specs = [s for s in P.STOCK_FEATURES if not (serving and s["function"] == P.TARGET_FUNCTION)]
    columns = [c for c in P.PROJECTIONS[model] if not (serving and c == TARGET)]
    return project(all_features(stock, spy, vix, specs), columns)
