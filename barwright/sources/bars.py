"""Bars from files: scans by key and date range, and bars built from the trade-like tables at hand."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.functions.guards import no_nan
from barwright.schema import BAR, PRICES

#: Bars of tickers from a first to an exclusive last day, long or wide; what has none gives no rows or ValueError.
Source = Callable[[Sequence[str], str, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(df: DataFrame) -> DataFrame:
    """The seven bar columns, by name in any case, with the types of the schema; NaN becomes null."""
    named = df.toDF(*[c.capitalize() for c in df.columns])
    cast = {f.name: F.col(f.name).cast(f.dataType) for f in BAR}
    return named.select(*[(no_nan(c) if n in PRICES else c).alias(n) for n, c in cast.items()])


def between(bars: DataFrame, start: str | date, end: str | date, tickers: Sequence[str] | None = None) -> DataFrame:
    """Bars from start to end, both included, of the tickers if any are named. The filters reach the scan."""
    if str(start) > str(end):
        raise ValueError(f"start {start} is after end {end}")
    out = bars.where(F.col("Date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    return out if tickers is None else out.where(F.col("Ticker").isin([t.upper() for t in tickers]))


def in_order(bars: DataFrame) -> DataFrame:
    """Bars by ticker, then date: for what is read from the first row to the last, as a sink; windows order their own rows."""
    return bars.orderBy("Ticker", "Date")


def build(trades: DataFrame, ticker: Column, day: Column, price: Column, order: Sequence[Column | str], volume: Column) -> DataFrame:
    """Daily bars: the first, greatest, least and last price of a day, and its volume.

    One aggregation with partial sums on the map side, so a ticker with most trades sends a row per task and day.
    """
    t = trades.select(ticker.alias("Ticker"), day.cast("date").alias("Date"), price.alias("p"), F.struct(*order).alias("k"), volume.alias("v"))
    return t.groupBy("Ticker", "Date").agg(
        F.min_by("p", "k").alias("Open"),
        F.max("p").alias("High"),
        F.min("p").alias("Low"),
        F.max_by("p", "k").alias("Close"),
        F.sum("v").cast("long").alias("Volume"),
    ).select("Date", "Ticker", *PRICES, "Volume")


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers are return flags, days ship dates, prices those of one piece."""
    return build(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), LINE_ORDER, F.col("l_quantity"))


def spy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(table(spark, sf_dir, "lineitem"), F.lit("SPY"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), LINE_ORDER, F.col("l_quantity"))


def vix_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(table(spark, sf_dir, "orders"), F.lit("^VIX"), F.col("o_orderdate"), F.col("o_totalprice"), ("o_orderkey",), F.lit(0))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"), F.col("value"), ("ts", "event_id"), F.lit(1))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both market series in one frame, as a market download gives them."""
    return spy_bars(spark, sf_dir).unionByName(vix_bars(spark, sf_dir))


def wide(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """One row a day, with columns `Ticker|Field`, as wide downloads come."""
    aggs = [F.max(F.when(F.col("Ticker") == t, F.col(f))).alias(f"{t}|{f}") for t in tickers for f in (*PRICES, "Volume")]
    return bars.where(F.col("Ticker").isin(list(tickers))).groupBy("Date").agg(*aggs)


def long(wide_bars: DataFrame, ticker: str | None = None) -> DataFrame:
    """Bars from a wide frame with columns `Ticker|Field` (or plain fields of one ticker); days without any price go."""
    fields = (*PRICES, "Volume")
    if ticker is not None:
        return wide_bars.select("Date", F.lit(ticker).alias("Ticker"), *fields)
    tickers = list(dict.fromkeys(c.rpartition("|")[0] for c in wide_bars.columns if "|" in c))
    each = F.array(*[F.struct(F.lit(t).alias("Ticker"), *[F.col(f"`{t}|{f}`").alias(f) for f in fields]) for t in tickers])
    out = wide_bars.select("Date", F.explode(each).alias("bar")).select("Date", "bar.*")
    return out.where(F.coalesce(*PRICES).isNotNull())


def parquet_source(spark: SparkSession, path: str) -> Source:
    """A source over a table of bars."""

    def read(tickers: Sequence[str], start: str, end: str) -> DataFrame:
        bars = normalise(spark.read.parquet(path)).where(F.col("Ticker").isin(list(tickers)))
        return bars.where((F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date")))

    return read


def _no_bars() -> DataFrame:
    return SparkSession.active().createDataFrame([], BAR)


def _shaped(df: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """The seven columns from any layout: long, `Ticker|Field`, or the plain fields of one ticker."""
    if any("|" in c for c in df.columns):
        df = long(df)
    elif "ticker" not in [c.lower() for c in df.columns]:
        df = long(normalise_fields(df), tickers[0])
    return normalise(df)


def normalise_fields(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.capitalize() for c in df.columns])


def download_ohlcv_data(source: Source, tickers: Sequence[str], start_date: str, end_date: str) -> DataFrame:
    """Bars of the tickers (in capitals) from the source. An empty start means that nothing is missing and gives no rows; a
    source without rows is an error. A frame has no order, so none is given: whoever stores it sorts it."""
    if start_date == "":
        return _no_bars()
    if not tickers:
        raise ValueError("tickers must not be empty")
    if not all(isinstance(t, str) for t in tickers):
        raise TypeError("tickers must be names")
    if start_date >= end_date:
        raise ValueError(f"start {start_date} must be before end {end_date}")
    names = [t.upper() for t in tickers]
    got = _shaped(source(names, start_date, end_date), names)
    if got.isEmpty():
        raise ValueError(f"the source has no bars of {', '.join(names)} from {start_date} to {end_date}")
    return got


def download_market_data(source: Source, start_date: str, end_date: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """The market series, by default both; no rows where the start is empty or the source has none."""
    if start_date == "":
        return _no_bars()
    names = list(tickers or ("SPY", "^VIX"))
    return _shaped(source(names, start_date, end_date), names)
