"""Incremental loading: where to start, what is missing, and inserting only what is not there."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.sources.bars import Source, between


def latest_dates(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Ticker and its latest stored date, for those of the tickers that have any."""
    return bars.where(F.col("Ticker").isin(list(tickers))).groupBy("Ticker").agg(F.max("Date").alias("latest"))


def latest_date(bars: DataFrame) -> DataFrame:
    """One row: the latest date of a single series, null if it is empty."""
    return bars.agg(F.max("Date").alias("latest"))


def stock_start(bars: DataFrame, tickers: Sequence[str], default: str, end: str) -> DataFrame:
    """One row with the first day to load: the day after each ticker's latest (the default if it has none), the least
    of those before `end`; null if every ticker is up to date."""
    spark = bars.sparkSession
    wanted = spark.createDataFrame([(t,) for t in tickers], "Ticker string")
    start = F.coalesce(F.date_add("latest", 1), F.lit(default).cast("date"))
    return wanted.join(latest_dates(bars, tickers), "Ticker", "left").select(start.alias("start")).where(F.col("start") < F.lit(end).cast("date")).agg(F.min("start").alias("start"))


def market_start(spy: DataFrame, vix: DataFrame, default: str, end: str) -> DataFrame:
    """The same for the two market series."""
    each = latest_date(spy).unionByName(latest_date(vix))
    start = each.agg(F.min(F.coalesce(F.date_add("latest", 1), F.lit(default).cast("date"))).alias("start"))
    return start.select(F.when(F.col("start") < F.lit(end).cast("date"), F.col("start")).alias("start"))


def one_series(market: DataFrame, ticker: str) -> DataFrame:
    """The bars of one market ticker; volume null counts as 0."""
    return market.where(F.col("Ticker") == ticker).withColumn("Volume", F.coalesce(F.col("Volume"), F.lit(0)).cast("long"))


def absent(new: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """The new rows whose key is not stored; of new rows with one key the least (maps don't count). A key with nulls
    conflicts with none."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    order = F.struct(*[c for c, t in new.dtypes if "map<" not in t])
    fresh = new.where(whole).join(stored.select(*key), list(key), "left_anti").groupBy(*key).agg(F.min_by(F.struct(*new.columns), order).alias("row"))
    return fresh.select("row.*").unionByName(new.where(~whole))


def missing_days(stored: DataFrame, start: str, end: str) -> DataFrame:
    """Ranges (first, last) of days that lie outside what is stored: from start to the day before the earliest, and
    from the day after the latest to the day before end; all days if nothing is stored."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    have = between(stored, start, end).agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"))
    rows = have.select(
        F.explode(
            F.when(F.col("lo").isNull(), F.array(F.struct(s.alias("first"), F.date_sub(e, 1).alias("last")))).otherwise(
                F.array(F.struct(s.alias("first"), F.date_sub("lo", 1).alias("last")), F.struct(F.date_add("hi", 1).alias("first"), F.date_sub(e, 1).alias("last")))
            )
        ).alias("r")
    )
    return rows.select("r.*").where("first <= last")


def fill(stored: DataFrame, source: Source, tickers: Sequence[str], start: str, end: str, key: Sequence[str] = ("Ticker", "Date")) -> DataFrame:
    """Stored bars from start to the day before end, with what is missing at both sides taken from `source`, a function
    of tickers, first and exclusive last day. A source that has nothing says so with ValueError or an empty frame."""
    mine = stored.where(F.col("Ticker").isin(list(tickers)))
    out = mine
    for first, last in missing_days(mine, start, end).collect():  # two rows at most
        try:
            got = source(tickers, str(first), str(date.fromordinal(last.toordinal() + 1)))
        except ValueError:
            continue
        out = out.unionByName(absent(got.select(stored.columns), out, key))
    return out.where((F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date")))


def serving_window(stored: DataFrame, source: Source, ticker: str, lookback_window: int = 500, today: date | None = None) -> DataFrame:
    """The last `lookback_window` calendar days of a ticker up to today, filled from the source."""
    if not isinstance(ticker, str) or not ticker:
        raise TypeError("ticker must be a name")
    if isinstance(lookback_window, bool) or not isinstance(lookback_window, int) or lookback_window < 1:
        raise ValueError("lookback_window must be a whole number of at least 1")
    end = date.fromordinal((today or date.today()).toordinal() + 1)
    return fill(stored, source, [ticker.upper()], str(date.fromordinal(end.toordinal() - lookback_window)), str(end))
