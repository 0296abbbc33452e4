"""Checks of bar frames. Each gives its frame back or raises; `report` counts violations instead."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("Date", "Ticker", "Open", "High", "Low", "Close", "Volume")
TYPES = ("datetime", "string", "numeric", "numeric", "numeric", "numeric", "integer")
OHLCV = ("Open", "High", "Low", "Close", "Volume")
KEY = ("Ticker", "Date")
TOLERANCE = 1e-4
MAX_GAP_DAYS = 10

_KINDS = {"datetime": (T.DateType, T.TimestampType, T.TimestampNTZType), "string": (T.StringType,), "numeric": (T.NumericType,), "integer": (T.IntegralType,)}


def price_rules(ohlcv: Sequence[str] = OHLCV) -> dict[str, Column]:
    """What is wrong with a bar, by rule, in the order in which rules are told."""
    o, h, low, c, v = (F.col(x) for x in ohlcv)
    up, down = 1 + TOLERANCE, 1 - TOLERANCE
    return {
        "open_not_positive": o <= 0,
        "close_not_positive": c <= 0,
        "high_below_open": h < o * down,
        "high_below_close": h < c * down,
        "high_below_low": h < low * down,
        "low_above_open": low > o * up,
        "low_above_close": low > c * up,
        "volume_negative": v < 0,
    }


def _gap(key: Sequence[str]) -> Column:
    """Days since the ticker's bar before."""
    ticker, day = key
    return F.datediff(F.col(day), F.lag(day).over(Window.partitionBy(ticker).orderBy(day)))


def report(df: DataFrame, tickers: Sequence[str] | None = None, start_date: str | None = None, end_date: str | None = None, max_gap_days: int = MAX_GAP_DAYS, today: str | None = None) -> DataFrame:
    """(rule, violations) for every rule. All rules on single rows are one aggregation; keys and gaps need their own."""
    day = F.col("Date").cast("date")
    rules = {f"null_{c}": F.col(c).isNull() for c in COLUMNS} | price_rules()
    rules["in_future"] = day > (F.lit(today).cast("date") if today else F.current_date())
    if start_date:
        rules["before_start"] = day < F.lit(start_date).cast("date")
    if end_date:
        rules["after_end"] = day > F.lit(end_date).cast("date")
    if tickers is not None:
        rules["unknown_ticker"] = ~F.col("Ticker").isin(list(tickers))
    counts = df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")
    repeated = df.groupBy(*KEY).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations")).select(F.lit("repeated_key").alias("rule"), "violations")
    gaps = df.withColumn("gap", _gap(KEY)).agg(F.count_if(F.col("gap") > max_gap_days).alias("violations")).select(F.lit("gap_too_long").alias("rule"), "violations")
    return counts.select(pairs).select("r.*").unionByName(repeated).unionByName(gaps)


def future_dates(df: DataFrame, day: Column | str = "Date", today: Column | None = None, limit: int = 5) -> DataFrame:
    """The first dates after today, each once."""
    day = (F.col(day) if isinstance(day, str) else day).cast("date")
    return df.where(day > (F.current_date() if today is None else today)).select(day.alias("Date")).distinct().orderBy("Date").limit(limit)


def strange_tickers(df: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """The tickers that aren't among these, each once."""
    return df.where(~F.col("Ticker").isin(list(tickers))).select("Ticker").distinct()


def missing_columns(df: DataFrame, required_columns: Sequence[str] | None = None) -> list[str]:
    return sorted(set(required_columns or COLUMNS) - set(df.columns))


def type_classes(df: DataFrame) -> dict[str, list[str]]:
    """The classes of type that each column is of: an integer is a number too."""
    return {f.name: [k for k, types in _KINDS.items() if isinstance(f.dataType, types)] for f in df.schema}


def empty_data_validation(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the frame has no rows")
    return df


def column_existence_validation(df: DataFrame, required_columns: Sequence[str] | None = None) -> DataFrame:
    missing = missing_columns(df, required_columns)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def missing_data_validation(df: DataFrame, required_columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(required_columns or COLUMNS)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    found = {c: row[c] for c in columns if row[c]}
    if found:
        raise ValueError(f"missing values by column: {found}")
    return df


def column_type_validation(df: DataFrame, required_columns: Sequence[str] | None = None, column_types: Sequence[str] | None = None, error_messages: Sequence[str] | None = None) -> DataFrame:
    columns, kinds = list(required_columns or COLUMNS), list(column_types or TYPES)
    messages = list(error_messages) if error_messages is not None else [f"column {c!r} must be of type {k}" for c, k in zip(columns, kinds, strict=False)]
    if not len(columns) == len(kinds) == len(messages):
        raise ValueError("columns, types and messages must be as many")
    for c, kind, message in zip(columns, kinds, messages, strict=True):
        if kind not in _KINDS:
            raise ValueError(f"unknown type {kind!r}; known are {sorted(_KINDS)}")
        if not isinstance(df.schema[c].dataType, _KINDS[kind]):
            raise TypeError(message)
    return df


def duplicate_validation(df: DataFrame, row_id: Sequence[str] | None = None) -> DataFrame:
    key = list(row_id or KEY)
    if len(key) != 2:
        raise ValueError("row_id must name two columns")
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"rows with equal {key}")
    return df


def financial_consistency_validation(df: DataFrame, ohlcv_columns: Sequence[str] | None = None) -> DataFrame:
    names = list(ohlcv_columns or OHLCV)
    if len(names) != 5:
        raise ValueError("five columns are needed: open, high, low, close, volume")
    rules = price_rules(names)
    row = df.agg(*[F.coalesce(F.bool_or(r), F.lit(False)).alias(n) for n, r in rules.items()]).first()
    for n in rules:
        if row[n]:
            raise ValueError(f"inconsistent bars: {n.replace('_', ' ')}")
    return df


def date_validation(df: DataFrame, start_date: str | None = None, end_date: str | None = None, row_id: Sequence[str] | None = None, max_gap_days: int = MAX_GAP_DAYS, order: str | None = None) -> DataFrame:
    """A frame has no order of its own, so that rows are sorted by key is checked only if `order` names a column that
    numbers them."""
    key = list(row_id or KEY)
    if len(key) != 2:
        raise ValueError("row_id must name two columns")
    if order is not None:
        w = Window.orderBy(order)  # a check for small frames that carry their positions
        k = F.struct(*key)
        if not df.select((F.lag(k).over(w) > k).alias("back")).where("back").isEmpty():
            raise ValueError(f"rows are not sorted by {key}")
    day = F.col(key[1]).cast("date")
    future = future_dates(df, day).collect()
    if future:
        raise ValueError(f"dates in the future: {[str(r.Date) for r in future]}")
    lo, hi = df.agg(F.min(day), F.max(day)).first()
    if start_date is not None and lo is not None and lo < date.fromisoformat(str(start_date)[:10]):
        raise ValueError(f"dates before {start_date}")
    if end_date is not None and hi is not None and hi > date.fromisoformat(str(end_date)[:10]):
        raise ValueError(f"dates after {end_date}")
    if not df.select(_gap(key).alias("gap")).where(F.col("gap") > max_gap_days).isEmpty():
        raise ValueError(f"gaps of more than {max_gap_days} days")
    return df


def ticker_validation(df: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    if tickers is None:
        return df
    strange = strange_tickers(df, tickers).orderBy("Ticker").limit(20).collect()
    if strange:
        raise ValueError(f"unexpected tickers: {[r.Ticker for r in strange]}")
    return df


def data_validation(df: DataFrame, required_columns=None, column_types=None, error_messages=None, row_id=None, ohlcv_columns=None, tickers=None, start_date=None, end_date=None, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """All checks, and their first error in this order: rows, columns, nulls, types, keys, prices, dates, tickers. Good bars
    cost two queries: one pass counts what single rows break, one shuffle by ticker finds keys and gaps."""
    return validate_and_store(df, None, required_columns, column_types, error_messages, row_id, ohlcv_columns, tickers, start_date, end_date, max_gap_days)


def validate_and_store(df: DataFrame, store: Callable[[DataFrame], DataFrame] | None, required_columns=None, column_types=None, error_messages=None, row_id=None, ohlcv_columns=None, tickers=None, start_date=None, end_date=None, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """As `data_validation`, with the rows counted while `store` writes them; keys and gaps are looked for in what it gives
    back, which is returned. So the plan of `df` runs once. What is stored is not valid until this returns."""
    columns, key, prices = list(required_columns or COLUMNS), list(row_id or KEY), list(ohlcv_columns or OHLCV)
    broken = lambda check, *more: check(df, *more)  # the single check tells the error in full
    if set(columns) - set(df.columns):
        empty_data_validation(df)
        return broken(column_existence_validation, columns)
    sound = None
    try:
        column_type_validation(df, columns, column_types, error_messages)
    except (TypeError, ValueError) as e:
        sound = e
    counts = {"rows": F.count(F.lit(1))} | {f"null {c}": F.count_if(F.col(c).isNull()) for c in columns}
    usable = sound is None and len(key) == 2 and len(prices) == 5 and {*key, *prices} <= set(df.columns)
    if usable:
        day = F.col(key[1]).cast("date")
        counts |= {f"price {n}": F.count_if(r) for n, r in price_rules(prices).items()}
        counts |= {"future": F.count_if(day > F.current_date()), "first": F.min(day), "last": F.max(day)}
        if tickers is not None:
            counts["strange"] = F.count_if(~F.col("Ticker").isin(list(tickers)))
    wanted = [x.alias(n) for n, x in counts.items()]
    if store:
        seen = Observation()
        df = store(df.observe(seen, *wanted))
        got = seen.get
    else:
        got = df.agg(*wanted).first().asDict()
    if not got["rows"]:
        return broken(empty_data_validation)
    if any(got[f"null {c}"] for c in columns):
        return broken(missing_data_validation, columns)
    if sound is not None:
        raise sound
    if not usable:  # wrong arguments: the checks say which
        broken(duplicate_validation, row_id)
        broken(financial_consistency_validation, ohlcv_columns)
        return broken(date_validation, start_date, end_date, row_id, max_gap_days)
    ordered = Window.partitionBy(key[0]).orderBy(key[1])
    before = F.lag(key[1]).over(ordered)
    again = (F.row_number().over(ordered) > 1) & before.eqNullSafe(F.col(key[1]))
    apart = df.select(again.alias("again"), (F.datediff(F.col(key[1]), before) > max_gap_days).alias("gap")).agg(F.count_if("again").alias("again"), F.count_if("gap").alias("gaps")).first()
    if apart.again:
        return broken(duplicate_validation, key)
    if any(got[f"price {n}"] for n in price_rules(prices)):
        return broken(financial_consistency_validation, prices)
    late = lambda bound, day: bound is not None and day is not None and str(day) > str(bound)[:10]
    early = start_date is not None and got["first"] is not None and str(got["first"]) < str(start_date)[:10]
    if got["future"] or apart.gaps or early or late(end_date, got["last"]):
        return broken(date_validation, start_date, end_date, key, max_gap_days)
    if got.get("strange"):
        return broken(ticker_validation, tickers)
    return df
