"""Queries of what goes through a store, of loading at serving and of checks that frames' schemas answer, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import inference, ingest, validate
from barwright.scratch import shared_dir
from barwright.sources import bars as B
from barwright.sources.store import Store, datasets

from .tables import oracle, query


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _twice(bars: DataFrame, insert) -> None:
    """Bars before 1996, then all bars with other prices: those of the first load stay as they are."""
    insert(bars.where("Date < '1996-01-01'"))
    insert(bars.withColumn("Close", F.col("Close") + 1))


_KEPT = 'SELECT "Date", "Ticker", "Open", "High", "Low", CASE WHEN "Date" < DATE \'1996-01-01\' THEN "Close" ELSE "Close" + 1 END AS "Close", "Volume" FROM {0}'


@query
def s06_insert_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    _twice(B.stock_bars(spark, sf_dir), store.insert_stock_data)
    return store.read("stock_data")


oracle("s06_insert_stocks", _KEPT.format("bars"), "bars")


@query
def s07_insert_spy(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    _twice(B.spy_bars(spark, sf_dir), store.insert_spy_data)
    return store.read("spy_data")


oracle("s07_insert_spy", _KEPT.format("spy"), "spy")


@query
def s08_insert_vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    _twice(B.vix_bars(spark, sf_dir), store.insert_vix_data)
    return store.read("vix_data")


oracle("s08_insert_vix", _KEPT.format("vix"), "vix")


@query
def s09_save_and_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, then read as a range: only files of those years are looked at."""
    store = _store(spark)
    store.insert_stock_data(B.stock_bars(spark, sf_dir))
    return B.between(store.read("stock_data", "1995-05-01", "1996-04-30"), "1995-05-01", "1996-04-30", ["A", "N"])


oracle("s09_save_and_get", """SELECT * FROM bars WHERE "Date" BETWEEN DATE '1995-05-01' AND DATE '1996-04-30' AND "Ticker" IN ('A', 'N')""", "bars")


@query
def s10_prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction a bar, logged in two appends: ids are all different, times are there."""
    store, bars = _store(spark), B.stock_bars(spark, sf_dir)
    scored = bars.select(F.col("Ticker").alias("ticker"), (F.col("Close") > F.col("Open")).cast("int").alias("prediction"), F.lit(0.5).alias("probability"), F.lit("m").alias("model_name"), F.year("Date").alias("model_version"))
    for part in ("model_version < 1995", "model_version >= 1995"):
        store.log_predictions(scored.where(part))
    logs = store.read("prediction_logs")
    return logs.groupBy("ticker", "prediction", "model_version").agg(F.count_distinct("prediction_id").alias("ids"), F.count("timestamp").alias("times"), F.count("correct").alias("known"))


oracle("s10_prediction_log", """SELECT "Ticker" AS ticker, CAST("Close" > "Open" AS SMALLINT) AS prediction, CAST(year("Date") AS INTEGER) AS model_version,
    count(*) AS ids, count(*) AS times, CAST(0 AS BIGINT) AS known FROM bars GROUP BY ALL""", "bars")  # fmt: skip


@query
def s12_created_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables created, bars put into two of them: names (S13), columns and rows."""
    store = _store(spark)
    store.create_schemas()
    store.insert_stock_data(B.stock_bars(spark, sf_dir))
    store.insert_vix_data(B.vix_bars(spark, sf_dir))
    parts = [store.read(name).agg(F.lit(name).alias("name"), F.lit(len(store.read(name).columns)).alias("columns"), F.count(F.lit(1)).alias("rows")) for name in store.tables() if name.endswith("_data") or name == "prediction_logs"]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


oracle("s12_created_tables", """SELECT 'stock_data' AS name, 7 AS columns, count(*) AS rows FROM bars UNION ALL SELECT 'vix_data', 7, count(*) FROM vix
    UNION ALL SELECT 'spy_data', 7, 0 UNION ALL SELECT 'prediction_logs', 10, 0""", "bars", "vix")  # fmt: skip


@query
def s15_named_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written to a named data set, read by name, and written to that of the next layer."""
    paths = datasets(f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}")
    B.stock_bars(spark, sf_dir).write.parquet(paths["stock_data"])
    validate.validate_and_store(spark.read.parquet(paths["stock_data"]), lambda df: df.write.parquet(paths["validated_stock_data"]) or spark.read.parquet(paths["validated_stock_data"]), tickers=["A", "N", "R"], max_gap_days=60)
    return spark.read.parquet(paths["validated_stock_data"])


oracle("s15_named_datasets", "SELECT * FROM bars", "bars")


def _source(bars: DataFrame) -> B.Source:
    return lambda tickers, start, end: bars.where(F.col("Ticker").isin(list(tickers)) & (F.col("Date") >= start) & (F.col("Date") < end))


@query
def i09_best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that has nothing before 1995 and says so: the stored bars stay, the later ones are filled in."""
    bars = B.stock_bars(spark, sf_dir)

    def source(tickers, start: str, end: str) -> DataFrame:
        if start < "1995":
            raise ValueError("nothing there")
        return _source(bars)(tickers, start, end)

    return ingest.fill(bars.where("Date between '1995-01-01' and '1996-01-01'"), source, ["A", "N"], "1993-01-01", "1997-06-01")


oracle("i09_best_effort", """SELECT * FROM bars WHERE "Ticker" IN ('A', 'N') AND "Date" >= DATE '1995-01-01' AND "Date" < DATE '1997-06-01'""", "bars")


@query
def i10_fill_spy(spark: SparkSession, sf_dir: str) -> DataFrame:
    spy = B.spy_bars(spark, sf_dir)
    return ingest.fill(spy.where("Date between '1994-03-01' and '1995-01-01'"), _source(spy), ["SPY"], "1993-01-01", "1996-01-01", ("Date",))


oracle("i10_fill_spy", """SELECT * FROM spy WHERE "Date" >= DATE '1993-01-01' AND "Date" < DATE '1996-01-01'""", "spy")


@query
def i11_fill_vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day before the first stored one is fetched too."""
    vix = B.vix_bars(spark, sf_dir)
    return ingest.fill(vix.where("Date between '1994-03-02' and '1995-01-01'"), _source(vix), ["^VIX"], "1994-03-01", "1995-02-01", ("Date",))


oracle("i11_fill_vix", """SELECT * FROM vix WHERE "Date" >= DATE '1994-03-01' AND "Date" < DATE '1995-02-01'""", "vix")


@query
def i12_serving_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.stock_bars(spark, sf_dir)
    return ingest.serving_window(bars.where("Date < '1996-01-01'"), _source(bars), "a", 500, dt.date(1996, 6, 30))


oracle("i12_serving_window", """SELECT * FROM bars WHERE "Ticker" = 'A' AND "Date" > DATE '1996-07-01' - INTERVAL 501 DAY AND "Date" <= DATE '1996-06-30'""", "bars")


@query
def p17_known_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.stock_bars(spark, sf_dir).withColumn("Ticker", F.when(F.dayofmonth("Date") == 1, F.lower("Ticker")).otherwise(F.col("Ticker")))
    return rows.groupBy("Ticker").agg(F.count(F.lit(1)).alias("bars")).withColumn("known", inference.known_ticker(F.col("Ticker"), ["A", "R"]))


oracle("p17_known_tickers", """SELECT t AS "Ticker", count(*) AS bars, upper(t) IN ('A', 'R') AS known
    FROM (SELECT CASE WHEN day("Date") = 1 THEN lower("Ticker") ELSE "Ticker" END AS t FROM bars) GROUP BY ALL""", "bars")  # fmt: skip


@query
def a06_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers that aren't expected, and the first five dates after a day that is taken for today."""
    bars = B.stock_bars(spark, sf_dir)
    future = validate.future_dates(bars, today=F.lit("1997-03-04").cast("date")).select(F.lit("future date").alias("kind"), F.col("Date").cast("string").alias("value"))
    return validate.strange_tickers(bars, ["N"]).select(F.lit("unexpected ticker").alias("kind"), F.col("Ticker").alias("value")).unionByName(future)


oracle("a06_distinct", """SELECT DISTINCT 'unexpected ticker' AS kind, "Ticker" AS value FROM bars WHERE "Ticker" <> 'N'
    UNION ALL SELECT 'future date', CAST(d AS VARCHAR) FROM (SELECT DISTINCT "Date" AS d FROM bars WHERE "Date" > DATE '1997-03-04' ORDER BY 1 LIMIT 5)""", "bars")  # fmt: skip


@query
def o01_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns (V2) that the table of trades hasn't got."""
    required = ["l_orderkey", "Volume", "Date", "l_shipdate", "Close"]
    return spark.createDataFrame([(c,) for c in validate.missing_columns(B.table(spark, sf_dir, "lineitem"), required)], "name string")


oracle("o01_missing_columns", "SELECT unnest(['l_orderkey', 'Volume', 'Date', 'l_shipdate', 'Close']) AS name EXCEPT SELECT column_name FROM (DESCRIBE lineitem)")


@query
def v04_type_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of type of every column of the table of trades."""
    rows = validate.type_classes(B.table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(c, k) for c, kinds in rows.items() for k in kinds], "name string, kind string")


oracle("v04_type_classes", """SELECT column_name AS name, unnest(CASE WHEN regexp_matches(column_type, '^(BIGINT|INTEGER|SMALLINT|TINYINT)') THEN ['numeric', 'integer']
    WHEN regexp_matches(column_type, '^(DOUBLE|FLOAT|DECIMAL)') THEN ['numeric'] WHEN regexp_matches(column_type, '^(DATE|TIMESTAMP)') THEN ['datetime'] ELSE ['string'] END) AS kind
    FROM (DESCRIBE lineitem)""")  # fmt: skip


@query
def v09_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all checks together say of bars, a year at a time: each year's first error, with the rules of 1994."""
    bars, years, out = B.stock_bars(spark, sf_dir), range(1993, 1997), []
    for year in (1980, *years):
        rows = bars.where(F.year("Date") == year)
        rows = rows.unionByName(rows.where("month(Date) = 6 and Ticker = 'A'")) if year == 1995 else rows
        try:
            validate.data_validation(rows, tickers=["A", "N", "R"], start_date="1994-01-01", end_date="1994-12-31", max_gap_days=100)
            out.append((year, "good"))
        except ValueError as e:
            out.append((year, " ".join(str(e).split()[:2])))
    return spark.createDataFrame(out, "year int, outcome string")


oracle("v09_outcomes", """, y AS (SELECT unnest([1980, 1993, 1994, 1995, 1996])::INTEGER AS year), n AS (
        SELECT y.year, count("Date") AS n, count(*) FILTER (WHERE y.year = 1995 AND month("Date") = 6 AND "Ticker" = 'A') AS again, min("Date") AS lo, max("Date") AS hi
        FROM y LEFT JOIN bars ON year("Date") = y.year GROUP BY 1)
    SELECT year, CASE WHEN n = 0 THEN 'the frame' WHEN again > 0 THEN 'rows with' WHEN lo < DATE '1994-01-01' THEN 'dates before' WHEN hi > DATE '1994-12-31' THEN 'dates after' ELSE 'good' END AS outcome
    FROM n""", "bars")  # fmt: skip
