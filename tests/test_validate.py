"""One broken cell for each rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.operators import validate as V
from barwright.schema import BAR


@pytest.fixture(scope="module")
def good(spark):
    rows = [(dt.date(2024, 1, d), t, p, p + 2, p - 1, p + 1, 1000 + d) for t, p in (("AAPL", 150.0), ("MSFT", 300.0)) for d in range(1, 6)]
    return spark.createDataFrame(rows, BAR)


def broken(df, column, value):
    here = (F.col("Ticker") == "AAPL") & (F.dayofmonth("Date") == 3)
    return df.withColumn(column, F.when(here, value).otherwise(F.col(column)))


def test_good_bars_pass(good):
    assert V.data_validation(good, tickers=["AAPL", "MSFT"], start_date="2024-01-01", end_date="2024-01-31", row_id=("Ticker", "Date")) is good


@pytest.mark.parametrize(
    ("column", "value", "rule"),
    [("Open", 0.0, "open not positive"), ("Close", -1.0, "close not positive"), ("High", 140.0, "high below open"), ("High", 150.5, "high below close"), ("Low", 150.6, "low above open"), ("Volume", -1, "volume negative")],
)
def test_price_rules(good, column, value, rule):
    with pytest.raises(ValueError, match=rule):
        V.financial_consistency_validation(broken(good, column, F.lit(value)))


def test_tolerance(good):
    V.financial_consistency_validation(broken(good, "High", F.lit(151.0 * (1 - 0.5e-4))))


def test_the_other_checks(good, spark):
    with pytest.raises(ValueError, match="no rows"):
        V.empty_data_validation(good.where("false"))
    with pytest.raises(ValueError, match=r"\['Close', 'Low'\]"):
        V.column_existence_validation(good.drop("Low", "Close"))
    with pytest.raises(ValueError, match="'Open': 1"):
        V.missing_data_validation(broken(good, "Open", F.lit(None)))
    with pytest.raises(TypeError, match="Volume"):
        V.column_type_validation(good.withColumn("Volume", F.lit("x")))
    with pytest.raises(ValueError, match="as many"):
        V.column_type_validation(good, ["Date"], ["datetime", "string"], ["a"])
    with pytest.raises(ValueError, match="unknown type"):
        V.column_type_validation(good, ["Date"], ["odd"], ["a"])
    with pytest.raises(ValueError, match="equal"):
        V.duplicate_validation(good.unionByName(good.limit(1)))
    with pytest.raises(ValueError, match="two columns"):
        V.duplicate_validation(good, ["Ticker"])
    with pytest.raises(ValueError, match="five"):
        V.financial_consistency_validation(good, ["Open"])
    with pytest.raises(ValueError, match="AAPL"):
        V.ticker_validation(good, ["MSFT"])


def test_dates(good):
    with pytest.raises(ValueError, match="future"):
        V.date_validation(broken(good, "Date", F.date_add(F.current_date(), 5)))
    with pytest.raises(ValueError, match="before"):
        V.date_validation(good, start_date="2024-01-02")
    with pytest.raises(ValueError, match="after"):
        V.date_validation(good, end_date="2024-01-04")
    with pytest.raises(ValueError, match="gaps"):
        V.date_validation(good.where("day(Date) != 3"), max_gap_days=1)
    numbered = good.withColumn("i", F.when(F.col("Ticker") == "AAPL", F.dayofmonth("Date")).otherwise(F.dayofmonth("Date") + 5))
    V.date_validation(numbered, order="i")
    with pytest.raises(ValueError, match="sorted"):
        V.date_validation(numbered.withColumn("i", -F.col("i")), order="i")


def test_report_counts(good):
    bad = broken(broken(good, "Volume", F.lit(-5)), "Close", F.lit(None))
    got = {r.rule: r.violations for r in V.report(bad.unionByName(bad.where("Ticker = 'MSFT'")), ["AAPL"]).collect()}
    assert got["volume_negative"] == 1 and got["null_Close"] == 1 and got["repeated_key"] == 5 and got["unknown_ticker"] == 10 and got["gap_too_long"] == 0


ORDER = [
    ("no rows", lambda df: df.where("false")),
    ("missing columns", lambda df: df.drop("Low")),
    ("'Open': 1", lambda df: broken(df, "Open", F.lit(None))),
    ("Volume", lambda df: df.withColumn("Volume", F.lit("x"))),
    ("rows with equal", lambda df: df.unionByName(df.limit(1))),
    ("open not positive", lambda df: broken(df, "Open", F.lit(-1.0))),
    ("future", lambda df: df.withColumn("Date", F.date_add("Date", 40_000))),
    ("dates before", lambda df: df.withColumn("Date", F.date_sub("Date", 300))),
    ("dates after", lambda df: df.withColumn("Date", F.date_add("Date", 300))),
    ("gaps of more", lambda df: df.unionByName(df.withColumn("Date", F.date_add("Date", 20)))),
    ("unexpected tickers", lambda df: df.withColumn("Ticker", F.lower("Ticker"))),
]
RULES = {"tickers": ["AAPL", "MSFT"], "start_date": "2024-01-01", "end_date": "2024-01-31", "max_gap_days": 10}


@pytest.mark.parametrize("match", [m for m, _ in ORDER])
def test_every_error_is_told_by_the_fused_checks(good, match):
    with pytest.raises((ValueError, TypeError), match=match):
        V.data_validation(dict(ORDER)[match](good), **RULES)


def test_the_first_error_in_order_is_told(good):
    both = lambda a, b: dict(ORDER)[b](dict(ORDER)[a](good))
    for a, b in (("'Open': 1", "rows with equal"), ("rows with equal", "open not positive"), ("open not positive", "dates before"), ("dates before", "unexpected tickers"), ("'Open': 1", "Volume"), ("Volume", "unexpected tickers")):
        with pytest.raises((ValueError, TypeError), match=a):
            V.data_validation(both(a, b), **RULES)


def test_good_bars_cost_two_queries_and_one_run_of_their_plan(good, spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(x):
        asked.add(1)
        return float(x)

    def store(df):
        df.write.parquet(f"{tmp_path}/valid")
        return spark.read.parquet(f"{tmp_path}/valid")

    done = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = done()
    V.data_validation(good, **RULES)
    assert done() - before <= 2
    before = done()
    kept = V.validate_and_store(good.withColumn("Close", price("Close")), store, **RULES)
    assert done() - before <= 2 and asked.value == 10 == kept.count()
