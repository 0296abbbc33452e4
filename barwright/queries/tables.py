"""Queries of scans, loading, joins, checks, splits, metrics, selection and serving, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import inference, ingest, metrics, prepare, selection, train, validate
from barwright.operators.quantiles import sketches
from barwright.plans import frames
from barwright.plans.features import add_features
from barwright.schema import PRICES
from barwright.scratch import Scratch, shared_dir
from barwright.sources import bars as B
from barwright.sources.store import newest
from barwright.streaming import bars as S
from barwright.streaming import smoothing

from .features import sql_of as feature_sql
from .sql import BARS, div, lag, roll, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = f
    return f


def oracle(name: str, sql: str, *tables: str) -> None:
    """SQL over bar views, which are put in front."""
    views = ", ".join(f"{t} AS ({BARS[t]})" for t in tables)
    ORACLE_SQL[name] = (f"WITH {views}{sql}" if sql.startswith(",") else f"WITH {views} {sql}") if tables else sql


# scans and reshaping


@query
def s01_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.long(B.wide(B.stock_bars(spark, sf_dir), ("A", "N", "R"))).select("Date", "Ticker", *PRICES, "Volume")


oracle("s01_wide_to_long", "SELECT * FROM bars", "bars")


@query
def s03_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.between(B.normalise(B.stock_bars(spark, sf_dir)), "1994-03-01", "1996-02-29", ["a", "R"])


oracle("s03_range_scan", """SELECT * FROM bars WHERE "Date" BETWEEN DATE '1994-03-01' AND DATE '1996-02-29' AND "Ticker" IN ('A', 'R')""", "bars")


@query
def s04_spy_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.between(B.normalise(B.spy_bars(spark, sf_dir)), "1995-01-01", "1997-12-31")


oracle("s04_spy_range_scan", """SELECT * FROM spy WHERE "Date" BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""", "spy")


@query
def s05_vix_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.between(B.normalise(B.vix_bars(spark, sf_dir)), "1995-01-01", "1997-12-31")


oracle("s05_vix_range_scan", """SELECT * FROM vix WHERE "Date" BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""", "vix")


def _bar_source(spark: SparkSession, sf_dir: str) -> B.Source:
    """All bars at hand as a source of downloads."""
    every = B.stock_bars(spark, sf_dir).unionByName(B.market_bars(spark, sf_dir))
    return lambda tickers, start, end: every.where(F.col("Ticker").isin(list(tickers)) & (F.col("Date") >= F.lit(start).cast("date")) & (F.col("Date") < F.lit(end).cast("date")))


@query
def s01_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.download_ohlcv_data(_bar_source(spark, sf_dir), ["a", "N"], "1994-01-01", "1997-01-01")


oracle("s01_download", """SELECT * FROM bars WHERE "Ticker" IN ('A', 'N') AND "Date" >= DATE '1994-01-01' AND "Date" < DATE '1997-01-01'""", "bars")


@query
def s02_market_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.download_market_data(_bar_source(spark, sf_dir), "1994-01-01", "1997-01-01")


oracle("s02_market_download", """SELECT * FROM (SELECT * FROM spy UNION ALL SELECT * FROM vix) WHERE "Date" >= DATE '1994-01-01' AND "Date" < DATE '1997-01-01'""", "spy", "vix")


@query
def s06_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = B.stock_bars(spark, sf_dir)
    return ingest.absent(new.unionByName(new), new.where("Date < '1997-06-01' AND Ticker != 'N'"), ("Ticker", "Date"))


oracle("s06_insert_if_absent", """SELECT * FROM bars WHERE NOT ("Date" < DATE '1997-06-01' AND "Ticker" <> 'N')""", "bars")


@query
def d01_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_bars(spark, sf_dir)


oracle("d01_event_bars", "SELECT * FROM bars_evt", "bars_evt")


@query
def d02_market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.market_bars(spark, sf_dir)


oracle("d02_market_bars", "SELECT * FROM spy UNION ALL SELECT * FROM vix", "spy", "vix")


# incremental loading


@query
def i01_latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_dates(B.stock_bars(spark, sf_dir), ["A", "N", "X"])


oracle("i01_latest_dates", """SELECT "Ticker", max("Date") AS latest FROM bars WHERE "Ticker" IN ('A', 'N', 'X') GROUP BY 1""", "bars")


@query
def i02_latest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_date(B.spy_bars(spark, sf_dir))


oracle("i02_latest_date", 'SELECT max("Date") AS latest FROM spy', "spy")


@query
def i03_latest_vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_date(B.vix_bars(spark, sf_dir))


oracle("i03_latest_vix", 'SELECT max("Date") AS latest FROM vix', "vix")


@query
def i04_stock_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stock_start(B.stock_bars(spark, sf_dir).where("Ticker != 'R' OR Date < '1996-01-01'"), ["A", "N", "R"], "2005-01-01", "2026-01-01")


oracle("i04_stock_start", """SELECT CAST(min(s) AS DATE) AS start FROM (SELECT coalesce(max("Date") + INTERVAL 1 DAY, DATE '2005-01-01') AS s
    FROM bars WHERE "Ticker" <> 'R' OR "Date" < DATE '1996-01-01' GROUP BY "Ticker") WHERE s < DATE '2026-01-01'""", "bars")  # fmt: skip


@query
def i05_market_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.market_start(B.spy_bars(spark, sf_dir), B.vix_bars(spark, sf_dir), "2005-01-01", "2026-01-01")


oracle("i05_market_start", """SELECT CAST(least((SELECT max("Date") FROM spy), (SELECT max("Date") FROM vix)) + INTERVAL 1 DAY AS DATE) AS start""", "spy", "vix")


@query
def i06_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.one_series(B.market_bars(spark, sf_dir).withColumn("Volume", F.when(F.col("Volume") > 100, F.col("Volume"))), "SPY")


oracle("i06_one_series", 'SELECT * REPLACE (CASE WHEN "Volume" > 100 THEN "Volume" ELSE 0 END AS "Volume") FROM spy', "spy")


@query
def i07_one_vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.one_series(B.market_bars(spark, sf_dir), "^VIX")


oracle("i07_one_vix", "SELECT * FROM vix", "vix")


@query
def i08_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = B.stock_bars(spark, sf_dir).where("Date between '1994-01-01' and '1997-01-01'")
    return ingest.fill(stored, _bar_source(spark, sf_dir), ["A", "R"], "1993-01-01", "1998-01-01")


oracle("i08_fill", """SELECT * FROM bars WHERE "Ticker" IN ('A', 'R') AND "Date" >= DATE '1993-01-01' AND "Date" < DATE '1998-01-01'""", "bars")


@query
def i08_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.missing_days(B.stock_bars(spark, sf_dir), "1990-01-01", "2001-01-01")


oracle("i08_missing_days", """SELECT * FROM (SELECT DATE '1990-01-01' AS "first", CAST(min("Date") - INTERVAL 1 DAY AS DATE) AS "last" FROM bars
    UNION ALL SELECT CAST(max("Date") + INTERVAL 1 DAY AS DATE), DATE '2000-12-31' FROM bars) WHERE "first" <= "last" """, "bars")  # fmt: skip


# joins and frames


@query
def j01_merge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    spy = add_features(B.spy_bars(spark, sf_dir), [{"function": "create_spy_sma_ratio_feature", "kwargs": {"window_size": 5}}], ("Ticker", *frames.OHLCV))
    vix = add_features(B.vix_bars(spark, sf_dir), [{"function": "create_vix_level_feature"}], ("Ticker", *frames.OHLCV))
    out = frames.merge_dataframes(B.stock_bars(spark, sf_dir).select("Ticker", "Date", "Close"), spy, vix)
    return out.withColumn("spy_sma_ratio_5", F.round("spy_sma_ratio_5", 6))


oracle("j01_merge_context", f"""SELECT b."Ticker", b."Date", b."Close", round(s.r, 6) AS spy_sma_ratio_5, v."Close" AS vix_level FROM bars b
    LEFT JOIN (SELECT "Date", {div('"Close"', roll("avg", '"Close"', 5))} AS r FROM spy) s USING ("Date") LEFT JOIN vix v USING ("Date")""", "bars", "spy", "vix")  # fmt: skip


# checks


@query
def v01_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = B.stock_bars(spark, sf_dir)
    bad = good.where("Ticker = 'A'").withColumns({"High": F.col("High") * 0.5, "Volume": F.when(F.col("Volume") > 20, -F.col("Volume")), "Open": F.when(F.month("Date") > 1, F.col("Open"))})
    return validate.report(good.unionByName(bad), ["A", "N"], "1992-06-01", "1998-06-01", 1, "1998-01-01")


def _bad(rule: str) -> str:
    return f"count(*) FILTER (WHERE {rule})"


_T = 1e-4
_RULES = {f"null_{c}": f'"{c}" IS NULL' for c in validate.COLUMNS} | {
    "open_not_positive": '"Open" <= 0', "close_not_positive": '"Close" <= 0', "high_below_open": f'"High" < "Open" * {1 - _T!r}', "high_below_close": f'"High" < "Close" * {1 - _T!r}',
    "high_below_low": f'"High" < "Low" * {1 - _T!r}', "low_above_open": f'"Low" > "Open" * {1 + _T!r}', "low_above_close": f'"Low" > "Close" * {1 + _T!r}', "volume_negative": '"Volume" < 0',
    "in_future": "\"Date\" > DATE '1998-01-01'", "before_start": "\"Date\" < DATE '1992-06-01'", "after_end": "\"Date\" > DATE '1998-06-01'", "unknown_ticker": "\"Ticker\" NOT IN ('A', 'N')",
}
oracle("v01_report", f""", d AS (SELECT * FROM bars UNION ALL BY NAME SELECT "Date", "Ticker", CASE WHEN month("Date") > 1 THEN "Open" END AS "Open", "High" * 0.5 AS "High", "Low", "Close",
        CASE WHEN "Volume" > 20 THEN -"Volume" END AS "Volume" FROM bars WHERE "Ticker" = 'A')
    {' UNION ALL '.join(f"SELECT '{r}' AS rule, {_bad(x)} AS violations FROM d" for r, x in _RULES.items())}
    UNION ALL SELECT 'repeated_key', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY "Ticker", "Date")
    UNION ALL SELECT 'gap_too_long', {_bad("gap > 1")} FROM (SELECT "Date" - {lag('"Date"', 1)} AS gap FROM d)""", "bars")  # fmt: skip


# split, outliers, metrics, selection

_SMALL = [{"function": "create_range_percentage_feature"}, {"function": "create_relative_volume_feature", "kwargs": {"window_size": 5}}, {"function": "create_drawdown_feature", "kwargs": {"window_size": 20}}]
_SMALL_SQL = staged([{"m": roll("avg", '"Volume"', 5), "k": roll("max", '"Close"', 20)}],
                    {"range_percentage": (div('"High" - "Low"', '"Close"'), None), "relative_volume_5": (div('"Volume"', "m"), None), "drawdown_20": (div('"Close" - k', "k"), None)})
_SMALL_COLUMNS = ("range_percentage", "relative_volume_5", "drawdown_20")


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(B.stock_bars(spark, sf_dir), _SMALL)


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stock_bars(spark, sf_dir).withColumns({"Open": F.when(F.month("Date") > 2, F.col("Open")), "market_movement": (F.col("Close") > F.col("Open")).cast("int")})


_HOLES_SQL = """, h AS (SELECT * REPLACE (CASE WHEN month("Date") > 2 THEN "Open" END AS "Open"), CAST("Close" > CASE WHEN month("Date") > 2 THEN "Open" END AS INTEGER) AS market_movement FROM bars)"""


@query
def p11_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.complete_rows(_holes(spark, sf_dir))


oracle("p11_complete_rows", _HOLES_SQL + ' SELECT * FROM h WHERE "Open" IS NOT NULL', "bars")


@query
def p12_features_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = prepare.split_features_target(_holes(spark, sf_dir), "market_movement")
    return x.select("Ticker", "Date", "Close", F.lit(None).cast("int").alias("answer")).unionByName(y.select("Ticker", "Date", F.lit(None).cast("double").alias("Close"), F.col("market_movement").alias("answer")))


oracle("p12_features_target", _HOLES_SQL + """ SELECT "Ticker", "Date", "Close", NULL::INTEGER AS answer FROM h WHERE "Open" IS NOT NULL
    UNION ALL SELECT "Ticker", "Date", NULL, market_movement FROM h WHERE "Open" IS NOT NULL""", "bars")  # fmt: skip


@query
def r05_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = prepare.split_train_test(B.stock_bars(spark, sf_dir).select("Ticker", "Date"), 0.8)
    return early.withColumn("part", F.lit("train")).unionByName(late.withColumn("part", F.lit("test")))


oracle("r05_split", """SELECT "Ticker", "Date", CASE WHEN row_number() OVER (ORDER BY "Date", "Ticker") <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM bars""", "bars")


@query
def a07_winsor_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = prepare.winsor_bounds(_small(spark, sf_dir), _SMALL_COLUMNS)
    return spark.createDataFrame([(c, *map(lambda x: round(x, 6), b)) for c, b in bounds.items()], "name string, low double, high double")


oracle("a07_winsor_bounds", f"WITH f AS ({_SMALL_SQL}) " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(quantile_cont({c}, 0.01), 6) AS low, round(quantile_cont({c}, 0.99), 6) AS high FROM f" for c in _SMALL_COLUMNS))


@query
def a07_narrowed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bounds from sketches stored by day and a bound so small that brackets must be narrowed."""
    scratch = Scratch(spark, "sketches")
    rows = scratch.keep(_small(spark, sf_dir), "rows")
    stored = scratch.keep(sketches(rows, _SMALL_COLUMNS), "sketches")
    bounds = prepare.winsor_bounds(rows, _SMALL_COLUMNS, stored=stored, bound=50)
    return spark.createDataFrame([(c, *map(lambda x: round(x, 6), b)) for c, b in bounds.items()], "name string, low double, high double")


ORACLE_SQL["a07_narrowed_bounds"] = ORACLE_SQL["a07_winsor_bounds"]


@query
def m02_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prepare.clip_outliers(_small(spark, sf_dir), _SMALL_COLUMNS)
    return out.select("Ticker", "Date", *[F.round(c, 6).alias(c) for c in _SMALL_COLUMNS])


_CUT = ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM f)), (SELECT quantile_cont({c}, 0.99) FROM f)) END, 6) AS {c}" for c in _SMALL_COLUMNS)
oracle("m02_clip", f'WITH f AS ({_SMALL_SQL}) SELECT "Ticker", "Date", {_CUT} FROM f')


@query
def m01_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.outlier_detection(_small(spark, sf_dir), _SMALL_COLUMNS).select("Ticker", "Date", "is_outlier")


@query
def a08_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select((F.col("user_id") % 2).alias("label"), (F.col("value") / (1 + F.col("value"))).alias("probability"))
    out = metrics.classification_metrics(events, threshold=0.9)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


oracle("a08_metrics", """WITH s AS (SELECT CAST(user_id % 2 AS DOUBLE) AS y, value / (1 + value) AS p FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
    g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
    r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
    t AS (SELECT count(*) FILTER (WHERE p >= 0.9 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.9 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.9 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.9 AND y = 0) AS tn FROM s)
    SELECT round((SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM r), 9) AS roc_auc, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
           round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM t""")  # fmt: skip

def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a run: some without the metric, some without a parent, many with equal metrics."""
    none = F.create_map().cast("map<string,string>")
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderstatus").alias("experiment"),
        F.col("o_custkey").alias("start_time"),
        none.alias("params"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.create_map(F.lit("roc_auc"), F.floor(F.col("o_totalprice") / 100_000).cast("double"))).otherwise(none.cast("map<string,double>")).alias("metrics"),
        F.when(F.col("o_custkey") % 3 != 0, F.create_map(F.lit(selection.PARENT), F.lit("p"))).otherwise(none).alias("tags"),
    )


_RUNS_SQL = """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS experiment, o_custkey AS start_time,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(floor(o_totalprice / 100000) AS DOUBLE) END AS m, o_custkey % 3 <> 0 AS child FROM orders)"""


@query
def r06_best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_run(selection.get_runs(_runs(spark, sf_dir), "F"))


oracle("r06_best_run", f"""{_RUNS_SQL} SELECT run_id, start_time, m AS "value" FROM r WHERE experiment = 'F' AND child AND m IS NOT NULL ORDER BY m DESC, start_time DESC, run_id DESC LIMIT 1""")


@query
def r07_child_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.get_runs(_runs(spark, sf_dir), "F", 50).select("run_id", "start_time")


oracle("r07_child_runs", f"{_RUNS_SQL} SELECT run_id, start_time FROM r WHERE experiment = 'F' AND child ORDER BY start_time DESC, run_id LIMIT 50")


@query
def s19_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.experiments(_runs(spark, sf_dir))


oracle("s19_experiments", f"{_RUNS_SQL} SELECT experiment, count(*) AS runs, max(start_time) AS last_start FROM r GROUP BY 1")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a version of its brand's model; run ids repeat, and so do aliases."""
    size = F.col("p_size") % 5
    return B.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("name"),
        (F.col("p_partkey") + 1).cast("int").alias("version"),
        (F.col("p_partkey") % 150).cast("string").alias("run_id"),
        F.when(size == 0, "champion").when(size == 1, "old").alias("alias"),
    )


_VERSIONS_SQL = """v AS (SELECT p_brand AS name, CAST(p_partkey + 1 AS INTEGER) AS version, CAST(p_partkey % 150 AS VARCHAR) AS run_id,
    CASE p_size % 5 WHEN 0 THEN 'champion' WHEN 1 THEN 'old' END AS alias FROM part)"""


@query
def m08_champion_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    name, version = selection.registered_version(versions, "17")
    return selection.assign_alias(versions, name, version)


oracle("m08_champion_alias", f"""WITH {_VERSIONS_SQL}, t AS (SELECT name, version FROM v WHERE run_id = '17' ORDER BY name, version LIMIT 1)
    SELECT v.name, v.version, v.run_id, CASE WHEN v.name = t.name AND v.version = t.version THEN 'champion' WHEN v.name = t.name AND v.alias = 'champion' THEN NULL ELSE v.alias END AS alias FROM v, t""")  # fmt: skip


@query
def m08_newest_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    given = versions.where("version % 4 = 0").select("name", F.when(F.col("version") % 8 == 0, "champion").otherwise("next").alias("alias"), "version", (F.col("version").cast("long") * 7919 % 200_003).alias("set_at"))
    return selection.with_aliases(versions, given)


oracle("m08_newest_aliases", f"""WITH {_VERSIONS_SQL}, n AS (SELECT name, CASE WHEN version % 8 = 0 THEN 'champion' ELSE 'next' END AS alias, arg_max(version, CAST(version AS BIGINT) * 7919 % 200003) AS version
        FROM v WHERE version % 4 = 0 GROUP BY ALL)
    SELECT v.name, v.version, v.run_id, coalesce((SELECT n.alias FROM n WHERE n.name = v.name AND n.version = v.version),
        CASE WHEN NOT EXISTS (FROM n WHERE n.name = v.name AND n.alias = v.alias) THEN v.alias END) AS alias FROM v""")  # fmt: skip


@query
def s19_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.models(_versions(spark, sf_dir)).withColumn("aliases", F.size("aliases"))


oracle("s19_models", f"WITH {_VERSIONS_SQL} SELECT name, count(DISTINCT version) AS versions, max(version) AS latest, CAST(count(alias) AS INTEGER) AS aliases FROM v GROUP BY 1")


# logs and serving


@query
def r03_recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders")
    logs = orders.select(F.col("o_orderkey").alias("prediction_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderstatus").alias("ticker"), F.col("o_totalprice").alias("probability"))
    return newest(logs, 50)


oracle("r03_recent_logs", 'SELECT o_orderkey AS prediction_id, o_orderdate AS "timestamp", o_orderstatus AS ticker, o_totalprice AS probability FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50')


@query
def p15_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "events").select("event_id", (F.col("value") / (1 + F.col("value"))).alias("p"))
    return p.select("event_id", inference.confidence(F.col("p")).alias("confidence"))


oracle("p15_confidence", "SELECT event_id, CASE WHEN value / (1 + value) >= 0.75 THEN 'High' WHEN value / (1 + value) >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence FROM events")


@query
def p18_checked_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "events").select("event_id", (F.col("value") / (1 + F.col("value"))).alias("p"))
    return p.select("event_id", F.round(inference.checked_probability(F.col("p")), 9).alias("p"))


oracle("p18_checked_probability", "SELECT event_id, round(value / (1 + value), 9) AS p FROM events")


@query
def n07_bollinger_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = inference.bollinger_overlay(B.stock_bars(spark, sf_dir))
    rows = one.select("Ticker", F.explode(F.arrays_zip("dates", "middle", "upper", "lower")).alias("r")).select("Ticker", "r.*")
    return rows.select("Ticker", "dates", *[F.round(c, 4).alias(c) for c in ("middle", "upper", "lower")])


oracle("n07_bollinger_overlay", f"""SELECT "Ticker", strftime("Date", '%Y-%m-%dT00:00:00') AS dates, round(m, 4) AS middle, round(m + 2 * s, 4) AS upper, round(m - 2 * s, 4) AS lower
    FROM (SELECT *, {roll("avg", '"Close"', 20)} AS m, {roll("stddev_samp", '"Close"', 20)} AS s FROM bars)""", "bars")  # fmt: skip

# Weights for the attribution query.
_WEIGHTS = {"range_percentage": 1.5, "relative_volume_5": -0.25, "drawdown_20": 2.0}


@query
def n08_linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.linear_attribution(_small(spark, sf_dir), _WEIGHTS, 2, 150)
    return out.select("Ticker", "rank", "feature", F.round("value", 6).alias("value"), F.round("contribution", 6).alias("contribution"))


oracle("n08_linear_attribution", f"""WITH f AS ({_SMALL_SQL}),
    b AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _SMALL_COLUMNS)} QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) <= 150),
    x AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) = 1),
    c AS ({' UNION ALL '.join(f"SELECT x.\"Ticker\", '{c}' AS feature, x.{c} AS value, {w} * (x.{c} - (SELECT avg(b.{c}) FROM b WHERE b.\"Ticker\" = x.\"Ticker\")) AS contribution FROM x" for c, w in _WEIGHTS.items())})
    SELECT "Ticker", CAST(row_number() OVER (PARTITION BY "Ticker" ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank, feature, round(value, 6) AS value, round(contribution, 6) AS contribution
    FROM c QUALIFY rank <= 2""")  # fmt: skip


@query
def n09_market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.stock_bars(spark, sf_dir).select("Ticker", "Date", F.when(F.month("Date") < 9, F.col("Volume") / 1000).alias("vix_level"), F.when(F.dayofmonth("Date") > 9, F.col("Close")).alias("spy_lag_return_1"))
    return inference.market_overview(rows)


oracle("n09_market_overview", """SELECT *, CASE WHEN vix_level >= 25 THEN 'Risk Off' WHEN vix_level >= 18 THEN 'Elevated' ELSE 'Risk On' END AS regime FROM (
    SELECT "Ticker", arg_max("Close", "Date") FILTER (WHERE day("Date") > 9) AS spy_return, arg_max("Volume" / 1000, "Date") FILTER (WHERE month("Date") < 9) AS vix_level FROM bars GROUP BY 1)""", "bars")  # fmt: skip


@query
def w13_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.latest(B.stock_bars(spark, sf_dir))


oracle("w13_latest_rows", 'SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) = 1', "bars")


@query
def w12_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.last_known(B.stock_bars(spark, sf_dir).withColumn("Close", F.when(F.month("Date") < 6, F.col("Close"))), "Close")


oracle("w12_last_known", """SELECT "Ticker", arg_max("Close", "Date") FILTER (WHERE month("Date") < 6) AS "Close" FROM bars GROUP BY 1""", "bars")


@query
def p19_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.stock_bars(spark, sf_dir).select("Ticker", "Date", "Close", F.date_format("Date", "MM").alias("month"), F.date_format("Date", "EEEE").alias("day_of_week"), F.lit(None).cast("double").alias("none"))
    return inference.feature_rows(rows)


oracle("p19_feature_rows", """, x AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) = 1)
    SELECT "Ticker", 'Close' AS feature, "Close" AS "value" FROM x UNION ALL SELECT "Ticker", 'month', CAST(month("Date") AS DOUBLE) FROM x""", "bars")  # fmt: skip


@query
def n10_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.reasons(inference.linear_attribution(_small(spark, sf_dir), _WEIGHTS, 3, 150), 2)
    return out.select("Ticker", F.array_join("reasons", ",").alias("reasons"), "dominant", F.round("share", 6).alias("share"))


oracle("n10_reasons", f"""WITH f AS ({_SMALL_SQL}),
    b AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _SMALL_COLUMNS)} QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) <= 150),
    x AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) = 1),
    c AS ({' UNION ALL '.join(f"SELECT x.\"Ticker\", '{c}' AS feature, abs({w} * (x.{c} - (SELECT avg(b.{c}) FROM b WHERE b.\"Ticker\" = x.\"Ticker\"))) AS a FROM x" for c, w in _WEIGHTS.items())}),
    r AS (SELECT *, row_number() OVER (PARTITION BY "Ticker" ORDER BY a DESC, feature) AS n FROM c)
    SELECT "Ticker", string_agg(feature, ',' ORDER BY n) FILTER (WHERE n <= 2) AS reasons, min(feature) FILTER (WHERE n = 1) AS dominant, round(max(a) / sum(a), 6) AS share FROM r GROUP BY 1""")  # fmt: skip


# models: the default grids over five windows


def _trained(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = frames.model_frame(B.stock_bars(spark, sf_dir), B.spy_bars(spark, sf_dir), B.vix_bars(spark, sf_dir), kind)
    scratch = Scratch(spark, "model")
    split = prepare.split_train_test(scratch.keep(prepare.complete_rows(df), "frame"))
    early, late = (scratch.keep(part, name) for part, name in zip(split, ("train", "test"), strict=True))
    got = train.train_model(early, late, kind)
    return train.scored(got.model, late).select("Ticker", "Date", "prediction", "probability", inference.confidence(F.col("probability")).alias("confidence"))


@query
def m03_lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, "lr")


@query
def m04_gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, "xgb")


# streams


@query
def t01_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the streaming plan; the result is what the batch bars are."""
    out = f"{shared_dir(spark)}/stream-bars-{uuid.uuid4().hex}"
    bars = S.bars_of(spark.readStream.schema(S.EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet*"), late="60 days")
    S.run_available(bars, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


oracle("t01_stream_bars", "SELECT * FROM bars_evt", "bars_evt")


def _dealt(rows: DataFrame, number: F.Column, files: int, where: str) -> str:
    """The rows as files that a stream reads one by one: those of number 0 first."""
    for i in range(files):
        rows.where(number == i).coalesce(1).write.mode("append").parquet(where)
    return where


@query
def t02_stream_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA and RSI of daily event bars that reach the stream in three files by the hash of their day, so out of order; one
    row of later years lets all others out."""
    base = f"{shared_dir(spark)}/stream-smoothing-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", smoothing.ROCKS_DB)
    rows = B.event_bars(spark, sf_dir).select("Ticker", "Date", "Close")
    last = rows.agg(F.lit("").alias("Ticker"), F.date_add(F.max("Date"), 400).alias("Date"), F.lit(0.0).alias("Close"))
    kept = Scratch(spark, "stream-rows").keep(rows.withColumn("file", F.pmod(F.xxhash64("Date"), F.lit(3))).unionByName(last.withColumn("file", F.lit(3).cast("long"))), "rows")
    where = _dealt(kept, F.col("file"), 4, f"{base}/in")
    stream = smoothing.smoothed(spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(where), 5, 14, "366 days")
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").where("Ticker <> ''").select("Ticker", "Date", F.round("ema", 4).alias("ema_5"), F.round("rsi", 5).alias("rsi_14"))


_EMA, _RSI = (feature_sql({"function": f"create_{f}", "kwargs": {"window_size": n}}, "bars_evt") for f, n in (("ema_feature", 5), ("rsi_feature", 14)))
oracle("t02_stream_smoothing", f"""SELECT "Ticker", "Date", ema_5, rsi_14 FROM ({_EMA}) JOIN ({_RSI}) USING ("Ticker", "Date")""")

# every 40th event comes two files late, every 60th comes twice
_LATE_FILE = "CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END"
_LATE_SQL = f""", f AS (
        SELECT *, floor(epoch(ts - (SELECT min(ts) FROM events)) / 864000)::INT + {_LATE_FILE} AS file FROM events
    ), n AS (
        SELECT file, max(ts) AS newest FROM f GROUP BY file
    ), m AS (
        SELECT f.*, (SELECT date_trunc('millisecond', max(newest)) FROM n WHERE n.file < f.file) - INTERVAL 2 DAY AS bound FROM f
    )"""


def _late_stream(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, DataFrame]:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    events = B.table(spark, sf_dir, "events").select(*[F.col(name).cast(kind) for name, kind in (f.split(" ") for f in S.EVENT_SCHEMA.split(", "))])
    first = events.agg(F.min("ts")).first()[0]
    dealt = events.withColumn("file", F.floor((F.col("ts").cast("double") - F.lit(first).cast("double")) / 864000) + F.expr(_LATE_FILE))
    again = dealt.where("event_id % 60 = 0")
    last = events.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit("").alias("event_type"), F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("user_id"), F.lit("").alias("props"))
    files = int(dealt.agg(F.max("file")).first()[0]) + 1
    kept = Scratch(spark, "late-rows").keep(dealt.unionByName(again).unionByName(last.withColumn("file", F.lit(files).cast("long"))), "rows")
    where = _dealt(kept, F.col("file"), files + 1, f"{base}/in")
    return base, spark.readStream.schema(S.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(where)


@query
def t03_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows appended from a stream with late and repeated events: late ones are left out, repeated ones count once."""
    base, events = _late_stream(spark, sf_dir, "stream-append")
    S.admit(events, f"{base}/events", f"{base}/admitting", "2 days")
    S.insert_new(S.bars_of(S.read_admitted(spark, f"{base}/events"), late="2 days", once=True), f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").where("Ticker <> ''")


oracle("t03_stream_append", f"""WITH {_LATE_SQL.lstrip(', ')}
    SELECT CAST(ts AS DATE) AS "Date", event_type AS "Ticker", first(value ORDER BY ts, event_id) AS "Open", max(value) AS "High", min(value) AS "Low",
           last(value ORDER BY ts, event_id) AS "Close", count(*) AS "Volume"
    FROM m WHERE bound IS NULL OR ts > bound GROUP BY ALL""")


@query
def t04_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that came too late for those windows, by type and day."""
    base, events = _late_stream(spark, sf_dir, "stream-late")
    S.admit(events, f"{base}/events", f"{base}/admitting", "2 days")
    return S.read_late(spark, f"{base}/events").groupBy(F.col("ts").cast("date").alias("Date"), F.col("event_type").alias("Ticker")).agg(F.count_distinct("event_id").alias("events"))


oracle("t04_late_events", f"""WITH {_LATE_SQL.lstrip(', ')} SELECT CAST(ts AS DATE) AS "Date", event_type AS "Ticker", count(*) AS events FROM m WHERE ts <= bound GROUP BY ALL""")
