"""Loading, storing, splitting, quantiles, metrics and selection."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import ingest, metrics, prepare, selection
from barwright.operators.prefix import running_totals
from barwright.operators.quantiles import exact_quantiles
from barwright.schema import BAR, RUN
from barwright.sources import bars as B
from barwright.sources.store import Store, datasets, export, jdbc_options


def day(d):
    return dt.date(2025, 3, 1) + dt.timedelta(d)


def some(spark, tickers, days):
    return spark.createDataFrame([(day(d), t, 1.0, 2.0, 0.5, 1.5, d) for t in tickers for d in days], BAR)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.tables() == [] and s.read("stock_data").count() == 0
    s.create_schemas()
    assert set(s.tables()) >= {"stock_data", "prediction_logs", "runs"}
    s.insert_stock_data(some(spark, ["A"], range(3)))
    s.insert_stock_data(some(spark, ["A", "B"], range(2, 5)).withColumn("Close", F.lit(9.0)))
    s.insert_stock_data(some(spark, ["A"], []))
    rows = s.read("stock_data").collect()
    assert len(rows) == 8 and {r.Close for r in rows if r.Ticker == "A" and r.Date <= day(2)} == {1.5}
    s.insert_spy_data(some(spark, ["SPY", "other"], [1]))
    assert s.read("spy_data").count() == 1
    for p in (0.2, 0.9):
        s.log_predictions(spark.createDataFrame([("A", 1, p, "m", 1)], "ticker string, prediction int, probability double, model_name string, model_version int"))
    logs = s.prediction_logs(1).collect()
    assert len(logs) == 1 and logs[0].probability == 0.9 and s.read("prediction_logs").select("prediction_id").distinct().count() == 2
    runs = spark.createDataFrame([("r", "x", 1, {"a": "1"}, {"roc_auc": 0.5}, {})], RUN)
    export(runs, f"{tmp_path}/runs_csv", "csv")
    export(runs, f"{tmp_path}/runs_json")
    assert '"roc_auc":0.5' in spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/runs_csv").first()["metrics"].replace('\\"', '"')
    with pytest.raises(KeyError):
        jdbc_options({})
    assert "sslmode=require" in jdbc_options({"DB_HOST": "h", "DB_NAME": "n", "DB_USER": "u", "DB_PASSWORD": "p"})["url"]
    assert len(datasets("/x")) == 22 and datasets("/x")["all_features"] == "/x/03_features/all_features"


def test_scans(spark):
    df = some(spark, ["A", "B"], range(10))
    assert B.between(df, str(day(2)), str(day(4)), ["a"]).count() == 3
    with pytest.raises(ValueError):
        B.between(df, "2025-02-02", "2025-02-01")
    odd = df.select("Date", "Ticker", *[F.lit(float("nan")).alias(c.lower()) for c in B.PRICES], "Volume", F.lit(1).alias("id"))
    assert B.normalise(odd).columns == BAR.names and B.normalise(odd).where("Open is not null").count() == 0
    assert sorted(map(tuple, B.long(B.wide(df, ["A", "B"])).select(BAR.names).collect())) == sorted(map(tuple, df.collect()))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("stock_data", some(spark, ["A", "B"], range(10)))
    plan = B.between(s.read("stock_data"), str(day(2)), str(day(4)), ["a"]).select("Date", "Close")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(Date" in plan and "ReadSchema: struct<Date:date,Ticker:string,Close:double>" in plan
    years = some(spark, ["A", "B"], range(0, 2000, 50))
    for part in (years.where("year(Date) < 2028"), years.where("year(Date) >= 2028"), years):
        s.insert_spy_data(part.where("Ticker = 'A'"))
    whole, some_years = s.read("spy_data"), s.read("spy_data", "2026-05-01", "2027-02-01")
    assert len(whole.inputFiles()) == 6 and len(some_years.inputFiles()) == 2
    assert sorted({r.Date.year for r in some_years.collect()}) == [2026, 2027] and whole.count() == 40
    for i in range(3):
        s.insert_stock_data(some(spark, [f"T{i}"], range(5)))
    before = s.read("stock_data")
    s.compact("stock_data")
    after = s.read("stock_data")
    assert len(before.inputFiles()) > len(after.inputFiles()) == 1 and sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))


def test_two_writers_leave_one_row_a_key(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from barwright.sources.commits import CommitLog

    stores = [Store(spark, str(tmp_path)) for _ in range(3)]
    frames = [some(spark, ["A", f"own{i}"], range(20)).withColumn("Close", F.lit(float(i))) for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: stores[i].insert_stock_data(frames[i]), range(3)))
    rows = stores[0].read("stock_data").collect()
    assert len(rows) == 80 and len({(r.Ticker, r.Date) for r in rows}) == 80
    assert len({r.Close for r in rows if r.Ticker == "A"}) == 1  # one writer's rows, not a mixture
    # both ways to publish refuse a number that is taken
    log = CommitLog(spark, f"{tmp_path}/stock_data")
    new, taken, free = log._hadoop("_log/_new.json"), log._hadoop(f"_log/{log.versions()[-1]:012d}.json"), log._hadoop("_log/000000000099.json")
    log._fs.create(new).close()
    assert not log._link(new, taken) and not log._rename(new, taken) and log._rename(new, free)
    log._fs.delete(free, False)
    # a failure before the commit leaves nothing to be seen
    monkeypatch.setattr(CommitLog, "publish", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stores[1].insert_stock_data(some(spark, ["later"], range(3)))
    monkeypatch.undo()
    assert stores[0].read("stock_data").count() == 80
    monkeypatch.setattr(CommitLog, "publish", lambda *a, **k: False)
    with pytest.raises(RuntimeError, match="other writers"):
        stores[1].append("stock_data", some(spark, ["later"], range(3)))


def test_lost_files_are_no_empty_table(spark, tmp_path):
    import shutil

    from pyspark.errors import AnalysisException

    s = Store(spark, str(tmp_path))
    s.insert_stock_data(some(spark, ["A"], range(3)))
    shutil.rmtree(f"{tmp_path}/stock_data/data")
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        s.read("stock_data").count()
    (tmp_path / "vix_data").mkdir()  # a folder of plain files that has lost them
    with pytest.raises(AnalysisException):
        s.read("vix_data").count()
    some(spark, ["B"], range(3)).write.parquet(f"{tmp_path}/spy_data")
    s.insert_spy_data(some(spark, ["B"], range(5)))
    assert s.read("spy_data").count() == 5
    s.insert_spy_data(some(spark, ["B"], range(6)))
    assert s.read("spy_data").count() == 6


def test_a_source_is_asked_once(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(x):
        asked.add(1)
        return 1.0

    Store(spark, str(tmp_path)).insert_stock_data(some(spark, ["A"], range(7)).withColumn("Close", price("Open")))
    assert asked.value == 7


def test_where_to_start(spark):
    df = some(spark, ["A"], range(3)).unionByName(some(spark, ["B"], range(5)))
    start = lambda t, end=day(20): ingest.stock_start(df, t, "2005-01-01", str(end)).first().start
    assert start(["A", "B"]) == day(3) and start(["B"]) == day(5) and start(["B", "new"]) == dt.date(2005, 1, 1) and start(["B"], day(5)) is None
    assert ingest.market_start(df, df.where("false"), "2005-01-01", "2026-01-01").first().start == dt.date(2005, 1, 1)


def test_gap_filling(spark):
    stored, asked = some(spark, ["A"], [30, 31]), []

    def source(tickers, first, last):
        asked.append((first, last))
        if first > str(day(31)):
            raise ValueError("nothing there")
        return some(spark, tickers, range(28, 33))

    out = ingest.fill(stored, source, ["A"], str(day(28)), str(day(35)))
    assert asked == [(str(day(28)), str(day(30))), (str(day(32)), str(day(35)))]
    assert sorted(r.Date for r in out.collect()) == [day(d) for d in range(28, 33)]
    assert ingest.serving_window(stored, source, "a", 5, day(31)).count() == 4
    for bad in ((1, 5), ("A", 0), ("A", True)):
        with pytest.raises((TypeError, ValueError)):
            ingest.serving_window(stored, source, *bad)


def test_split(spark):
    df = spark.createDataFrame([(day(i // 3), "ABC"[i % 3], float(i)) for i in range(30)], "Date date, Ticker string, x double")
    a, b = prepare.split_train_test(df, 0.8)
    assert sorted(r.x for r in a.collect()) == list(range(24)) and b.count() == 6
    for p in (0, 1, 1.5):
        with pytest.raises(ValueError):
            prepare.split_train_test(df, p)
    x, y = prepare.split_features_target(df.withColumn("market_movement", F.when(F.col("x") > 3, 1.0)))
    assert x.count() == y.count() == 26 and y.columns == ["Date", "Ticker", "market_movement"]


def test_quantiles_and_clip(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 0.25)])
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "x double, none double")
    got = exact_quantiles(df, ["x", "none"], [0.0, 0.01, 0.5, 0.99, 1.0])
    assert np.allclose(got["x"], np.quantile(x, [0, 0.01, 0.5, 0.99, 1]), atol=1e-12) and got["none"] == [None] * 5
    clipped = [r.x for r in prepare.clip_outliers(df, ["x"]).collect()]
    assert clipped.count(None) == 1 and max(v for v in clipped if v is not None) == pytest.approx(np.quantile(x, 0.99))


def test_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, rng.normal(0, 1, 3))) for _ in range(2000)] + [(15.0, -15.0, 15.0)] * 5 + [(None, 1.0, 1.0)]
    out = prepare.outlier_detection(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert out.count() == 2006 and out.where("a > 10 and is_outlier = 0").count() == 0
    assert 0.01 <= out.where("is_outlier = 1").count() / 2006 <= 0.02 and out.where("a is null").first().is_outlier == 0


def test_metrics(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p).astype(float)
    row = metrics.classification_metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "label double, probability double")).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    hit = p >= 0.5
    assert row.roc_auc == pytest.approx(auc, abs=1e-12) and row.accuracy == pytest.approx((hit == y).mean())
    assert row.precision == pytest.approx(y[hit].mean()) and row.recall == pytest.approx(hit[y == 1].mean())
    empty = metrics.classification_metrics(spark.createDataFrame([(1.0, 0.1)], "label double, probability double")).first()
    assert empty.roc_auc is None and empty.precision is None and empty.recall == 0


def test_running_totals(spark):
    df = spark.createDataFrame([((i * 7) % 101, i) for i in range(101)], "k int, v int")
    want = {k: sum(v for j, v in df.collect() if j < k) for k, _ in df.collect()}
    assert {r.k: r.before_v for r in running_totals(df, ["k"], ["v"]).collect()} == want


def test_selection(spark):
    runs = lambda *r: spark.createDataFrame([(i, "x", t, {}, m, {"parent_run_id": "p"}) for i, t, m in r], RUN)
    assert selection.find_best_run(runs(("a", 1, {"roc_auc": 0.82}), ("b", 2, {"roc_auc": 0.91}), ("c", 3, {"roc_auc": 0.75}))) == "b"
    assert selection.find_best_run(runs(("a", 1, {"roc_auc": 0.85}), ("b", 2, {"roc_auc": 0.85}), ("c", 3, {}))) == "b"
    with pytest.raises(ValueError):
        selection.find_best_run(runs(("a", 1, {"f1": 1.0})))
    versions = spark.createDataFrame([("m", 1, "a", "champion"), ("m", 2, "b", None)], "name string, version int, run_id string, alias string")
    assert selection.registered_version(versions, "b") == ("m", 2)
    assert {r.version: r.alias for r in selection.assign_alias(versions, "m", 2).collect()} == {1: None, 2: "champion"}
    with pytest.raises(ValueError):
        selection.registered_version(versions, "none")


def test_stored_sketches_save_a_pass(spark, tmp_path):
    from barwright.operators import quantiles as Q

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(0, 2, 20_000), np.full(3_000, 7.0)])
    df = spark.createDataFrame([(day(i % 30), float(v), None) for i, v in enumerate(x)], "Date date, x double, none double")
    df.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    Q.sketches(rows.where(F.col("Date") < day(20)), ["x", "none"]).write.parquet(f"{tmp_path}/days")
    Q.sketches(rows.where(F.col("Date") >= day(20)), ["x", "none"]).write.mode("append").parquet(f"{tmp_path}/days")
    stored = spark.read.parquet(f"{tmp_path}/days")
    assert stored.count() == 30 and Q.merged(stored, ["none"], [0.5]) == {"none": None}
    shares = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    done = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    passes = []
    for more in ({}, {"stored": stored}):
        before = done()
        got = Q.exact_quantiles(rows, ["x", "none"], shares, bound=200, **more)
        passes.append(done() - before)
        assert np.allclose(got["x"], np.quantile(x, shares)) and got["none"] == [None] * 6
    assert passes[1] <= passes[0]  # the sketches' own rows are one of these, and no pass over the bars
    # sketches of other rows only cost a pass
    wrong = Q.sketches(rows.withColumn("x", F.col("x") + 1000), ["x"])
    assert np.allclose(Q.exact_quantiles(rows, ["x"], shares, bound=200, stored=wrong)["x"], np.quantile(x, shares))
