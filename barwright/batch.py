"""The whole batch, from a source of bars to an aliased model, step by step over a store and its named data sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators import ingest, prepare, selection, train, validate
from barwright.plans import frames
from barwright.plans import parameters as P
from barwright.sources import bars as B
from barwright.sources.store import Store, datasets

SERIES = ("stock_data", "spy_data", "vix_data")
# Names of the columns that hold a class of model's grid, and the parameters of a run that asks for none.
GRIDS = {"lr": "lr_param_grid", "xgb": "xgb_param_grid"}
RUN_DEFAULTS = {"market_tickers": ["SPY", "^VIX"], "experiment": "market-regimes", "registered_model_name": "volatility-regime", "folds": 5}


@dataclass
class Batch:
    """What the steps share. Parameters are those of the library's defaults, replaced by the ones given; `tickers`,
    `raw_data_start_date` and `raw_data_end_date` (exclusive) have no default. Every step reads what the one before wrote,
    so a run can be taken up again at any step, and no step runs the plan of another anew."""

    store: Store
    source: B.Source
    params: dict[str, Any]

    def __post_init__(self) -> None:
        self.params = P.DEFAULTS | RUN_DEFAULTS | self.params
        self.paths = datasets(f"{self.store.base}/_data")

    def read(self, name: str) -> DataFrame:
        return self.store.spark.read.parquet(self.paths[name])

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.paths[name])

    def move(self, path: str, to: str) -> None:
        """A folder in the place of another."""
        spark = self.store.spark
        a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
        fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(b, True)
        if not fs.rename(a, b):
            raise OSError(f"{path} could not be moved to {to}")


def data_ingestion(b: Batch) -> None:
    """Bars that the store hasn't got yet are loaded and added; the raw data sets are the wanted range of the store."""
    p, store = b.params, b.store
    tickers, first, end = [t.upper() for t in p["tickers"]], p["raw_data_start_date"], p["raw_data_end_date"]
    day = lambda row: "" if row.start is None else str(row.start)
    start = day(ingest.stock_start(store.read("stock_data"), tickers, first, end).first())
    store.insert_stock_data(B.download_ohlcv_data(b.source, tickers, start, end))
    spy, vix = p["market_tickers"]
    start = day(ingest.market_start(store.read("spy_data"), store.read("vix_data"), first, end).first())
    market = B.download_market_data(b.source, start, end, [spy, vix])
    store.insert_spy_data(ingest.one_series(market, spy))
    store.insert_vix_data(ingest.one_series(market, vix))
    inside = (F.col("Date") >= F.lit(first).cast("date")) & (F.col("Date") < F.lit(end).cast("date"))
    for name in SERIES:
        rows = store.read(name).where(inside)
        b.write(name, rows.where(F.col("Ticker").isin(tickers)) if name == "stock_data" else rows)


def data_validation(b: Batch) -> None:
    p = b.params
    spy, vix = p["market_tickers"]
    for name, tickers in zip(SERIES, ([t.upper() for t in p["tickers"]], [spy], [vix]), strict=True):
        checking = f"{b.paths[f'validated_{name}']}_checking"

        def store(df: DataFrame, checking: str = checking) -> DataFrame:
            df.write.mode("overwrite").parquet(checking)
            return b.store.spark.read.parquet(checking)

        validate.validate_and_store(b.read(name), store, tickers=tickers, start_date=p["raw_data_start_date"], end_date=p["raw_data_end_date"], max_gap_days=p["max_gap_days"])
        b.move(checking, b.paths[f"validated_{name}"])


def feature_engineering(b: Batch) -> None:
    """All features once; the frames of the models are projections of what was written."""
    p = b.params
    series = [b.read(f"validated_{name}") for name in SERIES]
    b.write("all_features", frames.all_features(*series, p["stock_features_config"], p["spy_features_config"], p["vix_features_config"]))
    for model, columns in (("lr", "lr_features"), ("xgb", "xgboost_features"), ("mlp", "mlp_features")):
        b.write(f"{model}_features", frames.project(b.read("all_features"), p[columns]))


def data_split(b: Batch) -> None:
    """Features and answers, both with the key; the earliest share to learn from, the rest to test."""
    target = b.params["target_variable"]
    for model in GRIDS:
        parts = prepare.split_train_test(prepare.complete_rows(b.read(f"{model}_features")), b.params["training_proportion"])
        for name, part in zip(("train", "test"), parts, strict=True):
            x, y = prepare.split_features_target(part, target)
            b.write(f"{model}_X_{name}", x)
            b.write(f"{model}_y_{name}", y)


def outlier_handling(b: Batch) -> None:
    """The linear model's features, flagged and winsorised, each part by itself."""
    for part in ("train", "test"):
        b.write(f"lr_X_{part}_flagged", prepare.outlier_detection(b.read(f"lr_X_{part}"), b.params["outlier_feature_selection"]))
        b.write(f"lr_X_{part}_clipped", prepare.clip_outliers(b.read(f"lr_X_{part}_flagged"), b.params["clip_columns"]))


def model_training(b: Batch) -> None:
    """Both models searched, learnt and registered, as children of one experiment. The untrained pipelines are stored too."""
    p, keys = b.params, list(prepare.KEY)
    for model, grid in GRIDS.items():
        names = {part: (f"lr_X_{part}_clipped" if model == "lr" else f"{model}_X_{part}", f"{model}_y_{part}") for part in ("train", "test")}
        early, late = (b.read(x).join(b.read(y), keys) for x, y in names.values())
        got = train.train_model(early, late, model, p["target_variable"], p[grid], p["folds"])
        make, _ = train.PIPELINES[model]
        b.store.save_pipeline(f"{model}_pipeline", make([c for c in b.read(names["train"][0]).columns if c != "Date"]))
        b.store.register(got, p["experiment"], p["registered_model_name"], {"model": model, "market_tickers": ",".join(p["market_tickers"])} | {f"{part}_data": b.paths[x] for part, (x, _) in names.items()})


def model_selection(b: Batch) -> None:
    """The best run's version gets the alias."""
    runs = selection.get_runs(b.store.read("runs"), b.params["experiment"])
    name, version = selection.registered_version(b.store.versions(), selection.find_best_run(runs, b.params["metric"]))
    b.store.set_alias(name, version)


STEPS = {f.__name__: f for f in (data_ingestion, data_validation, feature_engineering, data_split, outlier_handling, model_training, model_selection)}


def run_batch(store: Store, source: B.Source, params: dict[str, Any], steps: Sequence[str] | None = None) -> Batch:
    """The named steps in their order, all of them by default."""
    unknown = set(steps or ()) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}; known are {', '.join(STEPS)}")
    b = Batch(store, source, params)
    for name, step in STEPS.items():
        if steps is None or name in steps:
            step(b)
    return b
