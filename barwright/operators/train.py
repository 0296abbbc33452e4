"""Model pipelines, and their search over expanding time windows."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators import boosting, linear_search
from barwright.operators.boosting import BoostedTrees
from barwright.operators.metrics import classification_metrics
from barwright.operators.prepare import positions
from barwright.plans import parameters as P
from barwright.schema import RUN
from barwright.scratch import Scratch

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
#: In the order of their numbers; markets that never shut have bars on the last two.
DAYS = (*WEEKDAYS, "Saturday", "Sunday")
KEY = ("Date", "Ticker")
SEED = 42
#: Values (of eight bytes) in a partition of encoded rows.
CELLS = 2_000_000


def _encoders(onehot: Sequence[str], ordinal: Sequence[str], columns: Sequence[str]) -> tuple[list, list[str]]:
    """Stages that encode categories, and the columns that hold them; months come as text and become numbers. What is
    no day of the week is an error."""
    stages: list = []
    cases = [f"CASE `{c}` {' '.join(f"WHEN '{d}' THEN {float(i)}" for i, d in enumerate(DAYS))} ELSE raise_error(concat('unknown {c}: ', `{c}`)) END AS `{c}_number`" for c in ordinal]
    months = ["CAST(`month` AS DOUBLE) AS `month_number`"] if "month" in columns else []
    if cases or months:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join([*cases, *months])} FROM __THIS__"))
    for c in onehot:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_onehot", dropLast=True)]
    return stages, [f"{c}_onehot" for c in onehot] + [f"{c}_number" for c in ordinal] + (["month_number"] if months else [])


def lr_pipeline(columns: Sequence[str], onehot: Sequence[str] = ("Ticker",), ordinal: Sequence[str] = ("day_of_week",), skewed: Sequence[str] = P.SKEWED_COLUMNS, rows: int = 1, C: float = 1.0, l1_ratio: float = 0.0) -> Pipeline:  # noqa: N803
    """One-hot tickers and ordinal weekdays as they are, skewed columns scaled by median and quartiles, the others by
    mean and deviation, then a logistic regression whose penalty is 1 / (C rows)."""
    onehot, ordinal = [c for c in onehot if c in columns], [c for c in ordinal if c in columns]
    stages, encoded = _encoders(onehot, ordinal, columns)
    other = [c for c in columns if c not in (*onehot, *ordinal, *KEY, "month")]
    tails, plain = [c for c in other if c in skewed], [c for c in other if c not in skewed]
    for group, name, scaler in ((plain, "plain", StandardScaler(withMean=True, withStd=True)), (tails, "tails", RobustScaler(withCentering=True, withScaling=True))):
        if group:
            stages += [VectorAssembler(inputCols=group, outputCol=f"{name}_raw"), scaler.setInputCol(f"{name}_raw").setOutputCol(f"{name}_scaled")]
            encoded.append(f"{name}_scaled")
    stages.append(VectorAssembler(inputCols=encoded, outputCol="features"))
    stages.append(LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000, regParam=1 / (C * rows), elasticNetParam=l1_ratio, standardization=False))
    return Pipeline(stages=stages)


def gbt_pipeline(columns: Sequence[str], onehot: Sequence[str] = ("Ticker",), ordinal: Sequence[str] = ("day_of_week",), rows: int = 1, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1, subsample: float = 1.0, colsample_bytree: float = 1.0) -> Pipeline:
    """Encoded categories and the other columns as they are, then boosted trees. The share of columns is drawn by tree."""
    onehot, ordinal = [c for c in onehot if c in columns], [c for c in ordinal if c in columns]
    stages, encoded = _encoders(onehot, ordinal, columns)
    other = [c for c in columns if c not in (*onehot, *ordinal, *KEY, "month")]
    stages.append(VectorAssembler(inputCols=[*encoded, *other], outputCol="features"))
    stages.append(BoostedTrees.of(n_estimators=n_estimators, max_depth=max_depth, learning_rate=learning_rate, subsample=subsample, colsample_bytree=colsample_bytree, seed=SEED))
    return Pipeline(stages=stages)


PIPELINES = {"lr": (lr_pipeline, P.LR_GRID), "xgb": (gbt_pipeline, P.XGB_GRID)}


def grid(values: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(values, row, strict=True)) for row in product(*values.values())]


def expanding_folds(placed: DataFrame, n: int, folds: int = 5) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(rows to learn from, those rows, the rows after them): each fold is tested on the next n // (folds + 1) rows and
    learns from all before."""
    size = n // (folds + 1)
    if size < 1:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    for k in range(folds):
        cut = n - (folds - k) * size
        yield cut, placed.where(F.col("position") <= cut), placed.where((F.col("position") > cut) & (F.col("position") <= cut + size))


@dataclass
class Trained:
    model: PipelineModel
    params: dict
    cv_roc_auc: float
    metrics: dict[str, float]
    evaluated: DataFrame | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def run(self, spark, experiment: str, tags: dict[str, str]) -> DataFrame:
        """The run as a row of the runs table."""
        row = (self.run_id, experiment, int(time.time() * 1000), {k: str(v) for k, v in self.params.items()}, {"cv_roc_auc": self.cv_roc_auc, **self.metrics}, {"parent_run_id": experiment, **tags})
        return spark.createDataFrame([row], RUN)


def scored(model: PipelineModel | Transformer, df: DataFrame) -> DataFrame:
    """The rows with the predicted class and the probability of class 1."""
    out = model.transform(df)
    return out.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))


def _plain(pipeline: Pipeline) -> tuple[Pipeline, list[str]]:
    """A pipeline that encodes as this one does but leaves values unscaled, and the columns of its vector."""
    inputs = pipeline.getStages()[-2].getInputCols()
    made = {s.getOutputCol(): s for s in pipeline.getStages() if hasattr(s, "getOutputCol")}
    columns = [c for name in inputs for c in (made[name.replace("_scaled", "_raw")].getInputCols() if name.endswith("_scaled") else [name])]
    encoders = [s for s in pipeline.getStages() if isinstance(s, (SQLTransformer, StringIndexer, OneHotEncoder))]
    return Pipeline(stages=[*encoders, VectorAssembler(inputCols=columns, outputCol="features")]), columns


def encoded_rows(pipeline: Pipeline, placed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Every row's place, y and x (encoded, not scaled), written once for a whole search, and the length of x. Categories are
    those of all rows; one that a window hasn't seen is zero throughout it. Small frames get few partitions, as every
    pass is a job over them."""
    ready = _plain(pipeline)[0].fit(placed).transform(placed)
    rows = scratch.keep(ready.select(F.col("position").cast("long").alias("place"), F.col("label").alias("y"), vector_to_array("features").alias("x")), "encoded")
    n, width = rows.agg(F.count("y"), F.max(F.size("x"))).first()
    return rows.coalesce(max(1, math.ceil(n * width / CELLS))), width


def scaling(pipeline: Pipeline, early: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shift and factor of each place of the vector, as the pipeline's scalers learn them from the rows."""
    stages = {s.getOutputCol(): s for s in pipeline.getStages() if hasattr(s, "getOutputCol")}
    shift, factor = [], []
    for name in pipeline.getStages()[-2].getInputCols():
        if name.endswith("_scaled"):
            fitted = Pipeline(stages=[stages[name.replace("_scaled", "_raw")], stages[name]]).fit(early).stages[-1]
            spread = (fitted.std if hasattr(fitted, "std") else fitted.range).toArray()
            shift += list((fitted.mean if hasattr(fitted, "mean") else fitted.median).toArray())
            factor += list(np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0))
    plain = width - len(shift)  # one-hot and number columns come first and stay as they are
    return np.array([0.0] * plain + shift), np.array([1.0] * plain + factor)


def search(placed: DataFrame, n: int, kind: str, columns: Sequence[str], points: Sequence[dict], folds: int) -> list[list[float | None]]:
    """For each window and each point of the grid the area under the curve on the window's later rows. Rows are encoded and
    written once; see `linear_search` and `boosting` for what the points share."""
    make, _ = PIPELINES[kind]
    pipeline = make(columns)
    rows, width = encoded_rows(pipeline, placed, Scratch(placed.sparkSession, "search"))
    size = n // (folds + 1)
    windows = list(expanding_folds(placed, n, folds))
    if kind == "xgb":
        return boosting.search(rows, width, [(cut, size) for cut, _, _ in windows], [p | {"seed": SEED} for p in points])
    scaled = [linear_search.Window(cut, size, *scaling(pipeline, early, width)) for cut, early, _ in windows]
    return linear_search.search(rows, scaled, [(p.get("C", 1.0), p.get("l1_ratio", 0.0)) for p in points])


def without_summary(model: PipelineModel) -> PipelineModel:
    """The model without what Spark keeps of its training. A summary holds the session, which can't be sent to tasks once a
    frame of the session has been observed."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def train_model(train: DataFrame, test: DataFrame, kind: str, target: str = "market_movement", values: dict[str, Sequence] | None = None, folds: int = 5) -> Trained:
    """Every point of the grid over expanding windows, the best by mean area under the curve learnt again from all
    training rows, and its metrics on the test rows, which are kept with their predictions. A window whose tested rows are of one class counts for no point."""
    if kind not in PIPELINES:
        raise ValueError(f"unknown model {kind!r}; known are {', '.join(PIPELINES)}")
    make, default = PIPELINES[kind]
    columns = [c for c in train.columns if c not in (target, *KEY)] + ["Ticker"] * ("Ticker" in train.columns)
    points = grid(values or default)
    placed = Scratch(train.sparkSession, "train").keep(positions(train.withColumn("label", F.col(target).cast("double"))), "placed")
    n = placed.count()
    known = [s for s in search(placed, n, kind, columns, points, folds) if None not in s]
    means = [sum(s) / len(s) for s in zip(*known, strict=True)] if known else [float("nan")] * len(points)
    best = max(range(len(points)), key=lambda i: (round(means[i], 12), -i)) if known else 0
    model = without_summary(make(columns, rows=n, **points[best]).fit(placed))
    evaluated = Scratch(train.sparkSession, "train").keep(scored(model, test.withColumn("label", F.col(target).cast("double"))), "evaluated")
    row = classification_metrics(evaluated).first()
    return Trained(model, points[best], means[best], {k: v for k, v in row.asDict().items() if v is not None}, evaluated)
