"""From features to model input: complete rows, chronological split, outlier flags and winsorising."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.guards import clip
from barwright.operators.quantiles import exact_quantiles
from barwright.plans import parameters as P
from barwright.scratch import Scratch

KEY = ("Date", "Ticker")


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def split_features_target(df: DataFrame, target: str = P.DEFAULTS["target_variable"]) -> tuple[DataFrame, DataFrame]:
    """Complete rows as two frames: features, and the answer; both keep the key that puts them together again."""
    whole = complete_rows(df)
    return whole.drop(target), whole.select(*[k for k in KEY if k in df.columns], target)


def positions(df: DataFrame) -> DataFrame:
    """The frame with `position` (from 1, by date, then ticker) and `total` added.

    Dates are few, so their counts are summed up in one place; rows are numbered within their date.
    """
    days = df.groupBy("Date").agg(F.count(F.lit(1)).alias("n"))
    total, earlier = Window.partitionBy(), Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("Date", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"), F.sum("n").over(total).alias("total"))
    numbered = df.withColumn("position", F.row_number().over(Window.partitionBy("Date").orderBy("Ticker")))
    return numbered.join(days, "Date").withColumn("position", F.col("earlier") + F.col("position")).select(*df.columns, "position", "total")


def split_train_test(df: DataFrame, training_proportion: float = P.DEFAULTS["training_proportion"]) -> tuple[DataFrame, DataFrame]:
    """The earliest share of the rows, and the rest."""
    if not 0 < training_proportion < 1:
        raise ValueError("training_proportion must lie between 0 and 1")
    placed = positions(df)
    early = F.col("position") <= F.floor(F.col("total") * training_proportion)
    return placed.where(early).select(df.columns), placed.where(~early).select(df.columns)


def winsor_bounds(df: DataFrame, columns: Sequence[str] = P.CLIP_COLUMNS, low: float = 0.01, high: float = 0.99, stored: DataFrame | None = None, **more) -> dict[str, list[float | None]]:
    """The quantiles to cut at; with stored `sketches` of the rows (and `bound`) as in `exact_quantiles`."""
    return exact_quantiles(df, columns, (low, high), stored=stored, **more)


def clip_outliers(df: DataFrame, clip_columns: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """The columns cut at their 1 % and 99 % quantiles, those of the frame itself unless `fit_on` is given. What the
    quantiles are taken from is written once, as they take several passes."""
    columns = [c for c in (clip_columns or P.CLIP_COLUMNS)]
    scratch = Scratch(df.sparkSession, "clip")
    if fit_on is None:
        df = fit_on = scratch.keep(df, "frame")
    else:
        fit_on = scratch.keep(fit_on.select(*columns), "fit")
    bounds = winsor_bounds(fit_on, columns)
    return df.withColumns({c: clip(F.col(c).cast("double"), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items() if lo is not None})


@dataclass(frozen=True)
class ForestSettings:
    """Each tree learns from sample_rows rows; trees * sample_rows rows come to the driver, whatever the frame's size."""

    trees: int = 100
    sample_rows: int = 256
    contamination: float = 0.015
    seed: int = 42


def _mean_path(n: float) -> float:
    """The mean depth at which a value is isolated in a random tree over n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class IsolationForest:
    """Trees of random cuts; rows that few cuts isolate are odd."""

    def __init__(self, x: np.ndarray, s: ForestSettings) -> None:
        rng = np.random.default_rng(s.seed)
        self.size = max(1, min(s.sample_rows, len(x)))
        self.depth = math.ceil(math.log2(max(self.size, 2)))
        self.trees = [self._grow(x[rng.permutation(len(x))[: self.size]], rng) for _ in range(s.trees)] if len(x) else []

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Heap-ordered nodes: feature (-1 in leaves), cut, and path length in leaves."""
        n = (1 << (self.depth + 1)) - 1
        feature, cut, length = np.full(n, -1), np.zeros(n), np.zeros(n)
        todo = [(0, 0, x)]
        while todo:
            node, depth, rows = todo.pop()
            wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else np.empty(0, int)
            if depth == self.depth or not len(wide):
                length[node] = depth + _mean_path(len(rows))
                continue
            f = int(rng.choice(wide))
            c = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[node], cut[node] = f, c
            left = rows[:, f] < c
            todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
        return feature, cut, length

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, length in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] >= cut[node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            total += length[node]
        return 2 ** (-total / max(len(self.trees), 1) / max(_mean_path(self.size), 1e-12))


def outlier_detection(df: DataFrame, outlier_feature_selection: Sequence[str] | None = None, settings: ForestSettings = ForestSettings()) -> DataFrame:
    """The frame with `is_outlier` (1 for about the most isolated 1.5 % of rows, else 0). Rows with a null among the
    columns are not judged (0). The forest is learnt from a bounded sample picked by a hash of the key, where the frame
    has one, so that equal rows are drawn one by one; all rows are scored. Frame and scores are written once."""
    columns = list(outlier_feature_selection or P.OUTLIER_COLUMNS)
    scratch = Scratch(df.sparkSession, "outliers")
    df = scratch.keep(df, "frame")
    drawn = [k for k in KEY if k in df.columns] or columns
    whole = df.select(F.xxhash64(F.lit(settings.seed), *drawn).alias("_drawn"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna("any")
    sample = whole.orderBy("_drawn", *columns).limit(settings.trees * settings.sample_rows).drop("_drawn").toPandas()
    shared = df.sparkSession.sparkContext.broadcast(IsolationForest(sample.to_numpy(float), settings))

    @F.pandas_udf("double")
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = np.stack([c.to_numpy(float) for c in cols], axis=1)
            bad = np.isnan(x).any(axis=1)
            yield pd.Series(np.where(bad, np.nan, shared.value.score(np.nan_to_num(x))))

    scored = scratch.keep(df.withColumn("_isolation", F.nanvl(isolation(*[F.col(c).cast("double") for c in columns]), F.lit(None).cast("double"))), "scored")
    bound = exact_quantiles(scored.select("_isolation"), ["_isolation"], [1 - settings.contamination])["_isolation"][0]
    flag = F.coalesce(F.col("_isolation") > F.lit(bound), F.lit(False)).cast("int")
    return scored.withColumn("is_outlier", flag).drop("_isolation")
