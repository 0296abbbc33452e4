"""Shapley values of boosted trees against a background of earlier rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.boosting import BoostedTreesModel

#: A leaf is a number; an inner node is (feature, threshold, left, right), and left are the values not over the threshold.
Node = float | tuple


def read_trees(model: BoostedTreesModel) -> list[tuple[float, Node]]:
    """Weight and root of each tree of a fitted boosted model. They are as large as the model."""
    return model.read_trees().nested()


def tree_value(root: Node, x: np.ndarray) -> float:
    while isinstance(root, tuple):
        f, threshold, left, right = root
        root = left if x[f] <= threshold else right
    return root


@dataclass
class Leaves:
    """All leaves of some trees side by side: value, and for each feature that the way to a leaf tests (padded with -1) the
    interval (low, high] that its value must lie in."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, trees: Sequence[tuple[float, Node]]) -> Leaves:
        ways: list[tuple[float, dict[int, tuple[float, float]]]] = []
        todo: list[tuple[float, Node, dict[int, tuple[float, float]]]] = [(w, root, {}) for w, root in trees]
        while todo:
            weight, node, way = todo.pop()
            if not isinstance(node, tuple):
                ways.append((weight * node, way))
                continue
            f, threshold, left, right = node
            low, high = way.get(f, (-np.inf, np.inf))
            todo += [(weight, left, way | {f: (low, min(high, threshold))}), (weight, right, way | {f: (max(low, threshold), high)})]
        width = max([1, *(len(way) for _, way in ways)])
        pad = [(-1, -np.inf, np.inf)]
        rows = np.array([[(f, *span) for f, span in way.items()] + pad * (width - len(way)) for _, way in ways]).reshape(len(ways), width, 3)
        return cls(np.array([v for v, _ in ways]), rows[:, :, 0].astype(int), rows[:, :, 1], rows[:, :, 2])

    def inside(self, rows: np.ndarray) -> np.ndarray:
        """(row, leaf, test) whether the row's value passes."""
        v = rows[:, np.maximum(self.feature, 0)]
        return ((v > self.low) & (v <= self.high)) | (self.feature < 0)


#: Tests of background rows looked at side by side.
CELLS = 4_000_000


def shapley(leaves: Leaves, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """What each feature contributes to the trees' value at x rather than at the background rows, on average over them.

    Coalitions take their members' values from x and the others from a background row. A leaf is reached by the coalitions
    that hold the a features whose test only x passes and lack the b whose test only the row passes, so each of the
    former is worth (a - 1)! b! / (a + b)! of it and each of the latter a! (b - 1)! / (a + b)! less. All leaves and rows
    are worked on in arrays: the time grows with leaves times depth times rows.
    """
    out, width = np.zeros(len(x)), leaves.feature.shape[1]
    share = np.array([[factorial(max(a - 1, 0)) * factorial(b) / factorial(a + b) for b in range(width + 1)] for a in range(width + 1)])
    step = max(1, CELLS // max(1, len(background) * width))
    for i in range(0, len(leaves.value), step):
        part = Leaves(*(v[i : i + step] for v in (leaves.value, leaves.feature, leaves.low, leaves.high)))
        mine, theirs = part.inside(x[None])[0], part.inside(background)
        gives, takes = mine & ~theirs, theirs & ~mine
        a, b = gives.sum(2), takes.sum(2)
        reached = (mine | theirs).all(2) * part.value / len(background)
        each = (reached * share[a, b])[:, :, None] * gives - (reached * share[b, a])[:, :, None] * takes
        known = part.feature >= 0
        out += np.bincount(part.feature[known], each.sum(0)[known], len(x))
    return out


def slot_names(model: PipelineModel) -> list[str]:
    """What each place of the feature vector holds: a column, or a column's category."""
    labels = {s.getOutputCol(): s.labels for s in model.stages if hasattr(s, "labels")}
    out: list[str] = []
    for name in model.stages[-2].getInputCols():
        own = labels.get(name.replace("_onehot", "_index"))
        out += [f"{name.removesuffix('_onehot')}={v}" for v in own] if name.endswith("_onehot") and own else [name.removesuffix("_number")]
    return out


def tree_attribution(features: DataFrame, model: PipelineModel, top_n: int = 10, background_size: int = 150) -> DataFrame:
    """For each ticker's last complete row the greatest contributions to the margin, against the ticker's last
    `background_size` complete rows. Rows: Ticker, rank, feature, value, contribution; ties go by place in the vector.

    Only those rows reach the group of a ticker, so a group is bounded whatever the history.
    """
    leaves, names = Leaves.of(read_trees(model.stages[-1])), slot_names(model)
    ready = PipelineModel(stages=model.stages[:-1]).transform(features.dropna("any"))
    back = Window.partitionBy("Ticker").orderBy(F.desc("Date"))
    rows = ready.select("Ticker", vector_to_array("features").alias("x"), F.row_number().over(back).alias("n")).where(F.col("n") <= background_size)

    def explain(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("n")
        rows = np.stack(g["x"].to_numpy()).astype(float)
        x, out = rows[0], shapley(leaves, rows[0], rows)
        top = np.argsort(-np.abs(out), kind="stable")[:top_n]
        return pd.DataFrame({"Ticker": g["Ticker"].iloc[0], "rank": np.arange(1, len(top) + 1), "feature": [names[i] for i in top], "value": x[top], "contribution": out[top]})

    kind = dict(features.dtypes)["Ticker"]
    return rows.groupBy("Ticker").applyInPandas(explain, f"Ticker {kind}, rank int, feature string, value double, contribution double")
