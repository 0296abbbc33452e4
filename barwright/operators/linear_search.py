"""All points of a logistic regression's grid over all windows at once: one pass over the rows gives every model its
gradient and curvature, so the rows are read as often as the slowest model needs steps, however many models there are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.metrics import areas

#: Partial sums that one task adds up at most.
FAN_IN = 64
PASSES = 100
TOLERANCE = 1e-8


@dataclass(frozen=True)
class Window:
    """Rows up to `cut` are learnt from, the next `size` tested; columns are scaled as (x - shift) * factor."""

    cut: int
    size: int
    shift: np.ndarray
    factor: np.ndarray


def _matrix(batch: pa.RecordBatch, window: Window, rows: np.ndarray) -> np.ndarray:
    """Scaled rows with a last column of ones."""
    width = len(window.shift)
    x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, width)[rows]
    return np.concatenate([(x - window.shift) * window.factor, np.ones((len(x), 1))], 1)


def _sums(rows: DataFrame, windows: Sequence[Window], weights: np.ndarray, active: np.ndarray) -> list[np.ndarray]:
    """For each window one row a model: loss, gradient and curvature at the weights, summed over its rows to learn from.
    weights: (window, model, column); models that aren't active keep zeros."""
    columns = weights.shape[2]
    each = 1 + columns + columns * columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(windows), weights.shape[1], each))
        slot = 0
        for batch in batches:
            place, y = np.asarray(batch.column("place")), np.asarray(batch.column("y"))
            slot = int(place[0]) if len(place) else slot
            for k, window in enumerate(windows):
                inside = np.flatnonzero(place <= window.cut)
                models = np.flatnonzero(active[k])
                if not len(inside) or not len(models):
                    continue
                x, sign = _matrix(batch, window, inside), 2 * y[inside, None] - 1
                z = x @ weights[k, models].T
                p = 0.5 * (1 + np.tanh(z / 2))
                total[k, models, 0] += np.logaddexp(0, -sign * z).sum(0)
                total[k, models, 1 : columns + 1] += (p - y[inside, None]).T @ x
                for i, m in enumerate(models):
                    total[k, m, columns + 1 :] += (x.T @ (x * (p[:, i] * (1 - p[:, i]))[:, None])).ravel()
        for k in range(len(windows)):
            if active[k].any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([slot], pa.int64()), pa.array([total[k].tobytes()], pa.binary())], names=["fold", "slot", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in group["sums"])
        return pd.DataFrame({"fold": [group["fold"].iloc[0]], "slot": [group["slot"].iloc[0]], "sums": [total.tobytes()]})

    schema = "fold int, slot long, sums binary"
    out, parts = rows.mapInArrow(partial, schema), rows.rdd.getNumPartitions()
    while parts > FAN_IN:  # so that no task holds the sums of all partitions
        parts = -(-parts // FAN_IN)
        out = out.withColumn("slot", F.pmod("slot", F.lit(parts))).groupBy("fold", "slot").applyInPandas(add, schema)
    got = {r.fold: np.frombuffer(r.sums).reshape(-1, each) for r in out.withColumn("slot", F.lit(0).cast("long")).groupBy("fold").applyInPandas(add, schema).collect()}
    return [got.get(k, np.zeros((weights.shape[1], each))) for k in range(len(windows))]


def least(c: np.ndarray, a: np.ndarray, l1: np.ndarray, u: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Where c u + u a u / 2 + sum(l1 |u|) is least, from a start near it: the weights that aren't zero are solved for under
    their signs; where one would change its sign the way there ends at the best point at which one becomes zero; when
    signs hold, the zero weight that pulls most comes in."""
    u, sign, free = u.copy(), np.sign(u), l1 == 0
    size = np.abs(np.diag(a)).max(initial=0.0)
    slack = 1e-10 * (np.abs(c).max(initial=0.0) + size)
    cost = lambda x: x @ c + (x * (x @ a)).sum(-1) / 2 + np.abs(x) @ l1
    for _ in range(steps):
        on = np.flatnonzero(free | (sign != 0))
        aim = np.zeros(len(u))
        if len(on):
            aim[on] = np.linalg.lstsq(a[np.ix_(on, on)] + np.eye(len(on)) * 1e-12 * size, -(c[on] + l1[on] * sign[on]), rcond=None)[0]
        held = free | (np.sign(aim) == sign)
        if held.all():
            u = aim
            pull = np.where(free | (sign != 0), 0.0, np.abs(a @ u + c) - l1)
            j = int(pull.argmax())
            if pull[j] <= slack:
                break
            sign[j] = -np.sign(a[j] @ u + c[j])
            continue
        turned = np.flatnonzero(~held & (u != 0))
        if not len(turned):  # what came in last turns at once: it adds nothing
            sign[~held] = 0
            continue
        shares = np.append(u[turned] / (u[turned] - aim[turned]), 1.0)
        ways = u + shares[:, None] * (aim - u)
        ways[np.arange(len(turned)), turned] = 0.0
        u = ways[int(cost(ways).argmin())]
        sign = np.sign(u)
    return u


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The weights at which each model's quadratic with its penalties is least. w, g: (model, column); h: (model, column,
    column); the last column has no penalty."""
    ones = np.append(np.ones(w.shape[1] - 1), 0.0)
    return np.stack([least(g[m] - h[m] @ w[m], h[m] + np.diag(l2[m] * ones), l1[m] * ones, w[m]) for m in range(len(w))])


def fit_all(rows: DataFrame, windows: Sequence[Window], penalties: Sequence[tuple[float, float]]) -> np.ndarray:
    """Weights (window, model, column) of logistic regressions that make the mean loss plus l1 times the absolute weights
    plus l2 / 2 times their squares least; the last column is the constant, which no penalty holds.

    rows: place, y, x (an array without nulls). penalties: for each model C and the share of l1; as in
    the pipeline, what is shared out is 1 / (C rows). A step that doesn't lower the sum is halved."""
    width, models = len(windows[0].shift) + 1, len(penalties)
    n = np.array([w.cut for w in windows], float)
    strength = np.array([1 / (c * n) for c, _ in penalties]).T
    share = np.array([s for _, s in penalties])
    l1, l2 = strength * share, strength * (1 - share)

    def cost(loss: np.ndarray, w: np.ndarray) -> np.ndarray:
        inner = w[:, :, :-1]
        return loss / n[:, None] + l1 * np.abs(inner).sum(2) + l2 / 2 * (inner**2).sum(2)

    now, tried = np.zeros((len(windows), models, width)), np.zeros((len(windows), models, width))
    best = np.full((len(windows), models), np.inf)
    active, halvings = np.ones(best.shape, bool), np.zeros(best.shape, int)
    for _ in range(PASSES):
        sums = np.stack(_sums(rows, windows, tried, active))
        value = np.where(active, cost(sums[:, :, 0], tried), best)
        better = active & (value <= best + 1e-12 * (1 + np.abs(value)))
        gained = np.where(np.isfinite(best), best - value, np.inf)
        done = (better & (gained <= TOLERANCE * (1 + np.abs(value)))) | (active & ~better & (halvings > 30))
        now = np.where(better[:, :, None], tried, now)
        best = np.where(better, value, best)
        worse = active & ~better
        halvings = np.where(worse, halvings + 1, 0)
        tried = np.where(worse[:, :, None], (now + tried) / 2, tried)
        go = np.nonzero(better & ~done)
        if len(go[0]):
            scale = n[go[0]][:, None]
            g = sums[go][:, 1 : width + 1] / scale
            h = sums[go][:, width + 1 :].reshape(-1, width, width) / scale[:, :, None]
            tried[go] = _step(now[go], g, h, l1[go], l2[go])
        active = active & ~done
        if not active.any():
            break
    return now


def search(rows: DataFrame, windows: Sequence[Window], penalties: Sequence[tuple[float, float]]) -> list[list[float | None]]:
    """For each window the area under the curve that each model has on the rows tested."""
    weights = fit_all(rows, windows, penalties)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, y = np.asarray(batch.column("place")), np.asarray(batch.column("y"))
            for k, window in enumerate(windows):
                inside = np.flatnonzero((place > window.cut) & (place <= window.cut + window.size))
                if len(inside):
                    z = _matrix(batch, window, inside) @ weights[k].T
                    model = np.tile(np.arange(z.shape[1], dtype=np.int32) + np.int32(k * z.shape[1]), len(inside))
                    yield pa.record_batch([pa.array(model), pa.array(np.repeat(y[inside], z.shape[1])), pa.array(z.ravel())], names=["model", "y", "p"])

    found = {r.model: r.area for r in areas(rows.mapInArrow(score, "model int, y double, p double"), "model").collect()}
    return [[found.get(k * len(penalties) + m) for m in range(len(penalties))] for k in range(len(windows))]
