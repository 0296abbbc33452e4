"""Second-order boosted trees over binned columns: learnt from distributed histograms, or whole in one task where the rows
are few, with the same trees either way; and a search that gets every number of trees from one fit."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.scratch import Scratch

#: Values (rows times columns) that one task learns from at most; more are learnt from histograms summed over all tasks.
LOCAL_CELLS = 8_000_000
#: Trees between two written states of a distributed fit: so many are applied on top at most.
REFRESH = 4
BINS = 64
_PRIME = 2**31 - 1


@dataclass(frozen=True)
class Settings:
    """The penalty and the least weight of a child are the other library's defaults."""

    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    seed: int = 42


@dataclass
class Trees:
    """Trees as heaps: node i has children 2i + 1 (values not over the threshold) and 2i + 2; leaves have feature -1."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, test, value in zip(self.feature, self.cut if binned else self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > test[node]), node)
            out += value[node]
        return out

    def nested(self) -> list[tuple[float, float | tuple]]:
        """Each tree as a weight and nested tuples (feature, threshold, left, right)."""

        def node(t: int, i: int) -> float | tuple:
            f = int(self.feature[t, i])
            return float(self.value[t, i]) if f < 0 else (f, float(self.threshold[t, i]), node(t, 2 * i + 1), node(t, 2 * i + 2))

        return [(1.0, node(t, 0)) for t in range(len(self.feature))]

    def to_json(self) -> str:
        return json.dumps({"start": self.start} | {k: getattr(self, k).tolist() for k in ("feature", "cut", "threshold", "value")})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        whole = lambda k, t: np.array(d[k], t).reshape(len(d[k]), -1)
        return cls(d["start"], whole("feature", np.int64), whole("cut", np.int64), whole("threshold", float), whole("value", float))


def drawn(place, tree: int, rate: float, seed: int):
    """Whether a tree learns from the row of that number: arithmetic that numpy and Spark do alike."""
    u = (place * 16807 + (tree * 48271 + seed * 69621 + 1)) % _PRIME
    u = (u * (u + tree) + 7919) % _PRIME
    u = (u * (u + 104729) + tree) % _PRIME
    return u < int(rate * _PRIME)


def columns_of(tree: int, n: int, rate: float, seed: int) -> np.ndarray:
    """The columns that a tree may split on."""
    return np.sort(np.random.default_rng([seed, tree]).permutation(n)[: max(1, int(n * rate))])


def prior(positive: float, n: float) -> float:
    """The log odds that all rows start from."""
    return math.log(positive / (n - positive)) if 0 < positive < n else 0.0


def best_splits(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """For histograms of gradients and curvatures (node, column, bin): gain, column, bin and left sums of each node's best
    split; ties go to the first column and bin. Gains are compared to nine digits, so the order of sums has no say."""
    left_g, left_h = g.cumsum(2), h.cumsum(2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + s.reg_lambda) + right_g**2 / (right_h + s.reg_lambda) - all_g**2 / (all_h + s.reg_lambda)
    fits = (left_h >= s.min_child_weight) & (right_h >= s.min_child_weight) & allowed[None, :, None]
    gain = np.where(fits, gain.round(9), -np.inf).reshape(len(g), -1)
    best = gain.argmax(1)
    at = (np.arange(len(g)), best // g.shape[2], best % g.shape[2])
    return gain[at[0], best], at[1], at[2], left_g[at], left_h[at]


class _Heap:
    """One tree while it grows; nodes of a level are opened from the splits of the level before."""

    def __init__(self, s: Settings, edges: Sequence[np.ndarray], g: float, h: float) -> None:
        n = 2 ** (s.max_depth + 1) - 1
        self.s, self.edges = s, edges
        self.feature, self.cut, self.threshold = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n)
        self.g, self.h = np.zeros(n), np.zeros(n)
        self.g[0], self.h[0] = g, h
        self.open = [0]

    def split(self, node: int, gain: float, column: int, cut: int, g: float, h: float) -> None:
        """Splits an open node if that gains anything; `g` and `h` are the sums on the left."""
        self.open.remove(node)
        if gain > 1e-6:
            self.feature[node], self.cut[node], self.threshold[node] = column, cut, self.edges[column][cut]
            left, right = 2 * node + 1, 2 * node + 2
            self.g[left], self.h[left], self.g[right], self.h[right] = g, h, self.g[node] - g, self.h[node] - h
            self.open += [left, right]

    def values(self) -> np.ndarray:
        return np.where(self.feature < 0, -self.s.learning_rate * self.g / (self.h + self.s.reg_lambda), 0.0) * (self.h > 0)


def _stacked(start: float, heaps: Sequence[_Heap], s: Settings) -> Trees:
    n = 2 ** (s.max_depth + 1) - 1
    pile = lambda parts, t: np.stack(parts) if parts else np.empty((0, n), t)
    return Trees(start, pile([t.feature for t in heaps], np.int64), pile([t.cut for t in heaps], np.int64), pile([t.threshold for t in heaps], float), pile([t.values() for t in heaps], float))


def grow(codes: np.ndarray, y: np.ndarray, place: np.ndarray, edges: Sequence[np.ndarray], s: Settings, later: np.ndarray | None = None, stages: Sequence[int] = ()) -> tuple[Trees, dict[int, np.ndarray]]:
    """Trees from rows in memory (codes: bins by row and column), and the margins of the `later` rows after so many trees.
    Of two children only the smaller one's histogram is counted; the other's is what remains of the parent's."""
    n, width, bins = len(codes), codes.shape[1], BINS
    flat = codes.astype(np.int64) + np.arange(width) * bins
    cells, start = width * bins, prior(float(y.sum()), len(y))
    margin, heaps = np.full(n, start), []
    seen = np.full(0 if later is None else len(later), start)
    staged: dict[int, np.ndarray] = {}

    def histogram(rows: np.ndarray, slot: np.ndarray, slots: int, *weights: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(slots * cells) for _ in weights]
        for i in range(0, len(rows), 2048):
            at = (flat[rows[i : i + 2048]] + (slot[i : i + 2048] * cells)[:, None]).ravel()
            for total, w in zip(out, weights, strict=True):
                total += np.bincount(at, np.repeat(w[rows[i : i + 2048]], width), slots * cells)
        return [x.reshape(slots, width, bins) for x in out]

    for tree in range(s.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        rows = np.flatnonzero(drawn(place, tree, s.subsample, s.seed)) if s.subsample < 1 else np.arange(n)
        allowed = np.zeros(width, bool)
        allowed[columns_of(tree, width, s.colsample_bytree, s.seed)] = True
        heap, node = _Heap(s, edges, float(g[rows].sum()), float(h[rows].sum())), np.zeros(n, np.int64)
        known: dict[int, list[np.ndarray]] = {}
        for level in range(s.max_depth):
            todo = list(heap.open)
            if not todo:
                break
            mine = node[rows]
            sizes = np.bincount(mine, minlength=2 ** (s.max_depth + 1))
            count = todo if level == 0 else [c if sizes[c] <= sizes[c + 1] else c + 1 for c in todo[::2]]
            slot_of = np.full(2 ** (s.max_depth + 1), -1)
            slot_of[count] = np.arange(len(count))
            inside = slot_of[mine] >= 0
            made = histogram(rows[inside], slot_of[mine[inside]], len(count), g, h)
            now = {c: [x[i] for x in made] for i, c in enumerate(count)}
            for c in todo:
                if c not in now:
                    other = c + 1 if c % 2 else c - 1
                    now[c] = [a - b for a, b in zip(known[(c - 1) // 2], now[other], strict=True)]
            known = now
            found = best_splits(np.stack([now[c][0] for c in todo]), np.stack([now[c][1] for c in todo]), allowed, s)
            for c, *split in zip(todo, *found, strict=True):
                heap.split(c, *split)
            f = heap.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (codes[np.arange(n), np.maximum(f, 0)] > heap.cut[node]), node)
        margin += heap.values()[node]
        heaps.append(heap)
        if later is not None:
            seen = seen + _stacked(0.0, [heap], s).margin(later, binned=True)
            if tree + 1 in stages:
                staged[tree + 1] = seen
    return _stacked(start, heaps, s), staged


def bin_edges(rows: DataFrame, width: int, x: str = "x") -> list[np.ndarray]:
    """For each column the values that bins end at: quantiles of the column, each value once."""
    names = [f"c{i}" for i in range(width)]
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.select(*[F.col(x)[i].alias(c) for i, c in enumerate(names)]).approxQuantile(names, shares, 0.001)
    return [np.unique(np.array(q, float)) for q in found]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, width)


def area(y: np.ndarray, score: np.ndarray) -> float | None:
    """The share of pairs of a positive and a negative row in the right order, ties by half."""
    values, at = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(at, y, len(values)), np.bincount(at, 1 - y, len(values))
    pairs = pos.sum() * neg.sum()
    return float((pos * (neg.cumsum() - neg / 2)).sum() / pairs) if pairs else None


def _in_one_task(rows: DataFrame, edges: Sequence[np.ndarray], s: Settings) -> Trees:
    """rows: place, y, x. One group that holds all of them, which its caller has checked to be few."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        codes = binned(np.stack(group["x"].to_numpy()), edges)
        trees, _ = grow(codes, group["y"].to_numpy(float), group["place"].to_numpy(np.int64), edges, s)
        return pd.DataFrame({"trees": [trees.to_json()]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "trees string").first()
    return Trees.from_json(got.trees)


def _walk(heap: _Heap, codes: Column) -> Column:
    """The node at which a row is, as an expression."""

    def at(i: int) -> Column:
        f = int(heap.feature[i])
        return F.lit(i) if f < 0 else F.when(codes[f] <= int(heap.cut[i]), at(2 * i + 1)).otherwise(at(2 * i + 2))

    return at(0)


def _distributed(rows: DataFrame, edges: Sequence[np.ndarray], s: Settings, scratch: Scratch) -> Trees:
    """rows: place, y, x. Each level is one aggregation: histograms are partial sums in the tasks, the best split of each
    node is found from running sums over bins, and a row a node comes to the driver. Nothing else does."""
    width = len(edges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = binned(_matrix(batch, width), edges).astype(np.int16)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), width).cast(pa.list_(pa.int16()))
            yield pa.record_batch([batch.column("place"), batch.column("y"), lists], names=["place", "y", "codes"])

    coded = scratch.keep(rows.select("place", "y", "x").mapInArrow(encode, "place long, y double, codes array<smallint>"), "codes")
    n, positive = coded.agg(F.count("y"), F.sum("y")).first()
    start, heaps = prior(positive or 0.0, n), []
    state = coded.withColumn("margin", F.lit(start))
    for tree in range(s.n_estimators):
        if tree and tree % REFRESH == 0:
            state = scratch.keep(state, f"state {tree}")
            if tree > REFRESH:
                scratch.drop(f"state {tree - REFRESH}")
        p = 1 / (1 + F.exp(-F.col("margin")))
        used = state.where(drawn(F.col("place"), tree, s.subsample, s.seed)) if s.subsample < 1 else state
        used = used.withColumn("p", p).select("codes", (F.col("p") - F.col("y")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        heap = _Heap(s, edges, 0.0, 0.0)
        columns = columns_of(tree, width, s.colsample_bytree, s.seed)
        for level in range(s.max_depth):
            if not heap.open:
                break
            here = used.withColumn("node", _walk(heap, F.col("codes"))).where(F.col("node").isin(heap.open))
            cells = here.select("node", "g", "h", F.explode(F.array(*[F.struct(F.lit(int(c)).alias("column"), F.col("codes")[int(c)].cast("int").alias("bin")) for c in columns])).alias("at"))
            cells = cells.groupBy("node", "at.column", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            whole = Window.partitionBy("node", "column")
            upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            sums = cells.select("node", "column", "bin", *[F.sum(c).over(w).alias(f"{side}_{c}") for c in "gh" for side, w in (("left", upto), ("all", whole))])
            part = lambda g, h: g * g / (h + s.reg_lambda)
            lg, lh, ag, ah = (F.col(c) for c in ("left_g", "left_h", "all_g", "all_h"))
            gain = F.round(part(lg, lh) + part(ag - lg, ah - lh) - part(ag, ah), 9)
            fits = (lh >= s.min_child_weight) & (ah - lh >= s.min_child_weight)
            best = F.min(F.when(fits, F.struct((-gain).alias("loss"), "column", "bin", "left_g", "left_h"))).alias("best")
            for r in sums.groupBy("node").agg(best, F.max_by(F.struct("all_g", "all_h"), -F.col("column")).alias("sums")).orderBy("node").collect():
                if level == 0:
                    heap.g[0], heap.h[0] = r.sums.all_g, r.sums.all_h
                heap.split(r.node, *((-r.best.loss, r.best.column, r.best.bin, r.best.left_g, r.best.left_h) if r.best else (0.0, 0, 0, 0.0, 0.0)))
            heap.open = [i for i in heap.open if i >= 2 ** (level + 1) - 1]
        heaps.append(heap)
        values = heap.values()
        leaf = lambda i: F.lit(float(values[i])) if heap.feature[i] < 0 else F.when(F.col("codes")[int(heap.feature[i])] <= int(heap.cut[i]), leaf(2 * i + 1)).otherwise(leaf(2 * i + 2))  # noqa: B023, E731
        state = state.withColumn("margin", F.col("margin") + leaf(0))
    return _stacked(start, heaps, s)


def fit_trees(rows: DataFrame, n: int, width: int, s: Settings, local_cells: int = LOCAL_CELLS) -> Trees:
    """Trees from rows of place (a number of its own), y (0 or 1) and x (an array without nulls)."""
    scratch = Scratch(rows.sparkSession, "boosting")
    edges = bin_edges(rows, width)
    if n * width <= local_cells:
        return _in_one_task(rows, edges, s)
    return _distributed(rows, edges, s, scratch)


def search(rows: DataFrame, width: int, folds: Sequence[tuple[int, int]], points: Sequence[dict], local_cells: int = LOCAL_CELLS) -> list[list[float | None]]:
    """For each window (rows to learn from, rows after them to test on) and each point the area under the curve.

    rows: place (from 1, in time order), y, x. Points that differ in nothing but their number of trees are one fit, scored
    as it grows. Windows that a task can hold are dealt out, one task a fit; larger ones are fitted one by one over all
    tasks. Bins are those of the window's own rows to learn from.
    """
    spark = rows.sparkSession
    plain = [Settings(**p) for p in points]
    fits: dict[Settings, list[int]] = {}
    for s in plain:
        fits.setdefault(replace(s, n_estimators=0), []).append(s.n_estimators)
    with ThreadPoolExecutor(len(folds)) as pool:  # one job each
        edges = list(pool.map(lambda fold: bin_edges(rows.where(F.col("place") <= fold[0]), width), folds))
    scores: dict[tuple[int, Settings], float | None] = {}
    small = [k for k, (cut, size) in enumerate(folds) if (cut + size) * width <= local_cells]
    if small:

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, place = _matrix(batch, width), np.asarray(batch.column("place"))
                for k in small:
                    inside = np.flatnonzero(place <= sum(folds[k]))
                    codes = binned(x[inside], edges[k])
                    columns = [pa.array(np.full(len(inside), k, np.int32)), batch.column("place").take(pa.array(inside)), batch.column("y").take(pa.array(inside)), pa.array([r.tobytes() for r in codes], pa.binary())]
                    yield pa.record_batch(columns, names=["fold", "place", "y", "codes"])

        kinds = list(fits)
        jobs = spark.createDataFrame([(k, j) for k in small for j in range(len(kinds))], "fold int, job int")

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("place")
            k, j = int(group["fold"].iloc[0]), int(group["job"].iloc[0])
            codes = np.frombuffer(b"".join(group["codes"]), np.uint8).reshape(len(group), width)
            y, place = group["y"].to_numpy(float), group["place"].to_numpy(np.int64)
            early = place <= folds[k][0]
            stages = fits[kinds[j]]
            _, margins = grow(codes[early], y[early], place[early], edges[k], replace(kinds[j], n_estimators=max(stages)), codes[~early], stages)
            return pd.DataFrame([(k, j, n, area(y[~early], margins[n])) for n in dict.fromkeys(stages)], columns=["fold", "job", "trees", "auc"])

        ready = rows.select("place", "y", "x").mapInArrow(encode, "fold int, place long, y double, codes binary").join(jobs, "fold")
        # a number of its own: small as the rows are, each fit shall be a task
        dealt = ready.repartition(len(small) * len(kinds), "fold", "job")
        for r in dealt.groupBy("fold", "job").applyInPandas(fit, "fold int, job int, trees int, auc double").collect():
            scores[r.fold, replace(kinds[r.job], n_estimators=r.trees)] = r.auc
    for k, (cut, size) in enumerate(folds):
        if k in small:
            continue
        early, later = rows.where(F.col("place") <= cut), rows.where((F.col("place") > cut) & (F.col("place") <= cut + size))
        for kind, stages in fits.items():
            trees = _distributed(early, edges[k], replace(kind, n_estimators=max(stages)), Scratch(spark, "boosting"))
            for n in dict.fromkeys(stages):
                scores[k, replace(kind, n_estimators=n)] = _area_of(later, first_trees(trees, n))
    return [[scores[k, s] for s in plain] for k in range(len(folds))]


def first_trees(trees: Trees, n: int) -> Trees:
    return Trees(trees.start, trees.feature[:n], trees.cut[:n], trees.threshold[:n], trees.value[:n])


def margins(trees: Trees):
    """A function that gives the margins of a column of arrays."""

    @F.pandas_udf("double")
    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(trees.margin(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

    return margin


def _area_of(rows: DataFrame, trees: Trees) -> float | None:
    from barwright.operators.metrics import classification_metrics

    return classification_metrics(rows.select(F.col("y").alias("label"), margins(trees)("x").alias("probability"))).first().roc_auc


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a stage of a pipeline: adds rawPrediction, probability and prediction."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "column of vectors", TypeConverters.toString)

    def __init__(self, trees: Trees | None = None, featuresCol: str = "features") -> None:  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(featuresCol=featuresCol)
        if trees is not None:
            self._set(trees=trees.to_json())

    def read_trees(self) -> Trees:
        return Trees.from_json(self.getOrDefault(self.trees))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [f"{self.uid}_margin", f"{self.uid}_p"]
        out = dataset.withColumn(names[0], margins(self.read_trees())(vector_to_array(self.getOrDefault(self.featuresCol))))
        out = out.withColumn(names[1], 1 / (1 + F.exp(-F.col(names[0]))))
        m, p = map(F.col, names)
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1 - p, p)), "prediction": (m > 0).cast("double")}).drop(*names)


class BoostedTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns `Settings` trees from a column of vectors and a label of 0 or 1. Rows are numbered by placeCol where the frame
    has it, which makes the draws repeatable; else they are numbered as they are written."""

    featuresCol = Param(Params._dummy(), "featuresCol", "column of vectors", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column of labels", TypeConverters.toString)
    placeCol = Param(Params._dummy(), "placeCol", "column of row numbers", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "the settings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol: str = "features", labelCol: str = "label", placeCol: str = "position", settings: str = "{}") -> None:  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", placeCol="position", settings="{}")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, **settings) -> BoostedTrees:
        unknown = set(settings) - {f.name for f in fields(Settings)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(settings=json.dumps(settings))

    def read_settings(self) -> Settings:
        return Settings(**json.loads(self.getOrDefault(self.settings)))

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        place = self.getOrDefault(self.placeCol)
        x, y = vector_to_array(self.getOrDefault(self.featuresCol)).alias("x"), F.col(self.getOrDefault(self.labelCol)).cast("double").alias("y")
        number = F.col(place).cast("long") if place in dataset.columns else F.monotonically_increasing_id()
        rows = Scratch(dataset.sparkSession, "boosting").keep(dataset.select(number.alias("place"), y, x).dropna("any"), "rows")
        n, width = rows.agg(F.count("y"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to learn from")
        return BoostedTreesModel(fit_trees(rows, n, width, self.read_settings()), self.getOrDefault(self.featuresCol))
