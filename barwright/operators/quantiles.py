"""Exact quantiles with linear interpolation, of many columns in few passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half the width, as a share of the values looked at, of the bracket that a sketch gives.
EPSILON = 0.002
#: No aggregation takes an exact value among more values than this, unless equal values keep a bracket from narrowing.
BOUND = 500_000


#: Size of the stored sketches; a quantile of theirs is off by about EPSILON of the values at most, nearly always.
SKETCH_K = 2_000


def sketches(df: DataFrame, columns: Sequence[str], by: str = "Date") -> DataFrame:
    """A row for each value of `by` (such as a day) with a mergeable sketch of every column, null where it has no value. They
    can be stored with the rows and added to day by day; `merged` tells about any days together without reading rows."""
    return df.groupBy(by).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), SKETCH_K).alias(c) for c in columns])


def merged(stored: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """For each column its quantiles at these shares, about; None without values."""
    known = stored.agg(*[F.kll_merge_agg_double(c, SKETCH_K).alias(c) for c in columns])
    row = known.select(*[F.when(F.kll_sketch_get_n_double(c) > 0, F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(float(x))) for x in shares])).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


@dataclass
class _Sought:
    """A quantile on its way: the value lies at rank `at` (from 0) among the `m` values of the bracket."""

    column: str
    at: float
    m: int
    lo: float | None = None
    hi: float | None = None
    open: bool = True

    def inside(self) -> Column:
        c = F.col(self.column)
        return c if self.lo is None else F.when((c >= self.lo) & (c <= self.hi), c)

    def share(self, away: float = 0.0) -> float:
        return min(1.0, max(0.0, (self.at / (self.m - 1) if self.m > 1 else 0.0) + away))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], bound: int = BOUND, stored: DataFrame | None = None) -> dict[str, list[float | None]]:
    """By column, the quantiles of its non-null values; None without any.

    A bracket with more than `bound` values is narrowed by a sketch and a count of what lies below and in it, as often as
    that makes it smaller; the exact value is then taken among those left. So one aggregation holds a bounded number of
    different values. Every pass reads `df`, so give one that is cheap to read.

    stored: `sketches` of the same rows; then the first brackets cost no pass. A bracket that turns out to miss its quantile,
    as a sketch's may, is dropped for one from the rows.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    sought = {(c, i): _Sought(c, p * (counts[c] - 1), counts[c]) for c in columns for i, p in enumerate(probabilities) if counts[c]}
    first = stored is not None
    while wide := [(str(n), s) for n, s in enumerate(sought.values()) if s.open and s.m > bound]:
        if first:
            shares = sorted({s.share(e) for _, s in wide for e in (-EPSILON, EPSILON)})
            told = merged(stored, sorted({s.column for _, s in wide}), shares)
            bracket = {n: [told[s.column][shares.index(s.share(e))] for e in (-EPSILON, EPSILON)] for n, s in wide}
        else:
            bracket = df.agg(*[F.percentile_approx(s.inside(), [s.share(-EPSILON), s.share(EPSILON)], 10_000).alias(n) for n, s in wide]).first().asDict()
        below = lambda n, s: F.count_if(s.inside() < bracket[n][0])  # noqa: B023, E731
        within = lambda n, s: F.count_if(s.inside().between(*bracket[n]))  # noqa: B023, E731
        counted = df.agg(*[x for n, s in wide for x in (below(n, s).alias(f"below {n}"), within(n, s).alias(f"within {n}"))]).first()
        for n, s in wide:
            at, m = s.at - counted[f"below {n}"], counted[f"within {n}"]
            holds = 0 <= at <= m - 1 and m < s.m
            s.open = holds or first
            if holds:
                s.at, s.m, (s.lo, s.hi) = at, m, bracket[n]
        first = False
    if not sought:
        return {c: [None] * len(probabilities) for c in columns}
    row = df.agg(*[F.percentile(s.inside(), s.share()).alias(str(n)) for n, s in enumerate(sought.values())]).first()
    exact = dict(zip(sought, row, strict=True))
    return {c: [exact.get((c, i)) for i in range(len(probabilities))] for c in columns}
