"""A staged plan of per-key window expressions in which equal parts are computed once."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.plans.ranks import with_ranks

#: Rolling extremes and ranks of more rows than this don't walk their windows.
WIDE = 128
#: Weight at which the rest of an exponential average is left out.
TINY = 1e-17


def ema_rows(alpha: float) -> int:
    """Rows back after which an observation weighs less than TINY."""
    return 0 if alpha >= 1 else math.ceil(math.log(TINY) / math.log(1 - alpha))


@dataclass(frozen=True)
class Step:
    """A column, or for what no column can say a function that adds it to a frame."""

    column: Column | None
    level: int
    frame: Callable[[DataFrame], DataFrame] | None = None


class WindowPlan:
    """Named steps; a step may use the input's columns and earlier steps.

    A step is known by its text (such as `mean(lag(gk,1),5)`), so features that share a part share its step; Spark
    itself doesn't merge equal window expressions. `apply` lays the steps out by level, one projection each. All windows
    are partitioned by the key (recursive averages by blocks of it), so the plan has one shuffle, and steps that nothing
    asks for are pruned. Rolling steps give null unless all n values are there.
    """

    def __init__(self, key: str = "Ticker", order: str = "Date") -> None:
        self.key, self.order = key, order
        self.window = Window.partitionBy(key).orderBy(order)
        self.steps: dict[str, Step] = {}
        self.outputs: dict[str, str] = {}
        self.renames: dict[str, str] = {}

    def step(self, name: str, make: Callable[..., Column], *needs: str) -> str:
        """A step by name; `make` gets the columns of `needs`."""
        if name not in self.steps:
            level = max([0, *(self.steps[n].level + 1 for n in needs if n in self.steps)])
            self.steps[name] = Step(make(*(F.col(f"`{n}`") for n in needs)), level)
        return name

    def output(self, name: str, step: str) -> None:
        self.outputs[name] = step

    def rename(self, old: str, new: str) -> None:
        """Calls an output, or else a column of the input that is kept, by a new name; nothing if there is none such."""
        if old in self.outputs:
            self.outputs = {new if k == old else k: v for k, v in self.outputs.items()}
        else:
            self.renames[old] = new

    def last(self, n: int) -> Window:
        return self.window.rowsBetween(1 - n, 0)

    # each of these takes and gives names of steps or input columns

    def lag(self, x: str, k: int) -> str:
        return self.step(f"lag({x},{k})", lambda c: F.lag(c, k).over(self.window), x) if k else x

    def change(self, x: str, k: int) -> str:
        return self.step(f"change({x},{k})", lambda c, p: c - p, x, self.lag(x, k))

    def ratio(self, a: str, b: str) -> str:
        return self.step(f"ratio({a},{b})", F.try_divide, a, b)

    def log_ratio(self, a: str, b: str) -> str:
        return self.step(f"ln({a}/{b})", lambda x: F.when(x > 0, F.ln(x)), self.ratio(a, b))

    def simple_return(self, x: str, k: int) -> str:
        return self.step(f"return({x},{k})", lambda r: r - 1, self.ratio(x, self.lag(x, k)))

    def log_return(self, x: str, k: int) -> str:
        return self.log_ratio(x, self.lag(x, k))

    def root(self, x: str) -> str:
        return self.step(f"sqrt({x})", lambda c: F.when(c >= 0, F.sqrt(c)), x)

    def _roll(self, name: str, f: Callable[[Column], Column], x: str, n: int) -> str:
        w = self.last(n)
        return self.step(f"{name}({x},{n})", lambda c: F.when(F.count(c).over(w) == n, f(c).over(w)), x)

    def mean(self, x: str, n: int) -> str:
        return self._roll("mean", F.avg, x, n)

    def std(self, x: str, n: int) -> str:
        return self._roll("std", F.stddev_samp, x, n)

    def var(self, x: str, n: int) -> str:
        return self._roll("var", F.var_samp, x, n)

    def max(self, x: str, n: int) -> str:
        return self._extreme("max", F.max, F.greatest, x, n)

    def min(self, x: str, n: int) -> str:
        return self._extreme("min", F.min, F.least, x, n)

    def _extreme(self, name: str, f: Callable[[Column], Column], of: Callable[..., Column], x: str, n: int) -> str:
        """Wide windows are put together of two parts: rows are cut into blocks of n, so the last n rows are the end of one
        block, whose extreme runs backwards, and the beginning of the next, whose extreme runs forwards. The work of a
        row doesn't depend on n."""
        if n <= WIDE:
            return self._roll(name, f, x, n)
        number = self.step("number()", lambda: F.row_number().over(self.window))
        block = self.step(f"rows({n})", lambda i: F.floor((i - 1) / n), number)
        running = lambda by: lambda c, b: f(c).over(Window.partitionBy(self.key, b).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        here = self.step(f"{name} up to here({x},{n})", running(F.asc(self.order)), x, block)
        from_here = self.step(f"{name} from here({x},{n})", running(F.desc(self.order)), x, block)
        seen = self.step(f"seen({x})", lambda c: F.count(c).over(self.window.rowsBetween(Window.unboundedPreceding, 0)), x)
        all_there = lambda i, s, before: (i >= n) & (s - F.coalesce(before, F.lit(0)) == n)
        return self.step(f"{name}({x},{n})", lambda i, s, before, a, b: F.when(all_there(i, s, before), of(a, b)), number, seen, self.lag(seen, n), here, self.lag(from_here, n - 1))

    def mean_ahead(self, x: str, n: int) -> str:
        """The mean of the next n rows."""
        w = self.window.rowsBetween(1, n)
        return self.step(f"ahead({x},{n})", lambda c: F.when(F.count(c).over(w) == n, F.avg(c).over(w)), x)

    def rank(self, x: str, n: int) -> str:
        """The share of the last n values up to the current one, ties by half. Wide windows are ranked outside the window
        operators (see `ranks`), at the price of one more shuffle."""
        if n > WIDE:
            name = f"rank({x},{n})"
            if name not in self.steps:
                level = self.steps[x].level + 1 if x in self.steps else 1
                self.steps[name] = Step(None, level, lambda df: with_ranks(df, self.key, self.order, x, n, name))
            return name
        values = self.step(f"values({x},{n})", lambda c: F.collect_list(c).over(self.last(n)), x)
        below = lambda c, a: F.size(F.filter(a, lambda v: v < c)) + (F.size(F.filter(a, lambda v: v == c)) + 1) / 2
        return self.step(f"rank({x},{n})", lambda c, a: F.when((F.size(a) == n) & c.isNotNull(), below(c, a) / n), x, values)

    def smooth(self, x: str, alpha: float, wait: int) -> str:
        """The recursive average e = (1 - alpha) e + alpha x over non-null values, null until `wait` of them are there.

        Values are numbered, and the numbers cut into blocks so long that what lies two blocks back weighs nothing. In a
        block the average is a running sum of values scaled up by their number, scaled down again; to that comes the end
        of the block before. So the work is a few running sums, whatever alpha is. Scales stay far from overflow.
        """
        seen = self.step(f"seen({x})", lambda c: F.count(c).over(self.window.rowsBetween(Window.unboundedPreceding, 0)), x)
        if alpha >= 1:
            return self.step(f"smooth({x},1,{wait})", lambda c, n: F.when(n >= wait, c), x, seen)
        q, k = 1 - alpha, ema_rows(alpha)
        size = 64 if k <= 64 else 1024 if k <= 1024 else 1 << (k - 1).bit_length()
        place = self.step(f"place({x},{size})", lambda n: F.pmod(n - 1, F.lit(size)), seen)
        block = self.step(f"block({x},{size})", lambda n: F.floor((n - 1) / size), seen)

        def running(c: Column, n: Column, i: Column, b: Column) -> Column:
            w = Window.partitionBy(self.key, b).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
            return F.sum(F.coalesce(c * F.when(n == 1, 1.0).otherwise(alpha) * F.pow(F.lit(q), -i), F.lit(0.0))).over(w)

        name = f"{x},{alpha!r}"
        local = self.step(f"local({name})", lambda s, i: s * F.pow(F.lit(q), i), self.step(f"running({name})", running, x, seen, place, block), place)
        end = self.step(f"end({name})", lambda c, e, i: F.when(c.isNotNull() & (i == size - 1), e), x, local, place)
        before = self.step(f"before({name})", lambda e: F.last(e, ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, -1)), end)
        whole = lambda c, n, e, i, p: F.when(c.isNotNull() & (n >= wait), e + F.coalesce(F.pow(F.lit(q), i + 1) * p, F.lit(0.0)))
        return self.step(f"smooth({name},{wait})", whole, x, seen, local, place, before)

    def apply(self, df: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """The columns `keep` (all if None; outputs replace columns of their names), then the outputs."""
        keep = tuple(c for c in (df.columns if keep is None else keep) if c not in self.outputs)
        levels: dict[int, dict[str, Step]] = {}
        for name, s in self.steps.items():
            levels.setdefault(s.level, {})[name] = s
        out = df
        for level in sorted(levels):
            columns = {n: s.column for n, s in levels[level].items() if s.frame is None}
            out = out.select("*", *(c.alias(name) for name, c in columns.items())) if columns else out
            for s in levels[level].values():
                out = s.frame(out) if s.frame else out
        return out.select(*(F.col(f"`{c}`").alias(self.renames.get(c, c)) for c in keep), *(F.col(f"`{s}`").alias(name) for name, s in self.outputs.items()))
