"""The rank of each value among the last n of its series, at a cost that doesn't grow with n."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def counts_below(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each query the number of places in [low, high) whose rank is under the value.

    Bit by bit from the highest: ranks with the bit unset go to the front in their order, those with it set behind, and each
    query's range is followed to the side of its value's bit; where that is set, all with the bit unset are below. So a
    query takes a step a bit, whatever its range (a wavelet matrix)."""
    low, high, below = low.copy(), high.copy(), np.zeros(len(value), np.int64)
    for bit in reversed(range(int(max(ranks.max(initial=0), value.max(initial=0))).bit_length())):
        set_ = (ranks >> bit) & 1
        unset = np.append(0, np.cumsum(1 - set_))
        at_low, at_high, own = unset[low], unset[high], (value >> bit) & 1 == 1
        below += np.where(own, at_high - at_low, 0)
        low, high = np.where(own, unset[-1] + low - at_low, at_low), np.where(own, unset[-1] + high - at_high, at_high)
        ranks = np.concatenate([ranks[set_ == 0], ranks[set_ == 1]])
    return below


def rolling_ranks(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """For the values from place `first` on the share of the last n that they reach, ties by half; NaN unless n values are
    there and none is NaN."""
    at = np.arange(first, len(x))
    low = np.maximum(at - n + 1, 0)
    missing = np.append(0, np.cumsum(np.isnan(x)))
    whole = (at >= n - 1) & (missing[at + 1] == missing[low])
    _, ranks = np.unique(np.nan_to_num(x), return_inverse=True)
    less = counts_below(ranks, low, at + 1, ranks[at])
    upto = counts_below(ranks, low, at + 1, ranks[at] + 1)
    return np.where(whole, (less + (upto - less + 1) / 2) / n, np.nan)


def with_ranks(df: DataFrame, key: str, order: str, x: str, n: int, name: str) -> DataFrame:
    """The frame with the ranks of column x added. Rows of a partition come in order of key and date; what is carried from
    one block of rows to the next is the last n - 1 values, so a task holds two windows' worth of rows."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = object(), np.empty(0)

        def ranked(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal last, tail
            table = pa.Table.from_batches(rows).combine_chunks()
            keys = np.array(table.column(key).to_pylist(), object)
            values = table.column(x).cast(pa.float64()).to_numpy()
            out = np.empty(len(values))
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            begin = 0
            for end in ends:
                before = tail if keys[begin] == last else np.empty(0)
                whole = np.concatenate([before, values[begin:end]])
                out[begin:end] = rolling_ranks(whole, n, len(before))
                last, tail, begin = keys[begin], whole[-(n - 1) :] if n > 1 else np.empty(0), end
            ready = table.append_column(name, pa.array(out, pa.float64(), mask=np.isnan(out)))
            yield from ready.to_batches(max_chunksize=10_000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= n:
                yield from ranked(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from ranked([b for b in held if b.num_rows])

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
