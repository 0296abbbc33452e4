"""Averages that are carried along a stream whose rows come out of order: EMA and Wilder's RSI by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Values that one matrix product carries an average over.
BLOCK = 128


def carried(values: np.ndarray, alpha: float, last: float, seen: int) -> np.ndarray:
    """The recursive average after each value, going on from `last` if any were seen before."""
    out = np.empty(len(values))
    powers = (1 - alpha) ** np.arange(BLOCK + 1)
    lower = np.tril(powers[np.abs(np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK)))]) * alpha
    for i in range(0, len(values), BLOCK):
        x = values[i : i + BLOCK]
        n = len(x)
        if seen + i == 0:  # the first value counts whole
            last = x[0]
        out[i : i + n] = lower[:n, :n] @ x + powers[1 : n + 1] * last
        last = out[i + n - 1]
    return out


def rsi_of(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """100 without losses, 50 without either."""
    ratio = gain / np.where(loss > 0, loss, 1)
    return np.where(loss > 0, 100 - 100 / (1 + ratio), np.where(gain > 0, 100.0, 50.0))


class Smoother(StatefulProcessor):
    """Rows wait in a map by their time until the watermark has passed them, so they are taken in order whatever order they
    come in; of rows of one key and time the first counts. A timer at its time lets a row out. What is carried on is the
    averages, the last value and how many there were; what waits is the rows of `late` time."""

    def __init__(self, span: int, window: int) -> None:
        self.span, self.window = span, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at timestamp", "value double")
        self.averages = handle.getValueState("averages", "ema double, gain double, loss double, last double, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for time, value in zip(frame["at"], frame["value"].to_numpy(float), strict=True):
                at = (time.to_pydatetime(),)
                if value == value and not self.waiting.containsKey(at):
                    self.waiting.updateValue(at, (float(value),))
                    self.handle.registerTimer(int(time.timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        ready = sorted((at[0], value[0]) for at, value in self.waiting.iterator() if pd.Timestamp(at[0]).timestamp() * 1000 <= mark)
        if not ready:  # an earlier timer let them out
            return
        for at, _ in ready:
            self.waiting.removeKey((at,))
        x = np.array([v for _, v in ready])
        ema, gain, loss, last, seen = self.averages.get() or (0.0, 0.0, 0.0, 0.0, 0)
        averages = carried(x, 2 / (self.span + 1), ema, seen)
        change = np.diff(x, prepend=last) if seen else np.diff(x)
        parts = [carried(c, 1 / self.window, before, max(seen - 1, 0)) for c, before in ((np.maximum(change, 0), gain), (np.maximum(-change, 0), loss))]
        number = seen + np.arange(1, len(x) + 1)
        rsi = rsi_of(*parts)
        rsi = rsi if seen else np.append(np.nan, rsi)
        ends = [p[-1] if len(p) else 0.0 for p in parts]
        self.averages.update((float(averages[-1]), float(ends[0]), float(ends[1]), float(x[-1]), int(number[-1])))
        known = lambda values, enough: pd.array([float(v) if ok else None for v, ok in zip(values, enough, strict=True)], dtype="Float64")
        yield pd.DataFrame({"key": key[0], "at": [at for at, _ in ready], "value": x, "ema": known(averages, number >= self.span), "rsi": known(rsi, number > self.window)})

    def close(self) -> None:
        pass


def smoothed(values: DataFrame, span: int = 20, window: int = 14, late: str = "10 days", key: str = "Ticker", order: str = "Date", value: str = "Close") -> DataFrame:
    """From a stream of key, date or time, and value: each of them once, in order, with `ema` and `rsi`, null until enough
    values are there; a row comes out when the watermark, `late` behind the newest row, has passed it. Null values are
    left out. Rows later than that are dropped (see `admit` for keeping them).

    The state store must be RocksDB (`ROCKS_DB` as spark.sql.streaming.stateStore.providerClass)."""
    rows = values.select(F.col(key).alias("key"), F.col(order).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).where("at is not null")
    schema = f"key {dict(values.dtypes)[key]}, at timestamp, value double, ema double, rsi double"
    out = rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Smoother(span, window), schema, "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.col("at").cast(dict(values.dtypes)[order]).alias(order), F.col("value").alias(value), "ema", "rsi")
