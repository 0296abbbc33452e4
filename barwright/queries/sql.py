"""DuckDB text for the oracles: bars, and null-safe windows over them."""

from __future__ import annotations


def _bars(ticker: str, day: str, price: str, order: str, volume: str, table: str) -> str:
    return f"""SELECT CAST({day} AS DATE) AS "Date", {ticker} AS "Ticker", first({price} ORDER BY {order}) AS "Open", max({price}) AS "High",
        min({price}) AS "Low", last({price} ORDER BY {order}) AS "Close", CAST(sum({volume}) AS BIGINT) AS "Volume" FROM {table} GROUP BY ALL"""


_LINE = ("l_shipdate", "l_extendedprice / l_quantity", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity", "l_quantity", "lineitem")
BARS = {
    "bars": _bars("l_returnflag", *_LINE),
    "spy": _bars("'SPY'", *_LINE),
    "vix": _bars("'^VIX'", "o_orderdate", "o_totalprice", "o_orderkey", "0", "orders"),
    "bars_evt": _bars("event_type", "ts", "value", "ts, event_id", "1", "events"),
}


def w(n: int) -> str:
    return f'(PARTITION BY "Ticker" ORDER BY "Date" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)'


def roll(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {f}({x}) OVER {w(n)} END"


def lag(x: str, k: int) -> str:
    return f'lag({x}, {k}) OVER (PARTITION BY "Ticker" ORDER BY "Date")'


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def staged(stages: list[dict[str, str]], outputs: dict[str, tuple[str, int | None]], table: str = "bars", known: bool = False) -> str:
    """SELECT Ticker, Date and outputs (expression, decimals), after stages of named expressions; `known`: the bars are
    a view that stands already."""
    parts, last = ([] if known else [f"bars AS ({BARS[table]})"]), table if known else "bars"
    for i, stage in enumerate(stages):
        parts.append(f"s{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {last})")
        last = f"s{i}"
    shown = ", ".join(f'{x if d is None else f"round({x}, {d})"} AS "{n}"' for n, (x, d) in outputs.items())
    return f'{f"WITH {", ".join(parts)} " if parts else ""}SELECT "Ticker", "Date", {shown} FROM {last}'
