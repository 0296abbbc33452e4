"""Arithmetic that gives null where the value isn't defined, as ANSI mode would stop the query instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Null stays null, where least and greatest would give a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))
