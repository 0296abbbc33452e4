"""What the operators share: written tables, and columns whose names are in the way."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from barwright.scratch import Scratch, shared_dir

__all__ = ["Scratch", "set_aside", "shared_dir"]


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with columns of these names (in any case) called otherwise, and what gives back the first names and no
    other columns."""
    taken = {n.lower() for n in names}
    other = {c: f"own {i} {c}" if c.lower() in taken else c for i, c in enumerate(df.columns)}
    return df.withColumnsRenamed({c: o for c, o in other.items() if c != o}), lambda out: out.select(*[out[f"`{o}`"].alias(c) for c, o in other.items()])
