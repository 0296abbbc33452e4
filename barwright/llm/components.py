"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Each node's larger neighbours are linked with the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), name)
    return both.where("b > a").join(least.hint("merge"), "a").select(F.col("least").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    joined = edges.join(least.hint("merge"), "b")
    return joined.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Minima are taken with map-side partial sums, and the joins back have shuffles that adaptive execution can split,
    so a node with very many links is no task of its own. Each pass is written to the shared folder. Both stars leave
    the components as they are; when a pass changes nothing, every node is linked with its smallest one only.
    Links of a node with itself, repeated links and nulls are ignored; no links give no rows.
    """
    e = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = scratch.keep(e, f"{name}-0")
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, i = sign(e), 0
    while before[0]:
        i += 1
        e = scratch.keep(_small_star(_large_star(e, scratch, f"{name}-least")), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
