"""Running totals over a whole frame without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.scratch import Scratch


def running_totals(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The frame with `before_<column>` added: the sum of the column over all rows that come earlier in the order, which
    must be a total one.

    Rows are range-partitioned by the order; each partition sums on its own, and the sums of the partitions before it
    come from a table of one row per partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that both uses below see one and the same dealing
    dealt = Scratch(spark, "totals").keep(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in columns])
    mine = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(offsets), "_part")  # as many rows as there are partitions
    return out.select(*df.columns, *[(F.col(f"_off_{c}") + F.coalesce(F.sum(c).over(mine), F.lit(0))).alias(f"before_{c}") for c in columns])
