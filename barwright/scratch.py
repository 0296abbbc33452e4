"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a temporary one
    that goes at exit. On a cluster executors would not see it, so there the setting is asked for."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        where = tempfile.mkdtemp(prefix="barwright-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Names for the tables of one operator call. A written table cuts the lineage and outlives a lost executor."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The written frame and its number of rows, which its files' footers tell."""
        kept = self.keep(df, name)
        return kept, kept.count()

    def drop(self, name: str) -> None:
        """For tables that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
