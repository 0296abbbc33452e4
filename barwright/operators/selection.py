"""Choosing a model among runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARENT = "parent_run_id"


def get_runs(runs: DataFrame, experiment: str, limit: int | None = None) -> DataFrame:
    """The child runs of an experiment, newest first."""
    out = runs.where((F.col("experiment") == experiment) & F.col("tags")[PARENT].isNotNull()).orderBy(F.desc("start_time"), "run_id")
    return out if limit is None else out.limit(limit)


def best_run(runs: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The run with the greatest metric, of equals the latest; runs without the metric don't count. One row or none."""
    value = F.col("metrics")[metric]
    best = runs.where(value.isNotNull()).agg(F.max_by(F.struct("run_id", "start_time", value.alias("value")), F.struct(value, F.col("start_time"), F.col("run_id"))).alias("b"))
    return best.where("b is not null").select("b.*")


def find_best_run(runs: DataFrame, metric: str = "roc_auc") -> str:
    row = best_run(runs, metric).first()
    if row is None:
        raise ValueError(f"no run has the metric {metric!r}")
    return row.run_id


def registered_version(versions: DataFrame, run_id: str) -> tuple[str, int]:
    row = versions.where(F.col("run_id") == run_id).orderBy("name", "version").first()
    if row is None:
        raise ValueError(f"no model version belongs to run {run_id!r}")
    return row["name"], row["version"]


def assign_alias(versions: DataFrame, name: str, version: int, alias: str = "champion") -> DataFrame:
    """The versions with the alias given to one of the model's and taken from its others."""
    mine = F.col("name") == name
    new = F.when(mine & (F.col("version") == version), alias).when(mine & (F.col("alias") == alias), F.lit(None)).otherwise(F.col("alias"))
    return versions.withColumn("alias", new)


def with_aliases(versions: DataFrame, given: DataFrame) -> DataFrame:
    """The versions with the newest of the aliases given (name, alias, version, set_at): each is taken from the version that
    had it. A version with several aliases has a row for each."""
    newest = given.groupBy("name", "alias").agg(F.max_by("version", "set_at").alias("version"))
    moved = newest.select("name", "alias", F.lit(True).alias("moved"))
    own = versions.join(moved, ["name", "alias"], "left").withColumn("alias", F.when(F.col("moved").isNull(), F.col("alias")))
    out = own.join(newest.withColumnRenamed("alias", "given"), ["name", "version"], "left")
    return out.withColumn("alias", F.coalesce("given", "alias")).select(versions.columns)


def experiments(runs: DataFrame) -> DataFrame:
    """Experiments with their number of runs and the start of the last one."""
    return runs.groupBy("experiment").agg(F.count(F.lit(1)).alias("runs"), F.max("start_time").alias("last_start"))


def models(versions: DataFrame) -> DataFrame:
    """Models with their number of versions, the latest one, and (alias, version) of each alias, sorted."""
    aliases = F.sort_array(F.collect_set(F.when(F.col("alias").isNotNull(), F.struct("alias", "version"))))
    return versions.groupBy("name").agg(F.countDistinct("version").alias("versions"), F.max("version").alias("latest"), aliases.alias("aliases"))
