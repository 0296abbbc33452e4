"""Stored tables: named datasets, inserts in one commit, logs, runs and model versions, over files or JDBC."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence
from datetime import date
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.ingest import absent
from barwright.operators.selection import with_aliases
from barwright.schema import MODEL_ALIAS, MODEL_VERSION, PREDICTION_LOG, TABLES
from barwright.scratch import Scratch
from barwright.sources.commits import CommitLog, Snapshot


class Store:
    """Parquet tables under one folder, by name, as numbered commits (see `commits`): readers see whole commits only, and
    of two writers at once one acts as if it had come after the other. A known table that was never written has no
    rows. Folders of plain Parquet files, as other programs write them, can be read too."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, self.path(name))

    def read(self, name: str, start: str | date | None = None, end: str | date | None = None) -> DataFrame:
        """The table as it is now. With a range of dates rows outside it may be missing: files that hold none of it aren't
        read. Only a table that isn't there counts as empty; one that has lost its files is an error."""
        return self._as_of(name, self.log(name).snapshot(), start, end)

    def _as_of(self, name: str, snapshot: Snapshot, start: str | date | None = None, end: str | date | None = None) -> DataFrame:
        if snapshot.version:
            return self.log(name).read(snapshot, start, end)
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException as e:
            if name not in TABLES or e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], TABLES[name][0])

    def _by_year(self, name: str) -> str | None:
        return "Date" if name in TABLES and "Date" in TABLES[name][0].names else None

    def write(self, name: str, df: DataFrame) -> None:
        """The table anew."""
        self.log(name).commit(lambda _: df, self._by_year(name), replaces=True, blind=True)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows whatever else is added meanwhile."""
        self.log(name).commit(lambda s: self._joined(name, s, df), self._by_year(name), replaces=self._is_plain(name), blind=not self._is_plain(name))

    def _is_plain(self, name: str) -> bool:
        """Whether the table is a folder of Parquet files without commits; its first commit takes them over."""
        log = self.log(name)
        return not log.exists() and log._fs.exists(log._hadoop(""))

    def _joined(self, name: str, snapshot: Snapshot, df: DataFrame) -> DataFrame:
        return self._as_of(name, snapshot).unionByName(df) if not snapshot.version and self._is_plain(name) else df

    def create_schemas(self) -> None:
        """Every known table, empty, where it isn't there yet."""
        for name, (schema, _) in TABLES.items():
            log = self.log(name)
            if not log._fs.exists(log._hadoop("")):
                log.publish(1, {}, schema)

    def tables(self) -> list[str]:
        """Names of the folders that hold a table; models and data sets lie in folders with an underscore."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(hadoop) if f.isDirectory() and not f.getPath().getName().startswith("_")) if fs.exists(hadoop) else []

    def compact(self, name: str, parts: int | None = None) -> None:
        """Many small appends become few files (a year each, for bars); readers of the old ones aren't disturbed."""
        self.log(name).compact(self._by_year(name), parts)

    def insert_if_absent(self, name: str, new: DataFrame, key: Sequence[str] | None = None) -> None:
        """Adds the rows whose key is not stored, all or none of them; of two writers with one key the first to commit wins.
        The plan of `new` runs once, into a written table. Of the stored rows only files between the first and last new
        date are read, where the key has a date."""
        key = list(key or TABLES[name][1])
        staged = Scratch(self.spark, "insert").keep(new, name)
        dates = [F.min("Date"), F.max("Date")] if "Date" in key else []
        n, *span = staged.agg(F.count(F.lit(1)), *dates).first()
        if not n:
            return

        def rows(snapshot: Snapshot) -> DataFrame:
            stored = self._as_of(name, snapshot, *span)
            fresh = absent(staged.select(stored.columns), stored.where(F.col("Date").between(*map(F.lit, span))) if span and span[0] else stored, key)
            return self._joined(name, snapshot, fresh)

        self.log(name).commit(rows, self._by_year(name), replaces=self._is_plain(name))

    def insert_stock_data(self, new: DataFrame) -> None:
        self.insert_if_absent("stock_data", new)

    def insert_spy_data(self, new: DataFrame) -> None:
        self.insert_if_absent("spy_data", new)

    def insert_vix_data(self, new: DataFrame) -> None:
        self.insert_if_absent("vix_data", new)

    def save_pipeline(self, name: str, pipeline: Pipeline) -> None:
        """A pipeline that has learnt nothing yet."""
        pipeline.write().overwrite().save(f"{self.base}/_pipelines/{name}")

    def load_pipeline(self, name: str) -> Pipeline:
        return Pipeline.load(f"{self.base}/_pipelines/{name}")

    def register(self, trained, experiment: str, name: str, tags: dict[str, str]) -> int:
        """Stores a trained model, its run (parameters, metrics, tags), the test rows with their predictions if it has them, and
        a new version of the named model, which is returned. The version's row comes last: what it names is there. Versions
        of writers at once are different, as each is numbered after the commits before it."""
        path = f"{self.base}/_models/{trained.run_id}"
        trained.model.write().overwrite().save(path)
        if trained.evaluated is not None:
            trained.evaluated.write.mode("overwrite").parquet(f"{self.base}/_evaluated/{trained.run_id}")
            tags = tags | {"evaluated_data": f"{self.base}/_evaluated/{trained.run_id}"}
        self.append("runs", trained.run(self.spark, experiment, tags))
        given = 0

        def row(snapshot: Snapshot) -> DataFrame:
            nonlocal given
            given = (self._as_of("model_versions", snapshot).where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
            return self._joined("model_versions", snapshot, self.spark.createDataFrame([(name, given, trained.run_id, path, None)], MODEL_VERSION))

        self.log("model_versions").commit(row, replaces=self._is_plain("model_versions"))
        return given

    def set_alias(self, name: str, version: int, alias: str = "champion") -> None:
        """Aliases are appended, so that no reader meets a table half rewritten; the newest one counts."""
        if self.read("model_versions").where((F.col("name") == name) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"model {name!r} has no version {version}")
        self.append("model_aliases", self.spark.createDataFrame([(name, alias, version, time.time_ns())], MODEL_ALIAS))

    def versions(self) -> DataFrame:
        return with_aliases(self.read("model_versions"), self.read("model_aliases"))

    def log_predictions(self, scored: DataFrame) -> None:
        """Appends predictions (ticker, prediction, probability, model_name, model_version and, if known, actual_outcome
        and correct), each with an id of its own and the present time."""
        row = scored.withColumns({"prediction_id": F.expr("uuid()"), "timestamp": F.current_timestamp()})
        columns = [(F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PREDICTION_LOG]
        self.append("prediction_logs", row.select(*columns))

    def prediction_logs(self, limit: int = 50) -> DataFrame:
        return newest(self.read("prediction_logs"), limit)


def newest(logs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest rows, ties by id: a top-k in every task, not a sort of all."""
    return logs.orderBy(F.desc("timestamp"), F.desc("prediction_id")).limit(limit)


def export(runs: DataFrame, path: str, kind: str = "json") -> None:
    """Runs as JSON lines or CSV; CSV can't hold maps, so they become JSON text."""
    if kind == "csv":
        runs = runs.select(*[F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in runs.dtypes])
        runs.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        runs.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def jdbc_options(env: dict[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source for a PostgreSQL server named in the environment; encrypted unless DB_SSLMODE says
    otherwise."""
    env = dict(os.environ) if env is None else env
    missing = [k for k in ("DB_HOST", "DB_NAME", "DB_USER", "DB_PASSWORD") if not env.get(k)]
    if missing:
        raise KeyError(f"not set: {', '.join(missing)}")
    url = f"jdbc:postgresql://{env['DB_HOST']}:{env.get('DB_PORT', '5432')}/{env['DB_NAME']}?sslmode={env.get('DB_SSLMODE', 'require')}"
    return {"url": url, "user": env["DB_USER"], "password": env["DB_PASSWORD"], "driver": "org.postgresql.Driver"}


def read_jdbc(spark: SparkSession, name: str, column: str | None = None, bounds: tuple[str, str] | None = None, parts: int = 8) -> DataFrame:
    """A table of the server; with a column and its bounds, read in so many parts at once. Filters are pushed down."""
    reader = spark.read.format("jdbc").options(**jdbc_options()).option("dbtable", name)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(parts))
    return reader.load()


def datasets(base: str | Path) -> dict[str, str]:
    """Paths of the named datasets, by the layer that they belong to."""
    raw = ("stock_data", "spy_data", "vix_data")
    features = ("all_features", "lr_features", "xgb_features", "mlp_features")
    split = [f"{m}_{x}_{s}" for m in ("lr", "xgb") for x in ("X", "y") for s in ("train", "test")]
    final = [f"lr_X_{s}_{k}" for s in ("train", "test") for k in ("flagged", "clipped")]
    layers = {"01_raw": raw, "02_validated": tuple(f"validated_{x}" for x in raw), "03_features": features, "04_model_input": (*split, *final)}
    return {name: f"{base}/{layer}/{name}" for layer, names in layers.items() for name in names}
