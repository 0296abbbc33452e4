"""Bars from a stream of events, appended once each, and a table of the events that came too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.ingest import absent
from barwright.schema import PRICES

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files under a path."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bars_of(events: DataFrame, late: str = "1 day", every: str = "1 day", once: bool = False) -> DataFrame:
    """Bars of tumbling windows. A window is given out once the watermark has passed its end; events later than
    `late` are left out (see `admit`). Works on streams and on tables.

    once: an event that comes again within `late` counts once. What is remembered of it goes when the watermark has passed
    it, so the state holds the ids of `late` time and not of all time."""
    order = F.struct("ts", "event_id")
    marked = events.withWatermark("ts", late)
    if once:
        marked = marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])
    windows = marked.groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("Ticker"))
    out = windows.agg(F.min_by("value", order).alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", order).alias("Close"), F.count("*").alias("Volume"))
    return out.select(F.col("w.start").cast("date").alias("Date"), "Ticker", *PRICES, "Volume")


def run_available(bars: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Runs until all that is there has been read. complete: the table is written anew; append: closed windows are added."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    bars.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def insert_new(bars: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("Ticker", "Date")) -> None:
    """Appends each batch's bars whose key isn't stored: the first write of a key wins, and a batch that is run again
    after a failure adds nothing twice."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], batch.schema).write.mode("ignore").parquet(path)
        absent(batch, spark.read.schema(batch.schema).parquet(path), key).write.mode("append").parquet(path)

    bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def admit(events: DataFrame, path: str, checkpoint: str, late: str = "1 day", time: str = "ts") -> None:
    """Parts the events into tables `kept` and `late` under the path: late are those not after the newest time of all earlier
    batches (in milliseconds, as watermarks are) less `late`. A query with this watermark over what is kept
    drops nothing, as its own watermark is never further on; so every event is either counted or among the late ones.
    A batch's rows and its newest time lie in folders of its number: a batch that is run again writes the same."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            batch.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
            known = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/newest").where(F.col("batch") < number)
            bound = known.agg((F.date_trunc("millisecond", F.max("newest")) - F.expr(f"INTERVAL {late}")).alias("bound")).first().bound
            dropped = F.lit(False) if bound is None else F.coalesce(F.col(time) <= F.lit(bound), F.lit(False))
            batch.where(dropped).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            batch.where(~dropped).write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        finally:
            batch.unpersist()

    events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def read_admitted(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """A stream of what `admit` kept."""
    return spark.readStream.schema(schema).parquet(f"{path}/kept/batch=*")


def read_late(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/late/batch=*")
