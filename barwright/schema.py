"""Fixed schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Ticker", T.StringType()),
        *(T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close")),
        T.StructField("Volume", T.LongType()),
    ]
)
BAR_COLUMNS = tuple(BAR.names)
PRICES = ("Open", "High", "Low", "Close")

PREDICTION_LOG = T.StructType(
    [
        T.StructField("prediction_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("ticker", T.StringType(), False),
        T.StructField("prediction", T.ShortType(), False),
        T.StructField("probability", T.DoubleType(), False),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.IntegerType()),
        T.StructField("feature_pipeline", T.StringType()),
        T.StructField("actual_outcome", T.ShortType()),
        T.StructField("correct", T.BooleanType()),
    ]
)

RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("experiment", T.StringType()),
        T.StructField("start_time", T.LongType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)

MODEL_VERSION = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("run_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("alias", T.StringType()),
    ]
)

#: Every alias ever given; of equal names and aliases the newest counts.
MODEL_ALIAS = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("alias", T.StringType(), False),
        T.StructField("version", T.IntegerType(), False),
        T.StructField("set_at", T.LongType(), False),
    ]
)

#: Tables by name, with the columns that tell rows apart.
TABLES = {"stock_data": (BAR, ("Ticker", "Date")), "spy_data": (BAR, ("Date",)), "vix_data": (BAR, ("Date",)), "prediction_logs": (PREDICTION_LOG, ("prediction_id",)), "runs": (RUN, ("run_id",)), "model_versions": (MODEL_VERSION, ("name", "version")), "model_aliases": (MODEL_ALIAS, ("name", "alias", "set_at"))}
