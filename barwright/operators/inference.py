"""Serving: scores, regimes, bands, attributions and the payload that holds them all."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.guards import div
from barwright.operators import train
from barwright.operators.ingest import serving_window
from barwright.operators.prepare import clip_outliers, outlier_detection
from barwright.operators.tree_attribution import tree_attribution
from barwright.plans.frames import model_frame
from barwright.plans.window_plan import WindowPlan
from barwright.scratch import Scratch
from barwright.sources.bars import Source
from barwright.sources.store import Store

# Least probabilities of the confidence levels, least fear-index levels of the regimes.
HIGH, MEDIUM = 0.75, 0.6
RISK_OFF, ELEVATED = 25.0, 18.0


def confidence(probability: Column) -> Column:
    return F.when(probability >= HIGH, "High").when(probability >= MEDIUM, "Medium").otherwise("Low")


def market_regime(level: Column) -> Column:
    """Null counts as a calm market."""
    return F.when(level >= RISK_OFF, "Risk Off").when(level >= ELEVATED, "Elevated").otherwise("Risk On")


def known_ticker(ticker: Column, known: Sequence[str]) -> Column:
    """Whether a ticker, in any case, is among these."""
    return F.coalesce(F.upper(ticker).isin(list(known)), F.lit(False))


def check_ticker(ticker: str, known: Sequence[str]) -> str:
    if ticker.upper() not in known:
        raise LookupError(f"unknown ticker {ticker!r}; known are {', '.join(known)}")
    return ticker.upper()


def latest(df: DataFrame, by: str = "Ticker") -> DataFrame:
    """Each ticker's last row."""
    return df.groupBy(by).agg(F.max_by(F.struct(*df.columns), "Date").alias("r")).select("r.*")


def last_known(df: DataFrame, column: str) -> DataFrame:
    """Each ticker's last value that isn't null."""
    return df.where(F.col(column).isNotNull()).groupBy("Ticker").agg(F.max_by(column, "Date").alias(column))


def feature_rows(features: DataFrame) -> DataFrame:
    """Each ticker's last row as rows of (Ticker, feature, value), numbers only; text that reads as a number counts, nulls
    and other text don't."""
    names = [c for c in features.columns if c not in ("Ticker", "Date")]
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).try_cast("double").alias("value")) for c in names])
    return latest(features).select("Ticker", F.explode(each).alias("e")).select("Ticker", "e.feature", "e.value").where("value is not null")


def checked_probability(probability: Column) -> Column:
    """The probability; the query stops where it isn't one."""
    return F.when(probability.between(0, 1), probability).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), F.coalesce(probability.cast("string"), F.lit("null")))))


def market_overview(features: DataFrame) -> DataFrame:
    """Each ticker's latest known market return, fear-index level and regime."""
    spy = F.max_by("spy_lag_return_1", F.when(F.col("spy_lag_return_1").isNotNull(), F.col("Date")))
    vix = F.max_by("vix_level", F.when(F.col("vix_level").isNotNull(), F.col("Date")))
    out = features.groupBy("Ticker").agg(spy.alias("spy_return"), vix.alias("vix_level"))
    return out.withColumn("regime", market_regime(F.col("vix_level")))


def bollinger_overlay(bars: DataFrame, window_size: int = 20, num_std: float = 2.0) -> DataFrame:
    """One row a ticker: its dates, and the middle, upper and lower band by date (null where the window isn't full)."""
    plan = WindowPlan()
    mean, std = plan.mean("Close", window_size), plan.std("Close", window_size)
    plan.output("middle", mean)
    plan.output("upper", plan.step("upper", lambda m, s: m + num_std * s, mean, std))
    plan.output("lower", plan.step("lower", lambda m, s: m - num_std * s, mean, std))
    rows = plan.apply(bars, ("Ticker", "Date")).groupBy("Ticker").agg(F.sort_array(F.collect_list(F.struct("Date", "middle", "upper", "lower"))).alias("r"))
    return rows.select("Ticker", F.transform("r", lambda x: F.date_format(x["Date"], "yyyy-MM-dd'T'HH:mm:ss")).alias("dates"), *[F.col(f"r.{c}").alias(c) for c in ("middle", "upper", "lower")])


def ohlcv_records(bars: DataFrame) -> DataFrame:
    """One row a ticker with its bars as an array in date order."""
    bar = F.struct("Date", "Open", "High", "Low", "Close", "Volume")
    return bars.groupBy("Ticker").agg(F.sort_array(F.collect_list(bar)).alias("ohlcv"))


def linear_attribution(features: DataFrame, weights: dict[str, float], top_n: int = 10, background_size: int = 150) -> DataFrame:
    """For each ticker's last row the columns with the greatest contributions weight * (value - mean), where the mean is
    that of the ticker's last `background_size` complete rows (of all its rows if none is complete).

    Rows: Ticker, rank, feature, value, contribution. Ties go by name.
    """
    names = list(weights)
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    rows = features.select("Ticker", "Date", *[F.col(c).cast("double").alias(c) for c in names]).withColumn("whole", whole)
    back = Window.partitionBy("Ticker").orderBy(F.desc("whole"), F.desc("Date"))
    numbered = rows.withColumn("n", F.row_number().over(back)).withColumn("any", F.max("whole").over(Window.partitionBy("Ticker")))
    ground = (F.col("n") <= background_size) & (F.col("whole") | ~F.col("any"))
    one = numbered.groupBy("Ticker").agg(F.max_by(F.struct(*names), "Date").alias("x"), F.struct(*[F.avg(F.when(ground, F.col(c))).alias(c) for c in names]).alias("mean"))
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("x")[c].alias("value"), (F.lit(w) * (F.col("x")[c] - F.col("mean")[c])).alias("contribution")) for c, w in weights.items()])
    known = F.filter(each, lambda e: e["contribution"].isNotNull())
    order = F.array_sort(F.transform(known, lambda e: F.struct((-F.abs(e["contribution"])).alias("k"), e["feature"].alias("feature"), e["value"].alias("value"), e["contribution"].alias("contribution"))))
    return one.select("Ticker", F.posexplode(F.slice(order, 1, top_n)).alias("i", "e")).select("Ticker", (F.col("i") + 1).alias("rank"), "e.feature", "e.value", "e.contribution")


def reasons(attribution: DataFrame, n: int = 5) -> DataFrame:
    """By ticker: its first n features, the dominant one, and that one's share of all listed contributions."""
    a = attribution.groupBy("Ticker").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "contribution"))).alias("r"), F.sum(F.abs("contribution")).alias("total"))
    return a.select("Ticker", F.transform(F.slice("r", 1, n), lambda x: x["feature"]).alias("reasons"), F.col("r")[0]["feature"].alias("dominant"), div(F.abs(F.col("r")[0]["contribution"]), F.col("total")).alias("share"))


def coefficients(model: PipelineModel) -> dict[str, float]:
    """A fitted linear pipeline's weights by input column, per unit of the column: scalers are divided out. Days and months
    count as their numbers. Tickers are left out: a ticker is compared with its own rows, where its weight gives nothing."""
    weights, out, at = model.stages[-1].coefficients.toArray(), {}, 0
    sizes = {s.getOutputCol(): s for s in model.stages if hasattr(s, "getOutputCol")}
    for name in model.stages[-2].getInputCols():
        if name.endswith("_scaled"):
            scaler, columns = sizes[name], sizes[name.replace("_scaled", "_raw")].getInputCols()
            spread = (scaler.std if hasattr(scaler, "std") else scaler.range).toArray()
            out |= {c: float(w / s) if s else 0.0 for c, w, s in zip(columns, weights[at : at + len(columns)], spread, strict=True)}
            at += len(columns)
        elif name.endswith("_onehot"):
            at += len(next(s for s in model.stages if hasattr(s, "labels") and s.getOutputCol() == name.replace("_onehot", "_index")).labels)
        else:
            out[name] = float(weights[at])
            at += 1
    return out


def model_attribution(features: DataFrame, model: PipelineModel, model_type: str, top_n: int = 10, background_size: int = 150) -> DataFrame:
    """The contributions that a fitted model of either type gives each ticker's last row."""
    if model_type == "xgb":
        return tree_attribution(features, model, top_n, background_size)
    numbered = PipelineModel(stages=[s for s in model.stages if isinstance(s, SQLTransformer)]).transform(features)
    out = linear_attribution(numbered, coefficients(model), top_n, background_size)
    return out.withColumn("feature", F.regexp_replace("feature", "_number$", ""))


def engineer_data(stock: DataFrame, spy: DataFrame, vix: DataFrame, model_type: str) -> DataFrame:
    """The serving frame: no answer; for the linear model flagged and winsorised on itself."""
    df = model_frame(stock, spy, vix, model_type, serving=True)
    return clip_outliers(outlier_detection(df)) if model_type == "lr" else df


class VolatilityPredictor:
    """A loaded model with its name, version and type; scores each ticker's last complete row."""

    def __init__(self, model: PipelineModel, model_type: str, name: str, version: int, stats: dict[str, float] | None = None, market_tickers: Sequence[str] = ("SPY", "^VIX")) -> None:
        self.model, self.model_type, self.name, self.version, self.stats = model, model_type, name, version, stats or {}
        self.spy, self.vix = market_tickers

    @classmethod
    def champion(cls, store: Store, model_type: str | None = None, alias: str = "champion") -> VolatilityPredictor:
        """The model that has the alias; its type and its market tickers are the run's tags unless the type is named."""
        row = store.versions().where(F.col("alias") == alias).orderBy("name", F.desc("version")).first()
        if row is None:
            raise LookupError(f"no model has the alias {alias!r}")
        runs = store.read("runs").where(F.col("run_id") == row.run_id).first()
        model_type = model_type or (runs.tags.get("model") if runs else None)
        if model_type is None:
            raise LookupError(f"the type of model {row['name']!r} is not known")
        market = (runs.tags.get("market_tickers") if runs else None) or "SPY,^VIX"
        return cls(PipelineModel.load(row.path), model_type, row["name"], row.version, dict(runs.metrics) if runs else {}, market.split(","))

    def prepare_features(self, store: Store, source: Source, ticker: str, lookback_window: int = 500, today: date | None = None) -> tuple[DataFrame, DataFrame]:
        """A ticker's bars of the last so many calendar days and its features, what the store lacks filled from the source
        and added to it. The frames are written once, as a payload reads them several times."""
        windows = {"stock_data": ticker, "spy_data": self.spy, "vix_data": self.vix}
        scratch, got = Scratch(store.spark, "serving"), []
        for name, one in windows.items():
            bars = scratch.keep(serving_window(store.read(name), source, one, lookback_window, today), name)
            store.insert_if_absent(name, bars)
            got.append(bars)
        return got[0], scratch.keep(engineer_data(*got, self.model_type), "features")

    def predict_ticker(self, store: Store, source: Source, ticker: str, lookback_window: int = 500, today: date | None = None) -> DataFrame:
        """One row: the prediction with the ticker's last close and the model's type."""
        bars, features = self.prepare_features(store, source, ticker, lookback_window, today)
        close = last_known(bars, "Close").withColumnRenamed("Close", "close_price")
        return self.predict(features).join(close, "Ticker", "left").withColumn("model_type", F.lit(self.model_type))

    def explain(self, store: Store, source: Source, ticker: str, lookback_window: int = 500, top_n: int = 10, background_size: int = 150, today: date | None = None) -> DataFrame:
        """The greatest contributions to a ticker's prediction: Ticker, rank, feature, value, contribution."""
        _, features = self.prepare_features(store, source, ticker, lookback_window, today)
        return model_attribution(features, self.model, self.model_type, top_n, background_size)

    def get_prediction(self, store: Store, source: Source, ticker: str, lookback_window: int = 500, top_n: int = 10, background_size: int = 150, today: date | None = None) -> DataFrame:
        """One nested row (see `payload`) for a ticker, with its last close and the model's type."""
        bars, features = self.prepare_features(store, source, ticker, lookback_window, today)
        close = last_known(bars, "Close").withColumnRenamed("Close", "close_price")
        return self.payload(bars, features, top_n, background_size).join(close, "Ticker", "left").withColumn("model_type", F.lit(self.model_type))

    def latest_features(self, bars: DataFrame, features: DataFrame) -> DataFrame:
        """One nested row a ticker: its bars, bands and the values of its last row, as text where they aren't numbers."""
        names = [c for c in features.columns if c != "Ticker"]
        values = latest(features).select("Ticker", F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))]).alias("features"))
        bands = bollinger_overlay(bars).select("Ticker", F.struct("dates", "middle", "upper", "lower").alias("bollinger"))
        return ohlcv_records(bars).join(bands, "Ticker", "left").join(values, "Ticker", "left")

    def predict(self, features: DataFrame) -> DataFrame:
        """Ticker, date, prediction, probability, confidence, model_name and model_version, a row a ticker. It is the last
        row without nulls that is scored; `Date` tells which day that is."""
        out = train.scored(self.model, latest(features.dropna("any")))
        return out.select("Ticker", "Date", "prediction", "probability", confidence(F.col("probability")).alias("confidence"), F.lit(self.name).alias("model_name"), F.lit(self.version).alias("model_version"))

    def payload(self, bars: DataFrame, features: DataFrame, top_n: int = 10, background_size: int = 150) -> DataFrame:
        """One nested row a ticker: the prediction with its bars, bands, feature values, attribution and market."""
        numeric = [c for c, t in features.dtypes if t in ("double", "float", "int", "bigint")]
        values = latest(features).select("Ticker", F.create_map(*[x for c in numeric for x in (F.lit(c), F.col(c).cast("double"))]).alias("features"))
        out = self.predict(features).join(ohlcv_records(bars), "Ticker", "left")
        bands = bollinger_overlay(bars).select("Ticker", F.struct("dates", "middle", "upper", "lower").alias("bollinger"))
        market = market_overview(features).select("Ticker", F.struct("spy_return", "vix_level", "regime").alias("market"))
        out = out.join(bands, "Ticker", "left").join(values, "Ticker", "left").join(market, "Ticker", "left")
        if self.model_type in ("lr", "xgb"):
            why = model_attribution(features, self.model, self.model_type, top_n, background_size)
            why = why.groupBy("Ticker").agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "value", "contribution"))).alias("attribution"))
            out = out.join(why, "Ticker", "left")
        return out.withColumn("model_stats", F.create_map(*[x for k, v in self.stats.items() for x in (F.lit(k), F.lit(float(v)))]) if self.stats else F.expr("cast(map() as map<string,double>)"))

    def log(self, store: Store, predictions: DataFrame) -> bool:
        """Appends to the log; a failure is told by the result, as serving goes on without."""
        try:
            store.log_predictions(predictions.select(F.col("Ticker").alias("ticker"), "prediction", checked_probability(F.col("probability")).alias("probability"), "model_name", "model_version"))
        except Exception:
            return False
        return True
