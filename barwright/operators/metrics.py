"""Quality of a classifier from labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.guards import div
from barwright.operators.prefix import running_totals


def classification_metrics(scored: DataFrame, label: str = "label", probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    """One row: roc_auc, accuracy, precision, recall and f1; null where a denominator is zero.

    The area under the curve is the share of (positive, negative) pairs in the right order, ties by half. Equal scores
    are counted first, then negatives below each score by running totals, so nothing is sorted in one task.
    """
    y, p = F.col(label).cast("double"), F.col(probability)
    rows = scored.where(y.isNotNull() & p.isNotNull()).select(y.alias("y"), p.alias("p"))
    groups = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    said = F.col("p") >= threshold
    t = running_totals(groups, ["p"], ["neg"]).agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("right"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.coalesce(F.sum(F.when(said, F.col("pos"))), F.lit(0.0)).alias("tp"),
        F.coalesce(F.sum(F.when(said, F.col("neg"))), F.lit(0.0)).alias("fp"),
    )
    right, pos, neg, tp, fp = (F.col(c) for c in ("right", "pos", "neg", "tp", "fp"))
    return t.select(
        div(right, pos * neg).alias("roc_auc"),
        div(tp + neg - fp, pos + neg).alias("accuracy"),
        div(tp, tp + fp).alias("precision"),
        div(tp, pos).alias("recall"),
        div(2 * tp, pos + tp + fp).alias("f1"),
    )


def areas(scored: DataFrame, by: str) -> DataFrame:
    """For each value of `by` the area under the curve of its rows (columns y and p), null where a class has none. One sort
    by group and score over ranges serves all groups, so a group may have any share of the rows."""
    groups = scored.groupBy(by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    t = running_totals(groups, [by, "p"], ["neg"])
    sums = t.groupBy(by).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("right"), F.min("before_neg").alias("base"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(by, div(F.col("right") - F.col("base") * F.col("pos"), F.col("pos") * F.col("neg")).alias("area"))
