"""Classification metrics as aggregations."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.sources.scratch import stage

# About so many distinct scores are ranked by one task when computing the area under the curve.
SCORES_PER_TASK = 500_000


def confusion(rows: DataFrame, label: str = "significant", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def score_metrics(rows: DataFrame, label: str = "significant", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; undefined ratios count as zero."""
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "n", "tp", "fp", "fn", "tn",
        _or_zero(tp + tn, F.col("n")).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def roc_auc(rows: DataFrame, label: str = "significant", score: str = "probability") -> DataFrame:
    """Area under the ROC curve with ties counted half.

    Rows collapse to distinct scores first, so tied scores cost nothing, and these
    are written once, since scoring again would cost far more. Distinct scores are
    then cut into ranges of near-equal size; each range is ranked by its own task
    and starts from the negatives of the ranges below it.
    """
    by_score = stage(rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    ), "scores")
    distinct = by_score.count()
    ranges = math.ceil(distinct / SCORES_PER_TASK)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        inner = sorted(set(by_score.approxQuantile("score", shares, 0.1 / ranges)))
    else:
        inner = [0.0]
    cut = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="score", outputCol="range")
    ranged = cut.transform(by_score)

    below_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("neg").alias("neg")).select(
        "range", F.coalesce(F.sum("neg").over(below_range), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("below", F.coalesce(F.sum("neg").over(within), F.lit(0)))
    # one row per range; the planner broadcasts them by their measured size
    placed = ranked.join(starts, "range")
    wins = F.sum(F.col("pos") * ((F.col("start") + F.col("below")).cast("double") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return placed.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.try_divide(wins, pairs).alias("auc"),
    )
