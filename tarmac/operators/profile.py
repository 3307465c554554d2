"""Exploration statistics: class balance, missing values and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.fields import MODEL_FEATURES, NUMERIC_FEATURES

CLASS_NAMES = {0: "not_significant", 1: "significant"}


def class_name(label: Column) -> Column:
    return F.when(label == 1, CLASS_NAMES[1]).otherwise(CLASS_NAMES[0])


def class_distribution(rows: DataFrame, label: str = "significant") -> DataFrame:
    """Count and share per class. The window runs over the classes, not the rows."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(
        label, class_name(F.col(label)).alias("class_name"), "n", (F.col("n") / total).alias("share")
    ).orderBy(label)


def class_weights(rows: DataFrame, label: str = "significant") -> DataFrame:
    """Balanced weights: all rows over (classes x rows of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def _per_feature(summary: DataFrame, features: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Turn one wide summary row with ``<value>__<feature>`` columns into a row per feature."""
    entries = ", ".join(f"'{feature}', " + ", ".join(f"{value}__{feature}" for value in values) for feature in features)
    return summary.selectExpr(f"stack({len(features)}, {entries}) AS (feature, {', '.join(values)})")


def missing_by_target(rows: DataFrame, features: Sequence[str] = MODEL_FEATURES, label: str = "significant") -> DataFrame:
    """Fraction of NULL and NaN values per feature and class, worst first; one pass for all features."""
    real = {field.name for field in rows.schema if isinstance(field.dataType, (T.DoubleType, T.FloatType))}
    sums = [
        F.expr(f"count_if({label} = {value} AND ({feature} IS NULL{f' OR isnan({feature})' if feature in real else ''})) AS {name}__{feature}")
        for feature in features
        for value, name in CLASS_NAMES.items()
    ]
    sizes = [F.expr(f"count_if({label} = {value}) AS {name}__rows") for value, name in CLASS_NAMES.items()]
    counts = rows.agg(*sizes, *sums)
    shares = counts.selectExpr(*[
        f"try_divide({name}__{feature}, {name}__rows) AS {name}__{feature}"
        for feature in features for name in CLASS_NAMES.values()
    ])
    return _per_feature(shares, features, tuple(CLASS_NAMES.values())).orderBy(
        F.desc("significant"), F.desc("not_significant"), "feature"
    )


def target_correlation(rows: DataFrame, features: Sequence[str] = NUMERIC_FEATURES, label: str = "significant") -> DataFrame:
    """Pearson correlation of each feature with the label, weakest first; one pass for all.

    Rows turn into (feature number, value) pairs that collapse to one row per
    feature inside each task: a single aggregate over every feature's moments
    becomes too large for the JVM to compile. Expects complete rows. A constant
    column has no correlation and drops out; it is told by its extremes, since
    merging partial moments can leave it a spread of 1e-13.
    """
    values = F.expr("array(" + ", ".join(f"CAST({feature} AS DOUBLE)" for feature in features) + ")")
    pairs = rows.select(F.col(label).cast("double").alias("y"), F.posexplode(values).alias("number", "x"))
    moments = pairs.groupBy("number").agg(
        F.covar_pop("x", "y").alias("covariance"),
        (F.stddev_pop("x") * F.stddev_pop("y")).alias("spread"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies"),
    )
    name = F.element_at(F.array(*map(F.lit, features)), F.col("number") + 1)
    table = moments.where("varies").select(
        name.alias("feature"), F.try_divide("covariance", "spread").alias("correlation")
    )
    return table.where(F.col("correlation").isNotNull()).orderBy(F.abs("correlation"), "feature")
