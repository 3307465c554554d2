"""Session settings the plans are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits skewed joins and broadcasts a side only by its size as
# measured at run time. Times are UTC throughout.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fits of a search run side by side and share the executors.
    "spark.scheduler.mode": "FAIR",
}


def with_settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
