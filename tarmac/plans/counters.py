"""Counts of one enrichment run, taken where its rows pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession


@dataclass(frozen=True)
class RunCounters:
    """Requests that waited, were claimed and were looked up; lookups that failed; responses stored and those that could not be stored."""

    queued: int = 0
    claimed: int = 0
    fetched: int = 0
    written: int = 0
    failed_fetch: int = 0
    failed_write: int = 0

    def __add__(self, other: RunCounters) -> RunCounters:
        return RunCounters(*(a + b for a, b in zip(astuple(self), astuple(other))))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([astuple(self)], ", ".join(f"{field.name} bigint" for field in fields(self)))


def counted(df: DataFrame, write: Callable[[DataFrame], DataFrame | None], **metrics: Column) -> tuple[DataFrame | None, dict[str, int]]:
    """What ``write`` returns, and metrics of the rows once they are written.

    They are counted in the written table if ``write`` returns one, else in ``df``, which should be stored; a write that fails counts nothing.
    ``DataFrame.observe`` would save the pass, but a session that used it once can no longer run fitted models: the manager
    it adds to the session cannot be serialized with their tasks.
    """
    written = write(df)
    row = (df if written is None else written).agg(*(metric.alias(name) for name, metric in metrics.items())).collect()[0]
    return written, {name: int(row[name] or 0) for name in metrics}
