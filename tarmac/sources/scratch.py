"""Shared scratch space for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_inside: ContextVar[str] = ContextVar("tarmac-scratch", default="")


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tarmac-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _application_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/tarmac/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_application_root(spark)}{_inside.get()}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application staged. Results that still read a staged table must be written before."""
    _delete(spark, _application_root(spark))


@contextmanager
def released(spark: SparkSession, label: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those staged by the function this gives.

    Nothing that is read later may depend on the deleted ones.
    """
    outer = _inside.get()
    inner = f"{outer}/{label}-{uuid.uuid4().hex}"
    token = _inside.set(inner)
    try:
        yield lambda df, name: _written(df, f"{_application_root(spark)}{outer}/{name}-{uuid.uuid4().hex}")
    finally:
        _inside.reset(token)
        _delete(spark, f"{_application_root(spark)}{inner}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame once and read it back.

    Later jobs start from the files, so a lost executor costs a re-read and
    never a different answer from work that cannot be repeated exactly.
    """
    return _written(df, scratch_path(df.sparkSession, label))
