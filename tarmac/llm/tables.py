"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


# So many whole texts go to a Python worker at once; the 10,000 of Spark's default, in and out again, fill tens of MB in both processes.
BATCH = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the input does not use, whatever its own columns are called."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> str:
    """A column name quoted for SQL text."""
    return f"`{name.replace('`', '``')}`"


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end Arrow and the C library hand their free memory back, since workers live on for other tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside hand ``BATCH`` rows at a time to Python, or fewer where the session asks for that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)
