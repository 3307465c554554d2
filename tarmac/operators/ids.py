"""Dense surrogate ids without a global window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.sources.scratch import scratch_path, stage


def _position(rows: DataFrame) -> DataFrame:
    """Add the task and chunk number in the file name and the row index in the file."""
    file_name = F.col("_metadata.file_name")
    return rows.withColumns({
        "_part": F.regexp_extract(file_name, r"^part-(\d+)-", 1).cast("int"),
        "_chunk": F.regexp_extract(file_name, r"-c(\d+)\.", 1).cast("int"),
        "_row": F.col("_metadata.row_index"),
    })


def dense_id(
    df: DataFrame,
    order_by: Sequence[str] = (),
    name: str = "id",
    path: str | None = None,
    unique_order: bool = False,
    after: int = 0,
) -> DataFrame:
    """Number all rows 1..N without gaps, or go on behind the number ``after``.

    The rows are written once and numbered by where they landed: the offset of
    their file plus their row index in it. Files and row indexes do not change
    when a task is retried, and no task ever sees more than its own file.

    Without ``order_by`` the number follows the physical order and nothing is
    shuffled. With it, rows are range-partitioned on those columns first. Unless
    the caller knows them to be unique, the rows are staged and their physical
    position breaks ties, which also splits a value that very many rows share.
    """
    spark = df.sparkSession
    columns = df.columns
    if order_by:
        sort_key = list(order_by)
        if not unique_order:
            df = _position(stage(df, "unnumbered"))
            sort_key += ["_part", "_chunk", "_row"]
        df = df.repartitionByRange(*sort_key).sortWithinPartitions(*sort_key).select(*columns)
    path = path or scratch_path(spark, "numbered")
    df.write.parquet(path)
    written = _position(spark.read.schema(df.schema).parquet(path))

    # One small row for each file the write made; the planner joins their offsets by measured size.
    sizes = written.groupBy("_part", "_chunk").agg(F.count(F.lit(1)).alias("rows")).collect()
    ordered = sorted(sizes, key=lambda size: (size._part, size._chunk))
    starts = accumulate((size.rows for size in ordered), initial=after)
    offsets = spark.createDataFrame(
        [(size._part, size._chunk, start) for size, start in zip(ordered, starts)],
        "_part int, _chunk int, _start bigint",
    )
    return written.join(offsets, ["_part", "_chunk"]).select(
        (F.col("_start") + F.col("_row") + 1).alias(name), *columns
    )
