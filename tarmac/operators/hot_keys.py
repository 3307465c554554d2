"""Lookup joins that spread the keys they measured to be heavy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.sources.scratch import stage

# A piece of a heavy key is this part of an even share of one task.
PIECES_PER_TASK = 8


def heavy_keys(rows: DataFrame, key: str, pieces: int | None = None) -> DataFrame:
    """key, salts: keys that hold more than one in ``pieces`` of all rows, and into how many such pieces they are cut.

    There are fewer than ``pieces`` of them, by default eight for each shuffle partition. The counts are reduced inside the tasks, so a heavy key crosses the shuffle as one row a task.
    """
    pieces = pieces or PIECES_PER_TASK * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage(rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    limit = max(1.0, total / pieces)
    return counts.where(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def lookup_join(rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str] = (), heavy: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row per ``key``; rows are never multiplied, a null key meets nothing.

    Rows of a heavy key are dealt over salts by a hash of their ``spread`` columns (all columns by default), and the key's row in the
    table is repeated for each salt, so that no task gets more than a piece of a key. ``heavy`` are the ``heavy_keys`` of the rows; without
    it they are measured here, and the rows, which are then read twice, should be stored. Heavy keys are broadcast, as their number is bounded.
    Where the planner broadcasts the table by its measured size, nothing is shuffled and the salts only cost their hash.
    """
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    if heavy.isEmpty():
        return rows.join(table, key, "left")
    salts = F.broadcast(heavy.select(F.col("key").alias(key), F.col("salts").alias("_salts")))
    salted = rows.join(salts, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*(spread or rows.columns)), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = table.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
