from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.plans import training


def sizes(rows):
    return [row.n for row in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_rows_of_one_small_file_are_dealt_over_tasks(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20000).selectExpr("id", "CAST(id % 2 AS INT) AS significant").coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert max(sizes(rows)) == 20000
    parts = sizes(training.dealt(rows, 1000))
    assert sum(parts) == 20000 and max(parts) < 1500
    assert training.dealt(rows) is rows
    assert training.dealt(rows.where("id < 0"), 1000).count() == 0
