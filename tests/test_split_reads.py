from __future__ import annotations

from tarmac.operators import split


def test_a_split_reads_its_rows_once_before_it_marks_them(spark):
    """Rows that cost much are not made anew by each pass that looks for the cuts."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).selectExpr("id", "CAST(id % 2 AS INT) AS significant").mapInArrow(counted, "id bigint, significant int")
    parted = split.train_test(rows)
    assert made.value == 1000
    assert parted.where("is_test").count() == 200
