from __future__ import annotations

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from tarmac.operators.hot_keys import heavy_keys, lookup_join
from tarmac.operators.state import with_membership
from tarmac.plans import scoring
from tarmac.sources.scratch import stage

PARTITIONS = 16
SETTINGS = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.enabled": "false"}


@pytest.fixture
def shuffled(spark):
    """Broadcasts by size and the planner's own help are off, so that only the salts can split a key."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def requests(spark, n=48_000):
    """A third of the requests depart from one airport, the rest from 500."""
    code = F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("A"), (F.col("id") * 7 % 500).cast("string")))
    return spark.range(n).select(F.col("id").alias("req_id"), code.alias("depIataCode"), F.lit("HOT").alias("destIataCode"))


def airports(spark):
    codes = spark.range(600).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("code")).unionByName(spark.range(1).select(F.lit("HOT").alias("code")))
    return codes.select("code", F.col("code").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("long"))


def sizes(df):
    found = Counter({row[0]: row[1] for row in df.groupBy(F.spark_partition_id()).count().collect()})
    return [found[i] for i in range(PARTITIONS)]


def test_no_task_gets_twice_the_median(spark, shuffled):
    rows = stage(requests(spark), "hot")
    table = airports(spark).withColumnRenamed("code", "depIataCode")
    plain, spread = sizes(rows.join(table, "depIataCode", "left")), sizes(lookup_join(rows, table, "depIataCode", ["req_id"]))
    assert sum(spread) == sum(plain) == 48_000
    assert max(plain) > 4 * median(plain) and max(spread) < 2 * median(spread)


def test_both_ends_and_membership_stay_even_and_whole(spark, shuffled):
    rows = stage(requests(spark), "hot")
    placed = scoring.with_airports(rows, airports(spark))
    assert placed.where("origin_found AND dest_found AND origin_city_name = depIataCode AND dest_city_name = 'HOT'").count() == 48_000
    assert max(sizes(placed)) < 2 * median(sizes(placed))
    known = with_membership(rows, "depIataCode", airports(spark).where("code <> 'A5'"), "known")
    assert {row[0]: row[1] for row in known.groupBy("known").count().collect()} == {
        True: rows.where("depIataCode <> 'A5'").count(), False: rows.where("depIataCode = 'A5'").count()}
    assert max(sizes(known)) < 2 * median(sizes(known))


def test_heavy_keys_are_few_and_measured(spark):
    rows = stage(requests(spark), "hot")
    found = {row.key: row.salts for row in heavy_keys(rows, "depIataCode", 128).collect()}
    assert found == {"HOT": 43}
    assert heavy_keys(rows, "destIataCode", 10).collect()[0].salts == 10
    assert heavy_keys(rows.limit(0), "depIataCode", 10).count() == 0


@pytest.mark.parametrize("pieces", [1, 2, 50])
def test_rows_are_those_of_a_plain_left_join(spark, pieces):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 30 + ["b"] * 5 + [None] * 20 + ["gone"] * 9)], "n int, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    expected = {(r.n, r.k, r.v) for r in rows.join(table, "k", "left").collect()}
    found = lookup_join(rows, table, "k", heavy=heavy_keys(rows, "k", pieces)).collect()
    assert len(found) == 64 and {(r.n, r.k, r.v) for r in found} == expected
    assert lookup_join(rows.limit(0), table, "k").collect() == []
