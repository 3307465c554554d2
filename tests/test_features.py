from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarmac.fields import MODEL_FEATURES
from tarmac.operators import contracts, features
from tarmac.operators.clean import clean_flights
from tarmac.operators.ids import dense_id
from tarmac.plans import ingest
from tarmac.sources.csv import read_flights
from tarmac.sources.warehouse import Warehouse
from tests import fixtures

RESPONSE = "code string, date date, fetched_at timestamp, payload string, seq bigint"


def responses(spark, rows):
    return spark.createDataFrame(
        [(code, date(2023, 5, 2), datetime(2023, 5, 3, hour), payload, seq) for code, hour, payload, seq in rows], RESPONSE
    )


@pytest.fixture
def flights(spark, tmp_path):
    return clean_flights(read_flights(spark, fixtures.flights_csv(tmp_path)))


def test_model_dataset_keeps_every_flight_and_the_newest_weather(spark, flights):
    stored = responses(spark, [
        ("BOI", 1, fixtures.weather_document(1.0), 1), ("BOI", 5, fixtures.weather_document(5.0), 2),
        ("BOI", 3, fixtures.weather_document(3.0), 3), ("OMA", 1, fixtures.weather_document(2.0, rain_sum=[None]), 4),
    ])
    dataset = features.model_dataset(flights, stored, ("flight_number",))
    contracts.check_schema(dataset, contracts.MODEL_DATASET)
    rows = dataset.orderBy("id").collect()
    assert [(r.id, r.flight_num) for r in rows] == [(1, 211.0), (2, 318.0), (3, 427.0)]
    assert [(r.origin_weather_code, r.dest_weather_code, r.dest_rain_sum) for r in rows] == [
        (5.0, 2.0, None), (2.0, None, None), (5.0, 2.0, None)
    ]
    assert features.complete_rows(dataset).count() == 0
    assert features.known_target(dataset).columns == [*MODEL_FEATURES, "delay", "significant"]
    assert [r.significant for r in features.with_label(dataset).orderBy("id").collect()] == [1, 0, 0]


def test_published_dataset_is_partitioned(spark, flights, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.publish("flight_data", flights, contracts.FLIGHTS)
    ingest.append_responses(warehouse, responses(spark, [("BOI", 1, fixtures.weather_document(), 1)]).withColumn("api_url", F.lit("u")))
    dataset = ingest.build_model_dataset(warehouse)
    assert dataset.columns == contracts.MODEL_DATASET.names
    assert sorted(r.id for r in dataset.collect()) == [1, 2, 3]
    assert "PartitionFilters: [isnotnull(year" in dataset.where("year = 2023")._jdf.queryExecution().toString()


@pytest.mark.parametrize("order, unique", [((), False), (("k",), False), (("k", "v"), True)])
def test_dense_id_has_no_gaps(spark, order, unique):
    # two thirds of the rows share one key, and half of those are exact copies
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"),
        (F.col("id") if unique else F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id"))).alias("v"),
    ).repartition(6)
    numbered = dense_id(rows, order, unique_order=unique).collect()
    assert sorted(r.id for r in numbered) == list(range(1, 3001))
    if order:
        in_order = [r[order[0]] for r in sorted(numbered, key=lambda r: r.id)]
        assert in_order == sorted(in_order)


def test_copies_are_spread_when_ordering(spark, tmp_path):
    copies = spark.range(20000).select(F.lit(1).alias("k"), F.lit("same").alias("v")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = dense_id(copies, ("k",), path=str(tmp_path / "numbered"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = numbered.groupBy(F.floor((F.col("id") - 1) / 5000)).count().collect()
    assert [r["count"] for r in per_file] == [5000] * 4
    files = spark.read.parquet(str(tmp_path / "numbered")).select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) < 10000


def test_cap_comes_before_incomplete_rows_are_dropped(spark):
    names = contracts.MODEL_DATASET.names
    base = {name: F.lit(1.0) for name in names}
    base.update(id=F.col("id") + 1, delay=F.when(F.col("id") % 2 == 0, 30.0))
    dataset = spark.range(10).select(*[column.alias(name) for name, column in base.items()])
    assert [r.id for r in features.training_rows(dataset, cap=4).orderBy("id").collect()] == [1, 3]


def test_hot_airport_day_is_split(spark):
    """A third of the flights on one airport day must not end in one task."""
    random.seed(1)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        hot = F.col("id") % 3 == 0
        flights = spark.range(0, 200000, 1, 16).select(
            F.date_add(F.lit("2023-05-02").cast("date"), F.when(hot, 0).otherwise(F.col("id") % 28).cast("int")).alias("flight_date"),
            F.when(hot, "HUB").otherwise(F.concat(F.lit("A"), (F.col("id") % 50).cast("string"))).alias("origin"),
            F.concat(F.lit("A"), (F.col("id") % 47).cast("string")).alias("dest"), F.col("id").alias("flight_num"),
        )
        weather = features.weather_table(responses(spark, [
            ("HUB", 1, fixtures.weather_document(4.0), 1), ("A1", 1, fixtures.weather_document(1.0), 2)
        ]))
        joined = features.join_weather(flights, weather)
        result = joined.select(F.xxhash64(*joined.columns).alias("h"), "origin_weather_code", "origin").agg(
            F.count("h").alias("n"), F.sum("origin_weather_code").alias("total"))
        row = result.collect()[0]
        hub = flights.where("origin = 'HUB' AND flight_date = DATE'2023-05-02'").count()
        a1 = flights.where("origin = 'A1' AND flight_date = DATE'2023-05-02'").count()
        assert (row.n, row.total) == (200000, 4.0 * hub + a1)
        assert "skew=true" in result._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
