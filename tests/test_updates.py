"""Tables extended part by part: what is kept, what is rebuilt, and that a repeated call changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarmac.operators import contracts
from tarmac.plans import ingest
from tarmac.sources.warehouse import Warehouse
from tests import fixtures

JUNE = '2023-06-03,2023,6,3,6,{},TUL,"Tulsa, OK",BOI,"Boise, ID",700,900,120.0,1200,1,1,1,1,1'


@pytest.fixture
def warehouse(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "wh"))
    june = JUNE.format("500.0")
    ingest.build_sources(made, fixtures.flights_csv(tmp_path, [*fixtures.FLIGHT_LINES, june]), fixtures.airports_csv(tmp_path))
    store(made, [("BOI", "2023-05-02", 5.0, "2023-07-01")])
    ingest.build_model_dataset(made)
    return made


def store(warehouse, rows):
    made = [(code, day, "u", at, fixtures.weather_document(value), seq) for seq, (code, day, value, at) in enumerate(rows)]
    ingest.append_responses(warehouse, warehouse.spark.createDataFrame(
        made, "code string, date string, api_url string, fetched_at string, payload string, seq bigint"
    ).withColumns({"date": F.col("date").cast("date"), "fetched_at": F.col("fetched_at").cast("timestamp"), "seq": F.col("seq").cast("bigint")}))


def rows(warehouse):
    found = warehouse.table("model_dataset").orderBy("id").collect()
    return [(r.id, r.flight_num, r.month, r.origin_rain_sum, r.dest_rain_sum) for r in found]


def files(warehouse, month):
    version = warehouse.version("model_dataset")
    return {f for f in warehouse.files("model_dataset", version).inputFiles() if f"/month={month}/" in f}


def test_new_flights_of_one_month_leave_the_others(warehouse, tmp_path):
    may, june, held = files(warehouse, 5), files(warehouse, 6), warehouse.table("model_dataset")
    source = fixtures.flights_csv(tmp_path, [JUNE.format("400.0"), JUNE.format("501.0")], name="more.csv")
    assert ingest.add_flights(warehouse, source).count() == 0
    ingest.update_model_dataset(warehouse, overlap="0 seconds")
    assert files(warehouse, 5) == may and not files(warehouse, 6) & june
    assert [row[:3] for row in rows(warehouse)] == [(1, 211.0, 5), (2, 427.0, 5), (3, 318.0, 5), (4, 500.0, 6), (5, 400.0, 6), (6, 501.0, 6)]
    assert held.count() == 4  # a reader of the version before is undisturbed
    counts = {r.table_name: r.row_count for r in ingest.audit(warehouse).collect()}
    assert counts["flight_data"] == counts["model_dataset"] == 6


def test_late_weather_rebuilds_its_months_and_keeps_ids(warehouse):
    june, before = files(warehouse, 6), rows(warehouse)
    store(warehouse, [("OMA", "2023-05-02", 8.0, "2023-07-02"), ("OMA", "2023-06-03", 9.0, "2023-07-02")])  # nobody flew there in June
    ingest.update_model_dataset(warehouse, overlap="0 seconds")
    assert files(warehouse, 6) == june
    assert [row[:3] for row in rows(warehouse)] == [row[:3] for row in before]
    assert [row[3:] for row in rows(warehouse)] == [(5.0, 8.0), (5.0, 8.0), (8.0, None), (None, None)]


def test_repeating_changes_nothing(warehouse, tmp_path):
    source = fixtures.flights_csv(tmp_path, [JUNE.replace("BOI", "LAX").replace("TUL", "BOI").format("7.0")], name="more.csv")
    for _ in range(2):
        ingest.add_flights(warehouse, source)
        ingest.update_model_dataset(warehouse, overlap="0 seconds")
    assert [row[:3] for row in rows(warehouse)][3:] == [(4, 500.0, 6), (5, 7.0, 6)]
    assert warehouse.table("flight_data").count() == 5
    requests = warehouse.table("weather_req_table")
    assert requests.count() == requests.select("date", "code").distinct().count() == ingest.request_state(warehouse).count() == 5
    version = warehouse.version("model_dataset")
    ingest.update_model_dataset(warehouse, overlap="0 seconds")
    assert warehouse.version("model_dataset") == version


def test_flights_published_anew_rebuild_the_dataset(warehouse):
    flights = warehouse.table("flight_data").where("flight_number > 300")
    warehouse.publish("flight_data", flights, contracts.FLIGHTS)
    ingest.update_model_dataset(warehouse)
    assert [row[:3] for row in rows(warehouse)] == [(1, 427.0, 5), (2, 318.0, 5), (3, 500.0, 6)]


def test_ids_are_not_given_twice(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "wh"))
    ids = spark.range(1, 7).withColumn("part", F.when(F.col("id") < 6, F.col("id") % 2))
    made.publish("ids", ids, partition_by=("part",), mark="id")
    last = [folder for folder in made.version("ids").parts if folder.endswith("part=__HIVE_DEFAULT_PARTITION__")]
    made.extend("ids", ids.where("id = 1"), partition_by=("part",), replaced=[*last, *(f for f in made.version("ids").parts if f.endswith("=1"))], mark="id")
    assert made.version("ids").high == 6
    assert sorted((r.id, r.part) for r in made.table("ids").collect()) == [(1, 1), (2, 0), (4, 0)]
    with pytest.raises(ValueError, match="columns"):
        made.extend("ids", ids.withColumn("id", F.col("id").cast("int")), partition_by=("part",))


def test_awkward_names_and_empty_tables(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "wh"))
    named = spark.createDataFrame([(1, "a b/c=d%"), (2, None), (3, "é+")], "n int, part string")
    made.publish("named", named, partition_by=("part",))
    made.extend("named", named.where("n = 3"), partition_by=("part",))
    assert sorted((r.n, r.part) for r in made.table("named").collect()) == [(1, "a b/c=d%"), (2, None), (3, "é+"), (3, "é+")]
    made.publish("none", named.where("n > 3"), partition_by=("part",))
    assert made.table("none").columns == ["n", "part"] and made.table("none").count() == 0
