from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tarmac.operators import contracts
from tarmac.operators.clean import airport_days, clean_airports, clean_flights, enrichment_requests, one_per_code
from tarmac.plans.ingest import audit, build_sources
from tarmac.sources.csv import MalformedLines, MissingColumns, read_airports, read_flights
from tarmac.sources.warehouse import Warehouse, describe
from tests import fixtures


@pytest.fixture
def flights(spark, tmp_path):
    return clean_flights(read_flights(spark, fixtures.flights_csv(tmp_path)))


@pytest.fixture
def airports(spark, tmp_path):
    return clean_airports(read_airports(spark, fixtures.airports_csv(tmp_path)))


def test_clean_flights(flights):
    rows = flights.orderBy("flight_number").collect()
    assert [(r.flight_number, r.total_delay, r.pred_dep_time) for r in rows] == [
        (211.0, 31.0, 615), (318.0, 11.0, 1125), (427.0, 14.0, 1830)
    ]
    assert rows[0].origin_city_name == "Boise, ID" and rows[0].date == date(2023, 5, 2)
    contracts.check_schema(flights, contracts.FLIGHTS)


def test_whole_numbers_round_half_to_even(spark, tmp_path):
    lines = [
        f'2024-01-01,2024,1,1,1,{n},BOI,a,OMA,b,{dep},1000,360.0,2475,10,0,5,0,20'
        for n, dep in ((1, "700.5"), (2, "701.5"), (3, "700.7"))
    ]
    flights = clean_flights(read_flights(spark, fixtures.flights_csv(tmp_path, lines)))
    assert [r.pred_dep_time for r in flights.orderBy("flight_number").collect()] == [700, 702, 701]


def test_unknown_cause_makes_delay_unknown_and_null_keys_drop(spark, tmp_path):
    lines = [
        '2024-01-01,2024,1,1,1,1,BOI,a,OMA,b,700,1000,360.0,2475,,0,5,0,20',
        '2024-01-01,2024,1,1,1,,BOI,a,OMA,b,700,1000,360.0,2475,1,0,5,0,20',
        '2024-01-01,2024,1,1,1,3,BOI,a,,b,700,1000,360.0,2475,1,0,5,0,20',
        '2024-01-01,2024,1,1,1,4,"",a,OMA,b,700,1000,360.0,2475,1,0,5,0,20',
    ]
    rows = clean_flights(read_flights(spark, fixtures.flights_csv(tmp_path, lines))).collect()
    assert [(r.flight_number, r.total_delay) for r in rows] == [(1.0, None)]


def test_missing_column_fails(spark, tmp_path):
    header = fixtures.FLIGHT_HEADER.replace("op_carrier_fl_num,", "")
    lines = [line.replace("211.0,", "") for line in fixtures.FLIGHT_LINES[:1]]
    with pytest.raises(MissingColumns, match="op_carrier_fl_num"):
        read_flights(spark, fixtures.flights_csv(tmp_path, lines, header))


def test_file_with_another_header_fails(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    fixtures.flights_csv(folder, name="a.csv")
    names = fixtures.FLIGHT_HEADER.split(",")
    names[6], names[8] = names[8], names[6]
    fixtures.flights_csv(folder, header=",".join(names), name="b.csv")
    with pytest.raises(Exception, match="header"):
        clean_flights(read_flights(spark, str(folder))).collect()


def test_requests_are_deduplicated(spark, flights, airports):
    requests = enrichment_requests(flights, airports)
    contracts.check_schema(requests, contracts.WEATHER_REQUESTS)
    assert sorted((r.code, r.status, r.attempt_count, r.last_error) for r in requests.collect()) == [
        (code, "pending", 0, None) for code in ("BOI", "OMA", "TUL")
    ]
    assert airport_days(flights).count() == 3
    only = airports.where("code = 'BOI'")
    assert enrichment_requests(flights, only).count() == 1
    assert enrichment_requests(flights, only.union(only)).count() == 2
    assert one_per_code(airports.union(airports)).count() == 3


def test_publish_validates_before_it_becomes_current(spark, tmp_path, airports):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.publish("airport_data", airports, contracts.AIRPORTS)
    with pytest.raises(contracts.ContractBroken, match="empty"):
        warehouse.publish("airport_data", airports.where("code = 'none'"), contracts.AIRPORTS)
    with pytest.raises(contracts.ContractBroken, match="1 rows with nulls"):
        broken = airports.withColumn("lat", F.when(F.col("code") != "TUL", F.col("lat")))
        warehouse.publish("airport_data", broken, contracts.AIRPORTS)
    with pytest.raises(contracts.SchemaMismatch):
        warehouse.publish("airport_data", airports.drop("lat"), contracts.AIRPORTS)
    assert warehouse.table("airport_data").count() == 3
    warehouse.publish("airport_data", airports.where("code <> 'TUL'"), contracts.AIRPORTS)
    assert warehouse.table("airport_data").count() == 2
    assert warehouse.table_or_empty("other", "a int").count() == 0
    with pytest.raises(LookupError):
        warehouse.table("other")


def test_build_sources(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    build_sources(warehouse, fixtures.flights_csv(tmp_path), fixtures.airports_csv(tmp_path))
    counts = {r.table_name: r.row_count for r in audit(warehouse).collect()}
    assert counts == {"airport_data": 3, "flight_data": 3, "weather_req_table": 3}


def test_airports_without_code_leave_an_empty_table(spark, tmp_path):
    rows = [("Boise Air Terminal", 43.5644, -116.2228, None)]
    airports = clean_airports(read_airports(spark, fixtures.airports_csv(tmp_path, rows)))
    with pytest.raises(contracts.ContractBroken, match="empty"):
        Warehouse(spark, str(tmp_path / "wh")).publish("airport_data", airports, contracts.AIRPORTS)


def test_schema_contract(spark, flights):
    contracts.check_schema(flights.withColumn("distance", F.col("distance").cast("decimal(18,3)")), contracts.FLIGHTS)
    names = flights.columns
    with pytest.raises(contracts.SchemaMismatch, match="columns"):
        contracts.check_schema(flights.select("date", "flight_number"), contracts.FLIGHTS)
    with pytest.raises(contracts.SchemaMismatch, match="expected column date"):
        contracts.check_schema(flights.select(*reversed(names)), contracts.FLIGHTS)
    with pytest.raises(contracts.SchemaMismatch, match="date is string"):
        contracts.check_schema(flights.withColumn("date", F.col("date").cast("string")), contracts.FLIGHTS)


def test_describe(airports):
    assert [tuple(r) for r in describe(airports).collect()] == [
        ("name", "string"), ("lat", "double"), ("long", "double"), ("code", "string")
    ]


def test_malformed_lines_stop_the_build_or_go_apart(spark, tmp_path):
    lines = (*fixtures.FLIGHT_LINES, "2023-05-02,2023", f"{fixtures.FLIGHT_LINES[0]},7,8")
    flights, airports = fixtures.flights_csv(tmp_path, lines), fixtures.airports_csv(tmp_path)
    with pytest.raises(MalformedLines):
        build_sources(Warehouse(spark, str(tmp_path / "strict")), flights, airports)
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    build_sources(warehouse, flights, airports, quarantine=True)
    assert warehouse.table("flight_data").count() == 3
    assert [row.line for row in warehouse.table("flight_data_malformed").orderBy("line").collect()] == sorted(lines[3:])
    assert warehouse.table("airport_data_malformed").count() == 0


def test_published_tables_keep_column_order_and_refuse_repeated_keys(spark, tmp_path, flights):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    warehouse.publish("flight_data", flights, contracts.FLIGHTS, partition_by=("year", "month"))
    contracts.check_schema(warehouse.table("flight_data"), contracts.FLIGHTS)
    keyed = contracts.Contract("t", (("k", "whole"), ("v", "text")), ("k",), ("k",))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(contracts.ContractBroken, match="1 keys"):
        warehouse.publish("t", rows, keyed)
    assert warehouse.publish("t", rows.where("v <> 'b'"), keyed).count() == 2
