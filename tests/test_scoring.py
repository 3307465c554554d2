from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tarmac.operators.clean import one_per_code
from tarmac.operators.matching import match_schedule, schedule_documents, schedule_rows, schedule_status
from tarmac.plans import scoring
from tests import fixtures
from tests.fixtures import scheduled, weather_document

DAY = date(2026, 8, 7)
REQUEST = "req_id bigint, date string, scheduledDepartureTime string, depIataCode string, destIataCode string"
PAGE = "date date, dep_code string, page bigint, status_code int, payload string"
WEATHER = "date date, code string, status_code int, payload string"


def request(req_id=1, day="2026-08-07", clock="09:00", dep="BOI", dest="OMA"):
    return (req_id, day, clock, dep, dest)


def page(*flights, dep="BOI", number=0, status=200, payload=None):
    return (DAY, dep, number, status, json.dumps({"data": list(flights)}) if payload is None else payload)


def matched_clock(spark, *flights):
    rows = schedule_rows(schedule_documents(spark.createDataFrame([page(*flights)], PAGE)))
    asked = scoring.checked_requests(spark.createDataFrame([request()], REQUEST))
    found = match_schedule(asked, rows).collect()
    assert len(found) == 1
    return found[0].matched and found[0].matched.dep_clock


def test_first_in_provider_order_wins_over_the_nearest(spark):
    assert matched_clock(spark, "invalid", scheduled("BOI", "OMA", "09:30"), scheduled("BOI", "OMA", "09:00")) == "09:30"


@pytest.mark.parametrize("flights, expected", [
    ([scheduled("BOI", "OMA", "08:31")], "08:31"),
    ([scheduled("boi", "oma", "2026-08-07T09:10:00Z")], "2026-08-07T09:10:00Z"),
    ([scheduled("BOI", "OMA", "09:31"), scheduled("BOI", "ABQ", "09:00")], None),
    ([scheduled("BOI", "OMA", "junk"), scheduled("BOI", "OMA", 900), 5, None, [1]], None),
    ([{"departure": "BOI"}, scheduled("BOI", "OMA", "0925")], "0925"),
])
def test_route_and_time_must_match(spark, flights, expected):
    assert matched_clock(spark, *flights) == expected


@pytest.mark.parametrize("tolerance", [0, 30, 50, 720])
def test_match_equals_brute_force(spark, tolerance):
    """Random requests and flights, with most of both on one route."""
    rng = random.Random(tolerance)
    route = lambda: ("BOI", "OMA") if rng.random() < 0.6 else (rng.choice(["BOI", "TUL"]), rng.choice(["OMA", "ABQ"]))
    offers = [(DAY, p, i, *route(), rng.randrange(1440)) for p in range(15) for i in range(5)]
    asked = [(r, DAY, *route(), rng.randrange(1440)) for r in range(120)]
    schedule = spark.createDataFrame(
        [(d, p, i, dep, dest, f"{m // 60}:{m % 60}", None, m) for d, p, i, dep, dest, m in offers],
        "date date, page int, item int, dep_code string, dest_code string, dep_clock string, arr_clock string, offered_minutes int",
    )
    requests = spark.createDataFrame(asked, "req_id int, date date, dep_code string, dest_code string, dep_minutes int")
    found = {r.req_id: r.matched and (r.matched.page, r.matched.item) for r in match_schedule(requests, schedule, tolerance).collect()}

    def best(dep, dest, minutes):
        near = [
            (p, i) for _, p, i, odep, odest, m in offers
            if (odep, odest) == (dep, dest) and min(abs(m - minutes), 1440 - abs(m - minutes)) <= tolerance
        ]
        return min(near, default=None)

    assert found == {r: best(dep, dest, m) for r, _, dep, dest, m in asked}


@pytest.mark.parametrize("payload, status, outcome", [
    ('{"data": {"bad": "shape"}}', 200, "malformed"), ('{"data": "text"}', 200, "malformed"), ('{"data": 5}', 200, "malformed"),
    ('{"data": []}', 200, "absent"), ('{"data": {}}', 200, "absent"), ('{"data": ""}', 200, "absent"),
    ('{"data": 0}', 200, "absent"), ('{"data": null}', 200, "absent"), ("{}", 200, "absent"), ("junk", 200, "absent"),
    (None, 503, "absent"), ('{"data": [1]}', 503, "absent"), ('{"data": [1]}', 200, "listed"),
])
def test_document_outcome(spark, payload, status, outcome):
    rows = schedule_documents(spark.createDataFrame([(DAY, "BOI", 0, status, payload)], PAGE))
    assert rows.collect()[0].outcome == outcome
    row = schedule_status(rows).collect()[0]
    assert row.schedule_fault == (None if outcome == "listed" else outcome)
    assert row.error_code == (503 if status == 503 else None)


@pytest.fixture
def airports(spark):
    return spark.createDataFrame(list(fixtures.AIRPORTS), "name string, lat double, long double, code string")


def outcome(spark, airports, requests, pages, weather, known=("BOI",), **options):
    codes = spark.createDataFrame([(code,) for code in known], "code string")
    rows = scoring.request_outcomes(
        spark.createDataFrame(requests, REQUEST), codes, spark.createDataFrame(pages, PAGE), airports,
        spark.createDataFrame(weather, WEATHER), **options,
    )
    return rows


FLIGHT = scheduled("BOI", "OMA", "09:00", "12:30")
SKY = [(DAY, "BOI", 200, weather_document(1.0)), (DAY, "OMA", 200, weather_document(2.0))]


def test_complete_request(spark, airports):
    row = outcome(spark, airports, [request()], [page(FLIGHT)], SKY).collect()[0]
    assert (row.status_code, row.message) == (200, "Flight delay prediction complete.")
    assert (row.flight_date, row.day_of_week, row.pred_dep_time, row.pred_arr_time, row.pred_elapsed_time) == (DAY, 5, 900, 1230, 210)
    assert 1000 < row.fl_distance < 1100 and row.origin_city_name.startswith("Boise")
    assert (row.origin_weather_code, row.dest_weather_code) == (1.0, 2.0)


@pytest.mark.parametrize("case, code, message", [
    (dict(requests=[request(dep="JF")]), 422, "validation"),
    (dict(known=("OMA",)), 404, "Departure airport was not found"),
    (dict(pages=[page(FLIGHT, dep="TUL")]), 502, "did not return scheduled"),
    (dict(pages=[page(status=503, payload="{}")]), 503, "did not return scheduled"),
    (dict(pages=[page(payload='{"data": {"bad": "shape"}}')]), 502, "Aviation API scheduled flight data payload was invalid."),
    (dict(pages=[page(scheduled("BOI", "OMA", "11:00"))]), 404, "could not be matched"),
    (dict(pages=[page({"departure": FLIGHT["departure"], "arrival": {"iataCode": "OMA"}})]), 502, "missing scheduled"),
    (dict(requests=[request(dest="zzz")], pages=[page(scheduled("BOI", "ZZZ", "09:00"))]), 404, "No airport was matched"),
    (dict(pages=[page(scheduled("BOI", "OMA", "09:00:00"))]), 400, "Failed to parse"),
    (dict(weather=SKY[1:]), 502, "origin weather data"),
    (dict(weather=[SKY[0], (DAY, "OMA", 429, None)]), 429, "destination weather data"),
    (dict(weather=[(DAY, "BOI", 200, "{}"), SKY[1]]), 502, "did not return origin weather data"),
    (dict(weather=[SKY[0], (DAY, "OMA", 200, weather_document(1.0, rain_sum=["2"]))]), 502, "dest weather field 'rain_sum' value was invalid."),
    (dict(weather=[(DAY, "BOI", 200, '{"daily": 1}'), SKY[1]]), 502, "origin weather daily payload was invalid."),
])
def test_failures_are_reported_in_order(spark, airports, case, code, message):
    inputs = dict(requests=[request()], pages=[page(FLIGHT)], weather=SKY) | case
    rows = outcome(spark, airports, **inputs)
    row = rows.collect()[0]
    assert row.status_code == code and message in row.message
    assert scoring.quarantine(rows).collect()[0].code == code


def test_lenient_clock_and_normalised_requests(spark, airports):
    pages = [page(scheduled("BOI", "OMA", "09:00:00", "2026-08-07T08:10"))]
    typed = scoring.normalise_requests(spark.createDataFrame([request(clock=" 09:00 ", dep=" boi", dest="oma ")], REQUEST))
    rows = outcome(spark, airports, typed.collect(), pages, SKY, strict_clock=False)
    row = rows.collect()[0]
    assert (row.status_code, row.pred_elapsed_time) == (200, 1390)


def test_requests_are_never_multiplied(spark, airports):
    doubled = airports.union(airports)
    pages = [page(FLIGHT, number=n) for n in range(3)]
    asked = [request(n) for n in range(50)]
    rows = outcome(spark, doubled, asked, pages, SKY, known=("BOI", "BOI", "OMA"))
    assert sorted(r.req_id for r in rows.collect()) == list(range(50))
    assert one_per_code(doubled).count() == 3


def test_out_of_range_airport_is_a_distance_error(spark, airports):
    moved = airports.withColumn("lat", F.when(F.col("code") == "OMA", 120.0).otherwise(F.col("lat")))
    row = outcome(spark, moved, [request()], [page(FLIGHT)], SKY).collect()[0]
    assert (row.stage, row.status_code) == ("distance", 400)


def test_unknown_fields_reject_a_request_and_details_tell_why(spark, airports):
    asked = spark.createDataFrame([request(1), request(2), request(3, clock="23:00")], REQUEST).withColumn(
        "document", F.when(F.col("req_id") == 2, '{"date": "2026-08-07", "seat": "12A"}').otherwise('{"date": "2026-08-07"}'))
    known = spark.createDataFrame([("BOI",)], "code string")
    pages = spark.createDataFrame([page(FLIGHT)], PAGE)
    weather = spark.createDataFrame(SKY, "date date, code string, status_code int, payload string")
    rows = {r.req_id: r for r in scoring.request_outcomes(asked, known, pages, airports, weather).collect()}
    assert rows[1].status_code == 200 and rows[1].detail is None and rows[1].dep_clock == "09:00"
    assert (rows[2].status_code, rows[2].detail) == (422, '{"fields":["seat"]}')
    assert (rows[3].stage, rows[3].detail) == ("match", '{"origin":"BOI","dest":"OMA","minutes":1380}')
