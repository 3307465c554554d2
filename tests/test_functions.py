from __future__ import annotations

import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarmac.functions import clock, geo, requests, text
from tests.fixtures import weather_document
from tarmac.operators import profile
from tarmac.operators.features import weather_values
from tarmac.plans.scoring import strict_weather


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [row[0] for row in rows.orderBy("i").select(column(F.col("x"))).collect()]


def expected_minutes(given: str):
    """What the standard library makes of a clock text."""
    given = given.strip()
    for pattern in ("%H:%M", "%H:%M:%S", "%H%M"):
        try:
            found = datetime.strptime(given, pattern)
            return found.hour * 60 + found.minute
        except ValueError:
            continue
    try:
        found = datetime.fromisoformat(given.replace("Z", "+00:00"))
        return found.hour * 60 + found.minute
    except ValueError:
        return None


def test_clock_minutes_agree_with_the_standard_library(spark):
    texts = [
        "09:00", "9:05", " 09:00 ", "\t7:3\n", "930", "123", "0905", "2359", "24:00", "", "1430Z", "12:30:59",
        "12:30:60", "2026-08-20", "2026-08-20T14:30:00Z", "2026-08-20T14:30:00.000", "2026-08-20 14:30",
        "2026-02-30T10:00", "2026-08-20T14:30+02:00", "20260820T1430", "nine", "2026-08-20T25:00", "12:60", "0960",
    ]
    texts += [str(n) for n in range(0, 10000, 7)] + [f"{n:04d}" for n in range(0, 10000, 13)]
    assert values(spark, clock.clock_minutes, texts) == [expected_minutes(t) for t in texts]


def test_normalize_clock_keeps_unknown_text(spark):
    given = ["9:05", "123", " odd ", "2026-08-20", "", None]
    assert values(spark, clock.normalize_clock, given) == ["09:05", "12:03", "odd", "00:00", "", None]


def test_clocks_match_is_circular_and_false_for_unknown(spark):
    def near(other, tolerance=30):
        return lambda c: clock.clocks_match(c, F.lit(other), tolerance)

    assert values(spark, near("00:10"), ["23:50", "23:39", "00:41", "junk", None]) == [True, False, False, False, False]
    assert values(spark, near("09:00"), ["08:31", "09:30", "09:31"]) == [True, True, False]


def test_elapsed_and_hhmm(spark):
    row = spark.range(1).select(
        clock.elapsed_minutes(F.lit(540), F.lit(750)), clock.elapsed_minutes(F.lit(1430), F.lit(20)),
        clock.hhmm(F.lit(545)),
    ).collect()[0]
    assert tuple(row) == (210, 30, 905)


def test_calendar_parts_use_iso_weekdays(spark):
    parts = clock.calendar_parts(F.lit("2026-08-07").cast("date"))
    row = spark.range(1).select(*parts.values(), (clock.calendar_parts(F.lit("2026-08-09").cast("date")))["day_of_week"])
    assert tuple(row.collect()[0]) == (2026, 8, 7, 5, 7)


def miles(lat1, long1, lat2, long2):
    half = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    half += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(long2 - long1) / 2) ** 2
    return round(3958.7613 * 2 * math.atan2(math.sqrt(half), math.sqrt(1 - half)))


def test_distance(spark):
    pairs = [(43.5644, -116.2228, 43.5644, -116.2228), (43.5644, -116.2228, 41.3032, -95.8941), (-33.9, 151.2, 51.5, -0.1)]
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    found = [r[0] for r in rows.select(geo.distance_miles(*map(F.col, "abcd"))).collect()]
    assert found == [miles(*p) for p in pairs]
    assert found[0] == 0 and 1000 < found[1] < 1100


def test_coordinate_status(spark):
    rows = [(40.0, 1.0), (120.0, 1.0), (None, 1.0), (math.nan, 1.0), (40.0, -181.0), (90.0, 180.0), (math.inf, 0.0)]
    df = spark.createDataFrame(rows, "lat double, long double")
    status = geo.coordinate_status(F.col("lat"), F.col("long"), F.lit(0.0), F.lit(0.0))
    assert [r[0] for r in df.select(status).collect()] == [200, 400, 500, 400, 400, 200, 400]


def test_redaction(spark):
    url = "http:mockurl.com?date=2020-20-20&apikey=MOCK-KEY&other=abcd&access_key=MOCK-KEY"
    assert values(spark, text.redact_url, [url, "http://a?b=c"]) == [
        "http:mockurl.com?date=2020-20-20&apikey=REDACTED&other=abcd&access_key=REDACTED", "http://a?b=c",
    ]
    pairs = F.create_map(F.lit("apikey"), F.col("x"), F.lit("other"), F.lit("kept"))
    found = values(spark, lambda c: text.redact_map(pairs), ["MOCK-KEY"])[0]
    assert found == {"apikey": "REDACTED", "other": "kept"}


def test_nested_text(spark):
    documents = ['{"flight":{"iataNumber":"AA100"}}', '{"flight":"AA100"}', '{"flight":{"iataNumber":100}}', "{}"]
    column = lambda c: text.nested_text(F.parse_json(c), "flight", "iataNumber")
    assert values(spark, column, documents) == ["AA100", "", "", ""]


def test_weather_url_carries_no_key(spark):
    df = spark.sql("SELECT 43.5644D AS lat, -116.2228D AS long, DATE'2024-01-02' AS day")
    url = df.select(text.weather_url("https://w.example", F.col("lat"), F.col("long"), F.col("day"))).collect()[0][0]
    assert url.startswith("https://w.example?latitude=43.5644&longitude=-116.2228&start_date=2024-01-02&end_date=2024-01-02")
    assert "weather_code%2Ctemperature_2m_max" in url and url.endswith("&timezone=auto") and "key" not in url


def test_request_errors(spark):
    rows = [
        ("2026-08-07", "09:00", "BOI", "OMA"), ("2026-8-7", "9:00", "JF", None), ("2026-02-30", "24:00", "BOI", "OMAX"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    found = [r[0] for r in df.select(requests.request_errors(*map(F.col, "abcd"))).collect()]
    every = ["date", "scheduledDepartureTime", "depIataCode", "destIataCode"]
    assert found == [[], every, ["date", "scheduledDepartureTime", "destIataCode"], every]


def test_unknown_fields(spark):
    documents = ['{"date":"2026-08-29","car":"no"}', '{"date":"2026-08-29"}', "junk"]
    assert values(spark, requests.unknown_fields, documents) == [["car"], [], []]


def test_presentation(spark):
    assert values(spark, requests.percent_text, [0.8, 0.005, 0.125, None], "double") == ["80%", "1%", "13%", "--"]
    assert values(spark, requests.risk_label, [True, False, None], "boolean") == ["Significant", "Low", "--"]
    assert values(spark, requests.significant_delay, [24.9, 25.0, None], "double") == [0, 1, None]


@pytest.mark.parametrize("document, expected", [
    (weather_document(2.0), 2.0),
    (weather_document(2.0, rain_sum=["2.5"]), 2.5),
    (weather_document(2.0, rain_sum=[]), None),
    (weather_document(2.0, rain_sum=[None]), None),
    (weather_document(2.0, rain_sum=None), None),
    (weather_document(2.0, rain_sum=[True]), None),
    (weather_document(2.0, rain_sum=[7, "x"]), 7.0),
    ('{"daily": 5}', None),
    ("junk", None),
])
def test_lenient_weather(spark, document, expected):
    rows = spark.createDataFrame([("2024-01-01", "BOI", document)], "date string, code string, payload string")
    row = weather_values(rows).collect()[0]
    assert row.rain_sum == expected
    assert row.pressure_msl_mean == (2.0 if document.startswith('{"daily": {') else None)


@pytest.mark.parametrize("document, fault", [
    (weather_document(3), None),
    (weather_document(1.0, rain_sum=[1, "x"]), None),
    ('{"daily": {"weather_code": []}}', "{end} weather field 'weather_code' was missing or invalid."),
    (weather_document(1.0, rain_sum=None), "{end} weather field 'rain_sum' was missing or invalid."),
    (weather_document(1.0, rain_sum=5), "{end} weather field 'rain_sum' was missing or invalid."),
    (weather_document(1.0, rain_sum=["2"], snowfall_sum=None), "{end} weather field 'rain_sum' value was invalid."),
    (weather_document(1.0, rain_sum=[True]), "{end} weather field 'rain_sum' value was invalid."),
    (weather_document(1.0, rain_sum=[None]), "{end} weather field 'rain_sum' value was invalid."),
    ('{"daily": [1]}', "{end} weather daily payload was invalid."),
    ("junk", "{end} weather daily payload was invalid."),
])
def test_strict_weather(spark, document, fault):
    rows = spark.createDataFrame(
        [("2024-01-01", "BOI", 200, document)], "date string, code string, status_code int, payload string"
    )
    row = strict_weather(rows).collect()[0]
    assert row.fault == fault
    if fault is None:
        assert row.rain_sum == (3.0 if "3" in re.findall(r'"rain_sum": \[(\d)', document) else 1.0)


@pytest.mark.parametrize("text, minutes", [
    ("2026-08-20T14:30+02", 870), ("2026-08-20T14:30+0200", 870), ("2026-08-20T14:30:15.5-05:30", 870), ("20260820T143000", 870),
    ("2026-08-20T14:30Z", 870), ("2026-08-20T14", 840), ("2026-08-20", 0), ("2026-08-20T14:3000", None), ("2026-08-20T1430:00", None),
    ("2026-08-20T14:30+25", None), ("2026-08-20T14:30+2:00", None),
])
def test_iso_offsets_and_separators(spark, text, minutes):
    row = spark.createDataFrame([(text,)], "t string").select(clock.clock_minutes(F.col("t")).alias("m")).first()
    assert row.m == minutes


def test_nan_counts_as_missing(spark):
    rows = spark.createDataFrame([(1, float("nan"), "a"), (1, 2.0, None), (0, None, "b")], "significant int, x double, y string")
    found = {row.feature: (row.not_significant, row.significant) for row in profile.missing_by_target(rows, ("x", "y")).collect()}
    assert found == {"x": (1.0, 0.5), "y": (0.0, 0.5)}
