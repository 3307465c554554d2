"""Flight, airport, weather, schedule and request tables derived from the driver tables.

The driver has no flight data, so orders stand in for flights and requests,
events for weather documents and provider responses, nations for airports. Every
view reads its whole table. ``CTE`` holds the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.fields import WEATHER_FIELDS
from tarmac.operators.clean import clean_airports, clean_flights, enrichment_requests

NOW = "TIMESTAMP '2024-03-01 00:00:00'"
WEATHER_ADDRESS = "https://weather.example/v1/archive"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def now() -> Column:
    return F.expr(NOW)


def code(number: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(number.cast("string"), 2, "0"))


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a flights source; a few keys and delay causes are unknown."""
    dated = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "date_add(DATE '2024-01-01', CAST(o_orderkey % 40 AS INT)) AS fl_date",
        "o_custkey % 25 AS origin_number", "(o_orderkey + o_custkey * 3) % 25 AS dest_number",
    )
    return dated.selectExpr(
        "fl_date", "year(fl_date) AS year", "month(fl_date) AS month", "day(fl_date) AS day_of_month",
        "weekday(fl_date) + 1 AS day_of_week",
        "CASE WHEN o_orderkey % 101 <> 7 THEN CAST(o_orderkey AS DOUBLE) END AS op_carrier_fl_num",
        "concat('N', lpad(origin_number, 2, '0')) AS origin",
        "concat('City ', origin_number, ', XX') AS origin_city_name",
        "CASE WHEN o_orderkey % 89 <> 5 THEN concat('N', lpad(dest_number, 2, '0')) END AS dest",
        "concat('City ', dest_number, ', XX') AS dest_city_name",
        "(o_orderkey % 24) * 100 + o_orderkey % 60 + (o_custkey % 3) * 0.25D AS crs_dep_time",
        "CAST(((o_orderkey + 2) % 24) * 100 + o_custkey % 60 AS DOUBLE) AS crs_arr_time",
        "CAST(o_custkey % 360 + 30 AS DOUBLE) AS crs_elapsed_time",
        "CAST(o_custkey % 2500 + 100 AS DOUBLE) AS distance",
        "CAST(nullif(o_orderkey % 11, 10) AS DOUBLE) AS carrier_delay",
        "CAST(o_custkey % 7 AS DOUBLE) AS weather_delay",
        "CAST(o_orderkey % 13 AS DOUBLE) AS nas_delay",
        "0.0D AS security_delay",
        "CAST(o_orderkey % 29 AS DOUBLE) AS late_aircraft_delay",
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_flights(raw_flights(spark, sf_dir))


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("n_nationkey")
    return clean_airports(read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), (nation * 7.0 - 84).alias("latitude_deg"),
        (nation * 14.0 - 170).alias("longitude_deg"), code(nation).alias("iata_code"),
    ))


def raw_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of an airports source, some without a code."""
    cust = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        ((cust % 181) - 90).cast("string").alias("latitude_deg"),
        ((cust % 361) - 180).cast("string").alias("longitude_deg"),
        F.when(cust % 4 != 1, code(F.col("c_nationkey"))).alias("iata_code"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment_requests(flights(spark, sf_dir), airports(spark, sf_dir), now())


def _event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _clock(minutes: str) -> str:
    return f"concat(lpad(({minutes}) div 60, 2, '0'), ':', lpad(({minutes}) % 60, 2, '0'))"


def _weather_payload() -> str:
    """JSON documents including every malformation the parsers must survive."""
    odd = {
        "showers_sum": "WHEN k % 10 = 0 THEN '\"showers_sum\":[null]'",
        "rain_sum": "WHEN k = 7 THEN NULL",
        "snowfall_sum": "WHEN k = 13 THEN '\"snowfall_sum\":[]'",
        "pressure_msl_mean": "WHEN k = 23 THEN '\"pressure_msl_mean\":[true]'",
        "cloud_cover_mean": "WHEN k = 29 THEN concat('\"cloud_cover_mean\":[\"', value + k * 9, '\"]')",
    }
    fragments = []
    for index, field in enumerate(WEATHER_FIELDS):
        text = f"concat('\"{field}\":[', value + k * {index}, ']')"
        fragments.append(f"CASE {odd[field]} ELSE {text} END" if field in odd else text)
    document = f"concat('{{\"daily\":{{', concat_ws(',', {', '.join(fragments)}), '}}}}')"
    return f"""CASE WHEN k = 31 THEN '{{"daily":5}}' WHEN k = 37 THEN '{{"daily":' ELSE {document} END AS payload"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a stored weather response; keys have many versions."""
    return read(spark, sf_dir, "events").withColumn("k", _event_k()).select(
        code(F.col("user_id") % 23).alias("code"),
        F.col("ts").cast("date").alias("date"),
        F.lit(WEATHER_ADDRESS).alias("api_url"),
        F.col("ts").alias("fetched_at"),
        F.expr(_weather_payload()),
        F.col("event_id").alias("seq"),
        F.when(F.col("k") == 53, 503).otherwise(200).alias("status_code"),
    )


def schedule_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one page of a provider's schedule for a departure airport.

    A page lists a junk element and two flights, with clock text in several
    formats; some airport days only ever get errors or malformed pages.
    """
    pages = read(spark, sf_dir, "events").selectExpr(
        "event_id", "CAST(ts AS DATE) AS date", "day(ts) AS day", "user_id % 5 AS dep_number",
        "concat('N', lpad(user_id % 5, 2, '0')) AS dep_code", "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CAST((event_id * 37 + user_id * 13) % 1440 AS INT) AS first_minutes",
    ).selectExpr("*", "(first_minutes + 37) % 1440 AS second_minutes").selectExpr(
        "*", *[f"{_clock(minutes)} AS {name}" for name, minutes in (
            ("first_dep", "first_minutes"), ("first_arr", "(first_minutes + 30 + k) % 1440"),
            ("second_dep", "second_minutes"), ("second_arr", "(second_minutes + 30 + k) % 1440"),
        )]
    )

    def written(text: str) -> str:
        return f"""CASE event_id % 4 WHEN 0 THEN {text} WHEN 1 THEN concat({text}, ':00')
            WHEN 2 THEN replace({text}, ':', '') ELSE concat(date, 'T', {text}, ':00.000Z') END"""

    def flight(dep_code: str, dep_clock: str, dest_code: str, arr_clock: str) -> str:
        return f"""to_json(named_struct(
            'departure', named_struct('iataCode', {dep_code}, 'scheduledTime', {dep_clock}),
            'arrival', named_struct('iataCode', {dest_code}, 'scheduledTime', {arr_clock})))"""

    listed_a = flight(
        "CASE WHEN event_id % 3 = 0 THEN lower(dep_code) ELSE dep_code END", written("first_dep"),
        "CASE WHEN event_id % 47 = 0 THEN 'ZZY' ELSE concat('N', lpad(event_id % 5, 2, '0')) END",
        f"CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 2 = 0 THEN first_arr ELSE {written('first_arr')} END",
    )
    listed_b = flight("dep_code", "second_dep", "concat('N', lpad((event_id + 1) % 5, 2, '0'))", "second_arr")
    return pages.selectExpr(
        "date", "dep_code", "event_id AS page",
        "CASE WHEN day = 3 AND dep_number = 0 THEN 503 ELSE 200 END AS status_code",
        f"""CASE WHEN day = 3 AND dep_number = 0 THEN NULL
            WHEN day = 5 AND dep_number = 1 THEN '{{"data":{{"bad":"shape"}}}}'
            WHEN day = 7 AND dep_number = 2 THEN '{{"data":[]}}'
            ELSE concat('{{"data":["invalid",', {listed_a}, ',', {listed_b}, ']}}') END AS payload""",
    )


def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a request as a person would type it, valid or not."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS req_id",
        """CASE WHEN o_orderkey % 53 = 0 THEN '2024-13-01'
            ELSE CAST(date_add(DATE '2024-01-01', CAST(o_orderkey % 40 AS INT)) AS STRING) END AS date""",
        f"""CASE WHEN o_orderkey % 61 = 0 THEN '9h'
            ELSE concat(' ', {_clock("(o_orderkey * 11) % 1440")}) END AS scheduledDepartureTime""",
        """CASE WHEN o_orderkey % 41 = 0 THEN 'ZZZ'
            WHEN o_orderkey % 17 = 0 THEN concat(' n', lpad(o_custkey % 5, 2, '0'))
            ELSE concat('N', lpad(o_custkey % 5, 2, '0')) END AS depIataCode""",
        """CASE WHEN o_orderkey % 43 = 0 THEN 'ZZY' WHEN o_orderkey % 59 = 0 THEN 'TOOL'
            ELSE concat('N', lpad((o_orderkey + o_custkey) % 5, 2, '0')) END AS destIataCode""",
    )


def _sql_code(number: str) -> str:
    return f"('N' || lpad(CAST({number} AS VARCHAR), 2, '0'))"


def _sql_weather_value(index: int, field: str) -> str:
    """Lenient value of one field, straight from the event."""
    number = f"(value + k * {index})"
    absent = "k IN (31, 37)"
    if field == "showers_sum":
        absent += " OR k % 10 = 0"
    if field == "rain_sum":
        absent += " OR k = 7"
    if field == "snowfall_sum":
        absent += " OR k = 13"
    if field == "pressure_msl_mean":
        absent += " OR k = 23"
    return f"CASE WHEN {absent} THEN NULL ELSE {number} END AS {field}"


CTE = {
    "raw_flights": f"""
        SELECT DATE '2024-01-01' + CAST(o_orderkey % 40 AS INTEGER) AS fl_date,
            CASE WHEN o_orderkey % 101 <> 7 THEN CAST(o_orderkey AS DOUBLE) END AS op_carrier_fl_num,
            {_sql_code('o_custkey % 25')} AS origin,
            'City ' || CAST(o_custkey % 25 AS VARCHAR) || ', XX' AS origin_city_name,
            CASE WHEN o_orderkey % 89 <> 5 THEN {_sql_code('(o_orderkey + o_custkey * 3) % 25')} END AS dest,
            'City ' || CAST((o_orderkey + o_custkey * 3) % 25 AS VARCHAR) || ', XX' AS dest_city_name,
            CAST((o_orderkey % 24) * 100 + o_orderkey % 60 AS DOUBLE) + (o_custkey % 3) * 0.25e0 AS crs_dep_time,
            CAST(((o_orderkey + 2) % 24) * 100 + o_custkey % 60 AS DOUBLE) AS crs_arr_time,
            CAST(o_custkey % 360 + 30 AS DOUBLE) AS crs_elapsed_time,
            CAST(o_custkey % 2500 + 100 AS DOUBLE) AS distance,
            CAST(nullif(o_orderkey % 11, 10) AS DOUBLE) AS carrier_delay,
            CAST(o_custkey % 7 AS DOUBLE) AS weather_delay,
            CAST(o_orderkey % 13 AS DOUBLE) AS nas_delay,
            CAST(0 AS DOUBLE) AS security_delay,
            CAST(o_orderkey % 29 AS DOUBLE) AS late_aircraft_delay
        FROM orders""",
    "flights": """
        SELECT fl_date AS date, CAST(year(fl_date) AS INTEGER) AS year, CAST(month(fl_date) AS INTEGER) AS month,
            CAST(day(fl_date) AS INTEGER) AS day_of_month, CAST(isodow(fl_date) AS INTEGER) AS day_of_week,
            op_carrier_fl_num AS flight_number, origin, origin_city_name, dest, dest_city_name,
            CAST(round_even(crs_dep_time, 0) AS BIGINT) AS pred_dep_time,
            CAST(round_even(crs_arr_time, 0) AS BIGINT) AS pred_arr_time,
            crs_elapsed_time AS pred_elapsed_time, distance,
            carrier_delay + weather_delay + nas_delay + security_delay + late_aircraft_delay AS total_delay
        FROM raw_flights
        WHERE fl_date IS NOT NULL AND op_carrier_fl_num IS NOT NULL AND origin IS NOT NULL AND dest IS NOT NULL""",
    "airports": f"""
        SELECT n_name AS name, n_nationkey * 7.0e0 - 84 AS lat, n_nationkey * 14.0e0 - 170 AS long,
            {_sql_code('n_nationkey')} AS code
        FROM nation""",
    "requests": """
        SELECT d.date, d.code, a.name, a.lat, a.long, 'pending' AS status, 0 AS attempt_count,
            CAST(NULL AS VARCHAR) AS last_error
        FROM (SELECT date, origin AS code FROM flights UNION SELECT date, dest FROM flights) d
        JOIN airports a ON d.code = a.code""",
    "weather_events": f"""
        SELECT *, {_sql_code('user_id % 23')} AS code, CAST(ts AS DATE) AS date,
            CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    "newest_events": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY ts DESC, event_id DESC) AS version
            FROM weather_events) WHERE version = 1""",
    "weather": "SELECT code, date, " + ", ".join(
        _sql_weather_value(index, field) for index, field in enumerate(WEATHER_FIELDS)
    ) + " FROM newest_events",
    "dataset": """
        SELECT row_number() OVER (ORDER BY f.flight_number) AS id,
            f.date AS flight_date, f.year, f.month, f.day_of_month, f.day_of_week,
            f.flight_number AS flight_num, f.origin, f.origin_city_name, f.dest, f.dest_city_name,
            f.pred_dep_time, f.pred_arr_time, f.pred_elapsed_time, f.distance AS fl_distance,
            f.total_delay AS delay, """ + ", ".join(
        f"{alias}.{field} AS {end}_{field}"
        for alias, end in (("o", "origin"), ("d", "dest")) for field in WEATHER_FIELDS
    ) + """
        FROM flights f
        LEFT JOIN weather o ON o.date = f.date AND o.code = f.origin
        LEFT JOIN weather d ON d.date = f.date AND d.code = f.dest""",
    "schedule_events": f"""
        SELECT event_id, user_id % 5 AS dep_number, {_sql_code('user_id % 5')} AS dep_code,
            CAST(ts AS DATE) AS date, day(ts) AS day,
            CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
            CAST((event_id * 37 + user_id * 13) % 1440 AS INTEGER) AS first_minutes,
            CAST(((event_id * 37 + user_id * 13) % 1440 + 37) % 1440 AS INTEGER) AS second_minutes
        FROM events""",
    "schedule": f"""
        SELECT date, dep_code, event_id AS page, 1 AS item,
            CASE WHEN event_id % 47 = 0 THEN 'ZZY' ELSE {_sql_code('event_id % 5')} END AS dest_code,
            first_minutes AS dep_minutes,
            CASE WHEN event_id % 19 <> 0 THEN (first_minutes + 30 + k) % 1440 END AS arr_minutes,
            CASE WHEN event_id % 4 = 0 THEN TRUE ELSE FALSE END AS dep_short,
            CASE WHEN event_id % 2 = 0 OR event_id % 4 = 0 THEN TRUE ELSE FALSE END AS arr_short
        FROM schedule_events
        WHERE NOT (day = 3 AND dep_number = 0) AND NOT (day = 5 AND dep_number = 1)
            AND NOT (day = 7 AND dep_number = 2)
        UNION ALL
        SELECT date, dep_code, event_id, 2, {_sql_code('(event_id + 1) % 5')}, second_minutes,
            (second_minutes + 30 + k) % 1440, TRUE, TRUE
        FROM schedule_events
        WHERE NOT (day = 3 AND dep_number = 0) AND NOT (day = 5 AND dep_number = 1)
            AND NOT (day = 7 AND dep_number = 2)""",
    "asked": f"""
        SELECT o_orderkey AS req_id,
            CASE WHEN o_orderkey % 53 = 0 OR o_orderkey % 61 = 0
                OR (o_orderkey % 59 = 0 AND o_orderkey % 43 <> 0) THEN FALSE ELSE TRUE END AS valid,
            DATE '2024-01-01' + CAST(o_orderkey % 40 AS INTEGER) AS date,
            CAST((o_orderkey * 11) % 1440 AS INTEGER) AS dep_minutes,
            CASE WHEN o_orderkey % 41 = 0 THEN 'ZZZ' ELSE {_sql_code('o_custkey % 5')} END AS dep_code,
            CASE WHEN o_orderkey % 43 = 0 THEN 'ZZY' WHEN o_orderkey % 59 = 0 THEN 'TOOL'
                ELSE {_sql_code('(o_orderkey + o_custkey) % 5')} END AS dest_code
        FROM orders""",
    "matches": """
        SELECT * FROM (
            SELECT a.*, s.page, s.item, s.dep_minutes AS offered_minutes, s.arr_minutes, s.dep_short, s.arr_short,
                row_number() OVER (PARTITION BY a.req_id ORDER BY s.page, s.item) AS choice
            FROM asked a
            LEFT JOIN schedule s ON a.valid AND s.date = a.date AND s.dep_code = a.dep_code
                AND s.dest_code = a.dest_code
                AND least(abs(s.dep_minutes - a.dep_minutes), 1440 - abs(s.dep_minutes - a.dep_minutes)) <= 30
        ) WHERE choice = 1""",
}

# What each definition reads, in an order that satisfies WITH.
NEEDS = {
    "raw_flights": (), "flights": ("raw_flights",), "airports": (), "requests": ("flights", "airports"),
    "weather_events": (), "newest_events": ("weather_events",), "weather": ("newest_events",),
    "dataset": ("flights", "weather"), "schedule_events": (), "schedule": ("schedule_events",),
    "asked": (), "matches": ("asked", "schedule"),
}


def with_views(select: str, *names: str, **extra: str) -> str:
    """Prefix a SELECT with the definitions it reads, then any extra ones."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS[name]:
            visit(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({CTE[name]})" for name in wanted]
    parts += [f"{name} AS ({body})" for name, body in extra.items()]
    return f"WITH {', '.join(parts)} {select}"
