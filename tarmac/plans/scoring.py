"""Batch scoring of requested flights with a per-row outcome."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.fields import MATCH_TOLERANCE_MINUTES, MODEL_FEATURES, SCHEDULE_FEATURES, WEATHER_FIELDS
from tarmac.functions.clock import calendar_parts, clock_minutes, elapsed_minutes, hhmm, short_clock_minutes
from tarmac.functions.geo import coordinate_status, distance_miles
from tarmac.functions.requests import miles_text, percent_text, request_errors, risk_label, unknown_fields
from tarmac.functions.text import airport_code
from tarmac.functions.weather import first_elements, strict_fault, strict_values
from tarmac.operators.clean import one_per_code
from tarmac.operators.hot_keys import heavy_keys, lookup_join
from tarmac.operators.matching import match_schedule, schedule_documents, schedule_rows, schedule_status
from tarmac.operators.settle import settled
from tarmac.operators.state import with_membership
from tarmac.plans.training import predict
from tarmac.sources.documents import BLANK, DOCUMENT, is_stored, parsed, stored_documents
from tarmac.sources.scratch import stage

# The messages of each outcome.
MESSAGES = {
    "request": "Request failed validation.",
    "departure_airport": "Departure airport was not found in weather_req_table.",
    "schedule_absent": "Aviation API did not return scheduled flight data.",
    "schedule_malformed": "Aviation API scheduled flight data payload was invalid.",
    "match": "Flight could not be matched to Aviation Stack response",
    "times": "Matched Aviation API flight is missing scheduled departure or arrival time.",
    "airports": "No airport was matched to the airport_data dataset",
    "clocks": "Failed to parse scheduled flight times",
    "distance": "Flight distance data failed validation.",
    "origin_weather": "Open-Meteo API did not return origin weather data.",
    "dest_weather": "Open-Meteo API did not return destination weather data.",
    "flight_fields": "ML model input is missing required flight data.",
    "complete": "Flight delay prediction complete.",
}


# What a complete result tells about the flight beside its prediction.
RESPONSE_FIELDS = (
    "origin_city_name", "origin_lat", "origin_long", "dest_city_name", "dest_lat", "dest_long", "flight_date", "dep_clock", "arr_clock",
    "pred_dep_time", "pred_arr_time", "pred_elapsed_time",
)


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Requests as the form sends them: every field trimmed, codes upper-cased; normalising twice changes nothing."""
    return requests.withColumns({
        "date": F.trim("date"),
        "scheduledDepartureTime": F.trim("scheduledDepartureTime"),
        "depIataCode": airport_code(F.col("depIataCode")),
        "destIataCode": airport_code(F.col("destIataCode")),
    })


def checked_requests(requests: DataFrame) -> DataFrame:
    """Typed requests with their validation errors; date and minutes are NULL when invalid.

    A column ``document`` with the request as it was sent is optional; fields in it that no request has are errors too.
    """
    text = {name: F.col(name) for name in ("date", "scheduledDepartureTime", "depIataCode", "destIataCode")}
    errors = request_errors(*text.values())
    valid = F.size("request_errors") == 0
    if "document" in requests.columns:
        errors = F.concat(errors, unknown_fields(F.col("document")))
    checked = requests.withColumn("request_errors", errors).select(
        "req_id", "request_errors", "depIataCode", "destIataCode",
        F.when(valid, text["date"].try_cast("date")).alias("date"),
        F.when(valid, short_clock_minutes(text["scheduledDepartureTime"])).alias("dep_minutes"),
        F.upper("depIataCode").alias("dep_code"), F.upper("destIataCode").alias("dest_code"),
    )
    return settled(checked)


def strict_weather(responses: DataFrame) -> DataFrame:
    """One row per airport day (date, code, status_code, and payload or a stored document) with its fault and 14 values."""
    stored = responses if is_stored(responses) else parsed(responses)
    rows = stored.selectExpr("date", "code", f"status_code <> 200 OR {BLANK} AS absent", "status_code", DOCUMENT)
    kept = ("date", "code", "absent", "status_code")
    elements = rows.selectExpr(*kept, "document", *first_elements("document"))
    return elements.selectExpr(*kept, strict_fault("document"), *strict_values())


def _weather_at(weather: DataFrame, end: str, code: str) -> DataFrame:
    """One row per airport day; the 14 values travel as one struct, since Spark compiles no stage that hands on so many columns."""
    return weather.selectExpr(
        "date", f"code AS {code}", f"absent AS {end}_absent", f"status_code AS {end}_status",
        f"replace(fault, '{{end}}', '{end}') AS {end}_fault",
        f"struct({', '.join(WEATHER_FIELDS)}) AS {end}_values",
    )


def _airport_at(airports: DataFrame, end: str, code: str) -> DataFrame:
    return airports.select(
        F.col("code").alias(code), F.lit(True).alias(f"{end}_found"),
        F.col("name").alias(f"{end}_city_name"), F.col("lat").alias(f"{end}_lat"),
        F.col("long").alias(f"{end}_long"),
    )


ENDS = {"origin": "depIataCode", "dest": "destIataCode"}


def heavy_airports(requests: DataFrame) -> dict[str, DataFrame]:
    """For each code column of stored requests, the airports that very many of them name."""
    return {code: heavy_keys(requests, code) for code in ENDS.values()}


def with_airports(requests: DataFrame, airports: DataFrame, heavy: dict[str, DataFrame] | None = None) -> DataFrame:
    """Both airports of each request, as two lookups with one row per code that spread the airports most requests name.

    The airports are written once for both ends. Without ``heavy_airports`` the requests are written and measured here.
    """
    single = stage(one_per_code(airports), "airports")
    if heavy is None:
        requests = stage(requests, "requests")
        heavy = heavy_airports(requests)
    for end, code in ENDS.items():
        requests = lookup_join(requests, _airport_at(single, end, code), code, heavy=heavy[code])
    return requests


def with_clocks(matched: DataFrame, strict_clock: bool = True) -> DataFrame:
    """The matched clock texts and their minutes (``dep_at``, ``arr_at``), each text parsed once.

    With ``strict_clock`` the matched times must be plain ``H:M`` text; without it
    every clock format that matching understands is accepted.
    """
    minutes = short_clock_minutes if strict_clock else clock_minutes
    return settled(matched.withColumns({
        "dep_clock": F.col("matched.dep_clock"), "arr_clock": F.col("matched.arr_clock"),
        "dep_at": minutes(F.col("matched.dep_clock")), "arr_at": minutes(F.col("matched.arr_clock")),
    }))


def flight_columns() -> dict[str, Column]:
    """Flight fields from the request date, both airports and the matched clock minutes."""
    dep, arr = F.col("dep_at"), F.col("arr_at")
    return {
        "flight_date": F.col("date"), "origin": F.col("depIataCode"), "dest": F.col("destIataCode"),
        **calendar_parts(F.col("date")),
        "pred_dep_time": hhmm(dep), "pred_arr_time": hhmm(arr),
        "pred_elapsed_time": elapsed_minutes(dep, arr),
        "fl_distance": distance_miles(
            F.col("origin_lat"), F.col("origin_long"), F.col("dest_lat"), F.col("dest_long")
        ),
    }


def flight_rows(requests: DataFrame, schedule: DataFrame, airports: DataFrame,
                tolerance: int = MATCH_TOLERANCE_MINUTES, strict_clock: bool = True, heavy: dict[str, DataFrame] | None = None) -> DataFrame:
    """Requests with the matched schedule entry, both airports and the flight fields.

    Requests are matched while they are narrow, so the one join that shuffles them carries little.
    """
    matched = with_clocks(match_schedule(requests, schedule, tolerance), strict_clock)
    return settled(with_airports(matched, airports, heavy).withColumns(flight_columns()).drop("dep_at", "arr_at"))


def _ladder() -> list[tuple[str, str, str, str | None]]:
    """(stage, failing condition, status code, own message) in the order they are reported."""
    airport = [f"{end}_{part} IS NULL" for end in ("origin", "dest") for part in ("city_name", "lat", "long")]
    coordinates = ["origin_lat", "origin_long", "dest_lat", "dest_long"]
    weather = []
    for end in ("origin", "dest"):
        code = f"CASE WHEN {end}_status <> 200 THEN {end}_status ELSE 502 END"
        weather.append((f"{end}_weather", f"coalesce({end}_absent, true)", code, None))
    for end in ("origin", "dest"):
        weather.append((f"{end}_weather", f"{end}_fault IS NOT NULL", "502", f"{end}_fault"))
    return [
        ("request", "size(request_errors) > 0", "422", None),
        ("departure_airport", "NOT known_departure", "404", None),
        ("schedule_absent", "schedule_listed IS NULL OR schedule_fault = 'absent'", "coalesce(error_code, 502)", None),
        ("schedule_malformed", "schedule_fault = 'malformed'", "502", None),
        ("match", "matched IS NULL", "404", None),
        ("times", "dep_clock = '' OR arr_clock = ''", "502", None),
        ("airports", "origin_found IS NULL OR dest_found IS NULL", "404", None),
        ("clocks", " OR ".join(["pred_dep_time IS NULL", "pred_arr_time IS NULL", *airport]), "400", None),
        ("distance", "coordinates <> 200", "coordinates", None),
        *weather,
        ("flight_fields", " OR ".join(f"{name} IS NULL" for name in SCHEDULE_FEATURES), "500", None),
        ("complete", "true", "200", None),
    ]


def with_outcome(rows: DataFrame) -> DataFrame:
    """Add stage, status code and message of the first failing stage."""
    steps = _ladder()
    at = "CASE " + " ".join(f"WHEN {failing} THEN {step}" for step, (_, failing, _, _) in enumerate(steps)) + " END"
    coordinates = coordinate_status(*map(F.col, ("origin_lat", "origin_long", "dest_lat", "dest_long")))
    placed = rows.withColumn("coordinates", coordinates).withColumn("step", F.expr(at))
    details = {
        "request": "to_json(named_struct('fields', request_errors))",
        "schedule_absent": "to_json(named_struct('status', error_code))",
        "distance": "to_json(named_struct('origin_lat', origin_lat, 'origin_long', origin_long, 'dest_lat', dest_lat, 'dest_long', dest_long))",
        "match": "to_json(named_struct('origin', dep_code, 'dest', dest_code, 'minutes', dep_minutes))",
        "times": "to_json(named_struct('departure', dep_clock, 'arrival', arr_clock))",
        "clocks": "to_json(named_struct('departure', dep_clock, 'arrival', arr_clock))",
        "origin_weather": "to_json(named_struct('status', origin_status))",
        "dest_weather": "to_json(named_struct('status', dest_status))",
    }

    def by_step(values: list[str]) -> Column:
        return F.expr("CASE step " + " ".join(f"WHEN {step} THEN {value}" for step, value in enumerate(values)) + " END")

    return placed.withColumns({
        "stage": by_step([f"'{stage}'" for stage, *_ in steps]),
        "status_code": by_step([f"CAST({code} AS INT)" for _, _, code, _ in steps]),
        "message": by_step([own or f"'{MESSAGES[stage]}'" for stage, _, _, own in steps]),
        "detail": by_step([details.get(stage, "CAST(NULL AS STRING)") for stage, *_ in steps]),
    })


def request_outcomes(
    requests: DataFrame,
    known_codes: DataFrame,
    schedule_responses: DataFrame,
    airports: DataFrame,
    weather_responses: DataFrame,
    tolerance: int = MATCH_TOLERANCE_MINUTES,
    strict_clock: bool = True,
) -> DataFrame:
    """Every request with stage, status code, message and, where complete, all model features.

    Each lookup side is reduced to one row per key before it is joined, so a
    request is never multiplied and a hot airport or route costs one row there.
    The larger lookups are written once: weather is parsed once for both ends, and
    the joins shuffle plain scans, whose hot keys the adaptive planner can split.
    """
    # Pages are parsed once, when they are written, for the status and for the flights.
    documents = schedule_documents(stored_documents(schedule_responses, label="schedule-pages"))
    status = stage(schedule_status(documents), "schedule-status").withColumn("schedule_listed", F.lit(True))
    weather = stage(strict_weather(weather_responses), "strict-weather")
    checked = stage(checked_requests(normalise_requests(requests)), "checked-requests")
    heavy = heavy_airports(checked)
    flights = flight_rows(checked, schedule_rows(documents), airports, tolerance, strict_clock, heavy)
    placed = (
        with_membership(flights, "depIataCode", known_codes, "known_departure", heavy["depIataCode"])
        .join(status, ["date", "dep_code"], "left")
        .join(_weather_at(weather, "dest", "destIataCode"), ["date", "destIataCode"], "left")
        .join(_weather_at(weather, "origin", "depIataCode"), ["date", "depIataCode"], "left")
    )
    values = {f"{end}_{field}": f"{end}_values.{field}" for end in ENDS for field in WEATHER_FIELDS}
    return with_outcome(placed).select(
        "req_id", "stage", "status_code", "message", "detail", "dep_clock", "arr_clock",
        "origin_city_name", "dest_city_name", "origin_lat", "origin_long", "dest_lat", "dest_long",
        *[F.col(values.get(name, name)).alias(name) for name in MODEL_FEATURES],
    )


def quarantine(outcomes: DataFrame) -> DataFrame:
    """The failed requests, as error records."""
    records = settled(outcomes.select(
        "req_id", "stage", F.col("status_code").alias("code"), F.col("message").alias("description"), "detail"
    ))
    return records.where(F.col("code") != 200)


def score_requests(outcomes: DataFrame, model: PipelineModel) -> DataFrame:
    """Results for every request; only complete ones pass through the forest.

    Outcomes are written once. A complete result also has both airports and the matched flight.
    """
    stored = stage(outcomes, "outcomes")
    complete = F.col("status_code") == 200
    scored = predict(model, stored.where(complete)).unionByName(
        stored.where(~complete).withColumns({"prediction": F.lit(None).cast("int"), "probability": F.lit(None).cast("double")}))
    probability = F.when(complete, F.col("probability"))
    significant = F.when(complete, F.col("prediction") == 1)
    return scored.select(
        "req_id", "stage", "status_code", "message",
        significant.alias("is_significant_delay"), probability.alias("significant_delay_probability"),
        F.when(complete, F.col("fl_distance")).cast("int").alias("fl_distance"),
        *[F.when(complete, F.col(name).cast("int") if name == "pred_elapsed_time" else F.col(name)).alias(name) for name in RESPONSE_FIELDS],
        risk_label(significant).alias("risk"), percent_text(probability).alias("probability_text"),
        miles_text(F.when(complete, F.col("fl_distance"))).alias("distance_text"),
    )
