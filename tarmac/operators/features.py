"""The wide flight dataset: weather at both route ends, labels and feature projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.fields import CATEGORICAL_FEATURES, MODEL_FEATURES, WEATHER_FIELDS
from tarmac.functions.requests import significant_delay
from tarmac.functions.weather import daily_values, parse_daily, stored_values
from tarmac.operators.ids import dense_id
from tarmac.operators.state import latest_by_key
from tarmac.sources.documents import DOCUMENT, TEXT, is_stored
from tarmac.sources.scratch import stage

# The names flights take in the dataset.
DATASET_NAMES = {
    "date": "flight_date",
    "flight_number": "flight_num",
    "distance": "fl_distance",
    "total_delay": "delay",
}


# Numbers follow the flights themselves, not where a join left them. Rows that agree in all of these are alike to the model
# but for their cities and delay, which come last.
NATURAL_ORDER = (
    "date", "origin", "dest", "flight_number", "pred_dep_time", "pred_arr_time", "pred_elapsed_time", "distance", "total_delay",
    "origin_city_name", "dest_city_name",
)


def newest_responses(responses: DataFrame) -> DataFrame:
    """One stored response per airport day: the last one fetched."""
    return latest_by_key(responses, ("date", "code"), ("fetched_at", "seq"))


def weather_table(responses: DataFrame) -> DataFrame:
    """The newest values per airport day, written once for the joins at both route ends.

    Both joins then shuffle a plain scan, the shape in which the adaptive planner can
    split a hot airport day; straight after an aggregation it could not. The two
    joins also share one parse and an exact size.
    """
    needed = responses.select("date", "code", "fetched_at", "seq", DOCUMENT if is_stored(responses) else TEXT)
    return stage(weather_values(newest_responses(needed)), "weather")


def weather_values(responses: DataFrame) -> DataFrame:
    """14 typed columns per airport day: the fields of stored documents, or of texts, each parsed once."""
    if is_stored(responses):
        return responses.selectExpr("date", "code", *stored_values(DOCUMENT))
    parsed = responses.select("date", "code", parse_daily(F.col("payload")).alias("daily"))
    return parsed.selectExpr("date", "code", *daily_values("daily"))


def at_end(weather: DataFrame, end: str, date: str, code: str) -> DataFrame:
    """Weather columns prefixed and keyed for one route end."""
    return weather.selectExpr(
        f"date AS {date}", f"code AS {code}", *[f"{field} AS {end}_{field}" for field in WEATHER_FIELDS]
    )


def join_weather(flights: DataFrame, weather: DataFrame, date: str = "flight_date") -> DataFrame:
    """Left-join the same weather table at origin and destination.

    Weather has one row per (date, code), so rows never multiply. There is no
    broadcast hint: the adaptive planner broadcasts weather when its measured size
    allows and otherwise splits the flights of a hot airport day over several tasks.
    """
    return (
        flights
        .join(at_end(weather, "origin", date, "origin"), [date, "origin"], "left")
        .join(at_end(weather, "dest", date, "dest"), [date, "dest"], "left")
    )


def dataset_rows(flights: DataFrame, weather: DataFrame) -> DataFrame:
    """Flights with weather columns, in dataset column order, not yet numbered."""
    renamed = flights.withColumnsRenamed(DATASET_NAMES)
    joined = join_weather(renamed, weather)
    ends = [f"{end}_{field}" for end in ("origin", "dest") for field in WEATHER_FIELDS]
    return joined.select(*renamed.columns, *ends)


def model_dataset(flights: DataFrame, responses: DataFrame, order_by: tuple[str, ...] = NATURAL_ORDER, **options) -> DataFrame:
    """The numbered 44-column dataset from clean flights and stored responses.

    The narrow flights are numbered, in the order of their own columns; the joins keep one row per flight.
    """
    numbered = dense_id(flights, order_by, **options)
    rows = dataset_rows(numbered, weather_table(responses))
    return rows.select("id", *[name for name in rows.columns if name != "id"])


def first_rows(dataset: DataFrame, cap: int) -> DataFrame:
    """Row cap by id, so the same rows are taken every time."""
    return dataset.where(F.col("id") <= cap)


def complete_rows(dataset: DataFrame) -> DataFrame:
    """Rows without a NULL or NaN in any column."""
    return dataset.dropna("any")


def with_label(dataset: DataFrame) -> DataFrame:
    return dataset.withColumn("significant", significant_delay(F.col("delay")))


def known_target(dataset: DataFrame) -> DataFrame:
    """Features and label of the rows whose delay is known, NULL features included."""
    return with_label(dataset.where(F.col("delay").isNotNull())).select(*MODEL_FEATURES, "delay", "significant")


def training_rows(dataset: DataFrame, cap: int | None = None) -> DataFrame:
    """Capped, complete, labelled rows: the cap comes before incomplete rows are dropped."""
    capped = dataset if cap is None else first_rows(dataset, cap)
    return with_label(complete_rows(capped)).select("id", *MODEL_FEATURES, "significant")


def scoring_features(rows: DataFrame) -> DataFrame:
    """Model types: reals for durations and distances, dates and codes as text categories."""
    return rows.withColumns({
        "pred_elapsed_time": F.col("pred_elapsed_time").cast("double"),
        "fl_distance": F.col("fl_distance").cast("double"),
        **{name: F.col(name).cast("string") for name in CATEGORICAL_FEATURES},
    })
