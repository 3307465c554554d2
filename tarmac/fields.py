"""Column lists and constants shared by every stage."""

from __future__ import annotations

# The daily weather fields, in provider order.
WEATHER_FIELDS = (
    "weather_code",
    "temperature_2m_max",
    "temperature_2m_min",
    "apparent_temperature_max",
    "apparent_temperature_min",
    "precipitation_sum",
    "rain_sum",
    "showers_sum",
    "snowfall_sum",
    "cloud_cover_mean",
    "wind_speed_10m_max",
    "wind_gusts_10m_max",
    "wind_direction_10m_dominant",
    "pressure_msl_mean",
)

# Schedule and route features, in model order.
SCHEDULE_FEATURES = (
    "year",
    "month",
    "day_of_month",
    "day_of_week",
    "pred_dep_time",
    "pred_arr_time",
    "pred_elapsed_time",
    "fl_distance",
)

# Categories, in model order.
CATEGORICAL_FEATURES = ("flight_date", "origin", "dest")

# Thresholds and policies.
SIGNIFICANT_DELAY_MINUTES = 25
MATCH_TOLERANCE_MINUTES = 30
MINUTES_PER_DAY = 1440
EARTH_RADIUS_MILES = 3958.7613
SECRET_PARAMETERS = ("access_key", "apikey")


def weather_columns(end: str) -> list[str]:
    """The 14 weather feature names of one route end (``origin`` or ``dest``)."""
    return [f"{end}_{field}" for field in WEATHER_FIELDS]


NUMERIC_FEATURES = [*SCHEDULE_FEATURES, *weather_columns("origin"), *weather_columns("dest")]
MODEL_FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
