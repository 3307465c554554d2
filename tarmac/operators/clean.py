"""Cleaning of flights and airports, and the enrichment requests they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.sources.csv import AIRPORT_COLUMNS, FLIGHT_COLUMNS, require_columns

# The five causes of a delay.
DELAY_CAUSES = ("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")


def whole(name: str, kind: str) -> Column:
    """Whole number from text or a real, rounded half to even like the source engine's cast."""
    return F.bround(F.col(name).cast("double"), 0).cast(kind)


def total_delay() -> Column:
    """Sum of the five causes; unknown as soon as one cause is unknown."""
    return sum((F.col(cause).cast("double") for cause in DELAY_CAUSES[1:]), F.col(DELAY_CAUSES[0]).cast("double"))


def clean_flights(raw: DataFrame) -> DataFrame:
    """Typed, renamed flights; rows without a complete flight key are dropped."""
    require_columns(raw, FLIGHT_COLUMNS, "flights source")
    # plain IS NOT NULL tests, which a Parquet source can skip row groups by
    keyed = raw.where("fl_date IS NOT NULL AND op_carrier_fl_num IS NOT NULL AND origin IS NOT NULL AND dest IS NOT NULL")
    return keyed.select(
        F.col("fl_date").cast("date").alias("date"),
        *[whole(part, "int").alias(part) for part in ("year", "month", "day_of_month", "day_of_week")],
        F.col("op_carrier_fl_num").cast("double").alias("flight_number"),
        *[F.col(name).cast("string").alias(name)
          for name in ("origin", "origin_city_name", "dest", "dest_city_name")],
        whole("crs_dep_time", "bigint").alias("pred_dep_time"),
        whole("crs_arr_time", "bigint").alias("pred_arr_time"),
        F.col("crs_elapsed_time").cast("double").alias("pred_elapsed_time"),
        F.col("distance").cast("double").alias("distance"),
        total_delay().alias("total_delay"),
    )


def clean_airports(raw: DataFrame) -> DataFrame:
    """The four airport columns in use, for rows that have a code."""
    require_columns(raw, AIRPORT_COLUMNS, "airports source")
    return raw.where("iata_code IS NOT NULL").select(
        F.col("name").cast("string").alias("name"),
        F.col("latitude_deg").cast("double").alias("lat"),
        F.col("longitude_deg").cast("double").alias("long"),
        F.col("iata_code").cast("string").alias("code"),
    )


def airport_days(flights: DataFrame) -> DataFrame:
    """Distinct (date, code) over both route ends, from one scan.

    ``distinct`` aggregates inside each task first, so a hub that holds a large
    share of the flights reaches the shuffle as one row per task and day.
    """
    ends = F.explode(F.array("origin", "dest")).alias("code")
    return flights.select("date", ends).distinct()


def enrichment_requests(flights: DataFrame, airports: DataFrame, now: Column | None = None) -> DataFrame:
    """A pending request per airport day; codes without an airport vanish."""
    return airport_days(flights).join(airports, "code").select(
        "date", "code", "name", "lat", "long",
        F.lit("pending").alias("status"),
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"),
        (F.current_timestamp() if now is None else now).alias("updated_at"),
    )


def one_per_code(airports: DataFrame) -> DataFrame:
    """A single airport row per code, for lookups that take one match."""
    first = F.min(F.struct("name", "lat", "long")).alias("airport")
    return airports.groupBy("code").agg(first).select("code", "airport.*")
