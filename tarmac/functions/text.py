"""Codes, request URLs, redaction and nested text lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.fields import SECRET_PARAMETERS, WEATHER_FIELDS


def airport_code(text: Column) -> Column:
    """Code as typed by a person, trimmed and upper-cased."""
    return F.upper(F.trim(text))


def redact_url(url: Column) -> Column:
    """Replace every secret parameter value, up to the next ``&``."""
    return F.regexp_replace(url, f"({'|'.join(SECRET_PARAMETERS)})[^&]*", "$1=REDACTED")


def redact_map(pairs: Column) -> Column:
    """Replace the values of secret keys in a header or parameter map."""
    return F.transform_values(
        pairs, lambda key, value: F.when(key.isin(*SECRET_PARAMETERS), F.lit("REDACTED")).otherwise(value)
    )


def query_string(parameters: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string"))) for name, value in parameters.items()]
    return F.concat_ws("&", *parts)


def weather_url(base_url: str, lat: Column, long: Column, date: Column) -> Column:
    """Request address for one airport day.

    Secrets never enter a column: the fetch function adds its key when it calls.
    """
    day = F.date_format(date, "yyyy-MM-dd")
    parameters = {
        "latitude": lat,
        "longitude": long,
        "start_date": day,
        "end_date": day,
        "daily": F.lit(",".join(WEATHER_FIELDS)),
        "timezone": F.lit("auto"),
    }
    return F.concat(F.lit(f"{base_url}?"), query_string(parameters))


def schedule_url(base_url: str, date: Column, dep_code: Column) -> Column:
    """Request address for one departure airport's schedule on a day."""
    parameters = {
        "type": F.lit("departure"),
        "date": F.date_format(date, "yyyy-MM-dd"),
        "iataCode": dep_code,
    }
    return F.concat(F.lit(f"{base_url}?"), query_string(parameters))


def nested_text(document: Column, parent: str, child: str) -> Column:
    """Text at ``parent.child`` of a VARIANT; empty when absent or not a string."""
    path = f"$.{parent}.{child}"
    found = F.try_variant_get(document, path, "variant")
    is_text = F.schema_of_variant(found) == "STRING"
    return F.when(is_text, F.try_variant_get(document, path, "string")).otherwise("")
