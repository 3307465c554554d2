"""Daily weather documents: lenient features for training, strict ones for scoring.

The repeated per-field expressions are SQL text, which builds a plan far faster
than thousands of single Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.fields import WEATHER_FIELDS

DAILY_SCHEMA = "daily struct<" + ",".join(f"`{field}`:array<string>" for field in WEATHER_FIELDS) + ">"


def parse_daily(payload: Column) -> Column:
    """Struct of the 14 daily arrays; anything missing or malformed becomes NULL."""
    return F.from_json(payload, DAILY_SCHEMA)["daily"]


def daily_values(daily: str) -> list[str]:
    """SQL for the first element of each array of a ``parse_daily`` column, as DOUBLE."""
    return [f"try_cast(get({daily}.{field}, 0) AS DOUBLE) AS {field}" for field in WEATHER_FIELDS]


def stored_values(document: str) -> list[str]:
    """SQL for the same values of a VARIANT column, read by path."""
    return [f"try_cast(try_variant_get({document}, '$.daily.{field}[0]', 'string') AS DOUBLE) AS {field}" for field in WEATHER_FIELDS]


def first_elements(document: str) -> list[str]:
    """SQL for the first element of each daily array of a VARIANT column, as VARIANT."""
    return [f"try_variant_get({document}, '$.daily.{field}[0]', 'variant') AS {field}" for field in WEATHER_FIELDS]


def _is_number(value: str) -> str:
    kind = f"schema_of_variant({value})"
    return f"coalesce({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR startswith({kind}, 'DECIMAL'), false)"


def strict_fault(document: str) -> str:
    """SQL for why a weather VARIANT cannot be scored, NULL when it can.

    Reads the columns of ``first_elements``. The text has an ``{end}`` slot for the
    route end. The first failing field in field order is reported, and only the
    first element of each array counts.
    """
    daily = f"schema_of_variant(try_variant_get({document}, '$.daily', 'variant'))"
    # The three fault texts.
    cases = [f"WHEN NOT coalesce(startswith({daily}, 'OBJECT'), false) THEN '{{end}} weather daily payload was invalid.'"]
    for field in WEATHER_FIELDS:
        cases.append(f"WHEN {field} IS NULL THEN \"{{end}} weather field '{field}' was missing or invalid.\"")
        cases.append(f"WHEN NOT {_is_number(field)} THEN \"{{end}} weather field '{field}' value was invalid.\"")
    return f"CASE {' '.join(cases)} END AS fault"


def strict_values() -> list[str]:
    """SQL for the ``first_elements`` that are JSON numbers, as DOUBLE, else NULL."""
    return [
        f"CASE WHEN {_is_number(field)} THEN try_variant_get({field}, '$', 'double') END AS {field}"
        for field in WEATHER_FIELDS
    ]
