"""Validation of scoring requests and presentation of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.fields import SIGNIFICANT_DELAY_MINUTES

DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
TIME_TEXT = r"^\d{2}:\d{2}$"

# The fields a request may carry.
REQUEST_FIELDS = ("date", "scheduledDepartureTime", "depIataCode", "destIataCode")


def request_errors(date: Column, time: Column, dep: Column, dest: Column) -> Column:
    """Array of the field names that fail validation, in request order; empty when valid."""
    bad_date = ~F.coalesce(date.rlike(DATE_TEXT) & date.try_cast("date").isNotNull(), F.lit(False))
    bad_time = ~F.coalesce(
        time.rlike(TIME_TEXT) & (F.substring(time, 1, 2) <= "23") & (F.substring(time, 4, 2) <= "59"),
        F.lit(False),
    )
    bad_dep = F.coalesce(F.length(dep), F.lit(0)) != 3
    bad_dest = F.coalesce(F.length(dest), F.lit(0)) != 3
    flags = zip((bad_date, bad_time, bad_dep, bad_dest), REQUEST_FIELDS)
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for bad, name in flags]), lambda name: name.isNotNull())


def unknown_fields(document: Column) -> Column:
    """Names in a JSON request that the contract does not allow."""
    return F.array_except(
        F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")),
        F.array(*[F.lit(name) for name in REQUEST_FIELDS]),
    )


def significant_delay(delay: Column) -> Column:
    """1 for a significant delay, 0 otherwise, NULL when the delay is unknown."""
    return (delay >= SIGNIFICANT_DELAY_MINUTES).cast("int")


def risk_label(significant: Column) -> Column:
    return F.when(significant.isNull(), "--").when(significant, "Significant").otherwise("Low")


def percent_text(probability: Column) -> Column:
    """Whole percent, halves rounded up; ``--`` when there is no probability."""
    whole = F.floor(probability * 100 + 0.5).cast("string")
    return F.coalesce(F.concat(whole, F.lit("%")), F.lit("--"))


def miles_text(miles: Column) -> Column:
    return F.coalesce(F.concat(miles.cast("bigint").cast("string"), F.lit(" mi")), F.lit("--"))
