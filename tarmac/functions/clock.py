"""Clock text, calendar parts and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.fields import MATCH_TOLERANCE_MINUTES, MINUTES_PER_DAY

HOUR = r"(2[0-3]|[01]\d|\d)"
MINUTE = r"([0-5]\d|\d)"
SHORT_CLOCK = rf"^{HOUR}:{MINUTE}$"
# hour and minute are groups 1 and 2 with a colon, 3 and 4 as bare digits, 6 and 7 or 8 (without
# and with a colon) after an ISO date, which is group 5; separators are used throughout or not at all
ANY_CLOCK = (
    rf"^{HOUR}:{MINUTE}(?::(?:[0-5]\d|\d))?$"
    rf"|^{HOUR}{MINUTE}$"
    r"|^(\d{4}-\d{2}-\d{2}|\d{8})"
    r"(?:.([01]\d|2[0-3])(?:([0-5]\d)(?:[0-5]\d(?:[.,]\d+)?)?|:([0-5]\d)(?::[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?:[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?|:[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)?)?)?$"
)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight, NULL when the text is no known clock format.

    Known are ``H:M`` and ``H:M:S``, digits ``HM``, and ISO dates with or without a
    time (its own wall clock; any offset is ignored). One substitution turns all of
    them into "date hour minute", which no trimmed clock text equals itself.
    """
    clean = stripped(text)
    parts = F.regexp_replace(clean, ANY_CLOCK, "$5 $1$3$6 $2$4$7$8")
    date, hour, minute = (F.split_part(parts, F.lit(" "), F.lit(place)) for place in (1, 2, 3))
    dashed = F.when(F.length(date) != 8, date).otherwise(
        F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))
    )
    known = (parts != clean) & ((date == "") | dashed.try_cast("date").isNotNull())
    return F.when(known, F.coalesce(hour.try_cast("int"), F.lit(0)) * 60 + F.coalesce(minute.try_cast("int"), F.lit(0)))


def short_clock_minutes(text: Column) -> Column:
    """Minutes since midnight for plain ``H:M`` text only, without trimming."""
    hour = F.regexp_extract(text, SHORT_CLOCK, 1).try_cast("int")
    minute = F.regexp_extract(text, SHORT_CLOCK, 2).try_cast("int")
    return hour * 60 + minute


def clock_text(minutes: Column) -> Column:
    hour = F.lpad(F.floor(minutes / 60).cast("string"), 2, "0")
    return F.concat(hour, F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def normalize_clock(text: Column) -> Column:
    """``HH:MM`` for recognised clock text, otherwise the trimmed text itself."""
    return F.coalesce(clock_text(clock_minutes(text)), stripped(text))


def clock_distance(a: Column, b: Column) -> Column:
    """Shortest way round the clock between two minute-of-day values."""
    straight = F.abs(a - b)
    return F.least(straight, F.lit(MINUTES_PER_DAY) - straight)


def clocks_match(a: Column, b: Column, tolerance: int = MATCH_TOLERANCE_MINUTES) -> Column:
    """Whether two clock texts lie within the tolerance; unparsable text never matches."""
    return F.coalesce(clock_distance(clock_minutes(a), clock_minutes(b)) <= tolerance, F.lit(False))


def hhmm(minutes: Column) -> Column:
    """Minute of day as an HHMM integer (09:05 -> 905)."""
    return (F.floor(minutes / 60) * 100 + minutes % 60).cast("bigint")


def elapsed_minutes(dep: Column, arr: Column) -> Column:
    """Arrival minus departure on the clock, rolled over midnight when negative."""
    return F.pmod(arr - dep, F.lit(MINUTES_PER_DAY))


def calendar_parts(date: Column) -> dict[str, Column]:
    """Year, month, day and ISO weekday (Monday is 1) of a date."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day_of_month": F.dayofmonth(date),
        "day_of_week": F.weekday(date) + 1,
    }
