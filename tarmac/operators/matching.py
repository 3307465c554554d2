"""Matching of requested flights to provider schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.fields import MATCH_TOLERANCE_MINUTES, MINUTES_PER_DAY
from tarmac.functions.clock import clock_distance, clock_minutes
from tarmac.functions.text import nested_text
from tarmac.operators.settle import settled
from tarmac.sources.documents import document
from tarmac.sources.scratch import stage

ROUTE = ("date", "dep_code", "dest_code")


def schedule_documents(responses: DataFrame) -> DataFrame:
    """Responses (date, dep_code, page, status_code, and payload or a stored document) with the provider's outcome.

    ``outcome`` is ``listed`` for a non-empty list of flights, ``malformed`` for
    any other non-empty data, ``absent`` otherwise.
    """
    parsed = responses.withColumn("document", document(responses))
    data = F.try_variant_get("document", "$.data", "variant")
    kind = F.schema_of_variant(data)
    # describing a whole document is slow, so it is left to those without a first flight
    empty = (
        F.when(kind.startswith("ARRAY") | (kind == "VOID"), F.lit(True))
        .when(kind.startswith("OBJECT"), kind == "OBJECT<>")
        .otherwise(F.try_variant_get(data, "$", "string").isin("", "0", "0.0", "false"))
    )
    outcome = (
        F.when(F.coalesce(F.col("status_code") != 200, F.lit(True)), "absent")
        .when(F.try_variant_get("document", "$.data[0]", "variant").isNotNull(), "listed")
        .when(F.coalesce(empty, F.lit(True)), "absent")
        .otherwise("malformed")
    )
    return parsed.withColumn("outcome", outcome)


def schedule_rows(documents: DataFrame) -> DataFrame:
    """One row per listed flight in provider order; elements that are no objects are skipped."""
    # arrays only, so no filter on the outcome has to parse each document again
    elements = F.when(F.col("status_code") == 200, F.try_variant_get("document", "$.data", "array<variant>"))
    flights = documents.select("date", "page", F.posexplode(elements).alias("item", "flight"))
    flights = flights.where(F.schema_of_variant("flight").startswith("OBJECT"))
    texts = flights.select("date", "page", "item", *[
        nested_text(F.col("flight"), parent, child).alias(name)
        for name, parent, child in (
            ("dep_code", "departure", "iataCode"),
            ("dest_code", "arrival", "iataCode"),
            ("dep_clock", "departure", "scheduledTime"),
            ("arr_clock", "arrival", "scheduledTime"),
        )
    ])
    return settled(texts.withColumns({
        "dep_code": F.upper("dep_code"), "dest_code": F.upper("dest_code"),
        "offered_minutes": clock_minutes(F.col("dep_clock")),
    }))


def schedule_status(documents: DataFrame) -> DataFrame:
    """Per (date, departure airport): does any page list flights, and if not, why."""
    listed, malformed = F.col("outcome") == "listed", F.col("outcome") == "malformed"
    summary = documents.groupBy("date", "dep_code").agg(
        F.bool_or(listed).alias("listed"),
        F.bool_or(malformed).alias("malformed"),
        F.max(F.when(F.col("status_code") != 200, F.col("status_code"))).alias("error_code"),
    )
    message = (
        F.when(F.col("listed"), F.lit(None))
        .when(F.col("malformed"), "malformed").otherwise("absent")
    )
    return summary.select("date", "dep_code", message.alias("schedule_fault"), "error_code")


def match_schedule(
    requests: DataFrame, schedule: DataFrame, tolerance: int = MATCH_TOLERANCE_MINUTES
) -> DataFrame:
    """Add the first scheduled flight, in provider order, near each requested departure.

    ``schedule`` comes from ``schedule_rows``; ``requests`` needs (date, dep_code,
    dest_code, dep_minutes). Every request is kept and ``matched`` is NULL where
    nothing fits. The result is exact however popular a route is, because both
    sides shrink before they meet:

    * per route and departure minute only the first flight can win, and requests
      that ask for the same route and minute share one answer, so a route-day has
      at most 1440 rows on either side;
    * rows meet by a clock slot as wide as the tolerance and its two neighbours,
      so no route-day is paired all against all;
    * the winner is a ``min``, which also reduces before its shuffle.

    The answers are written once, so that the last join shuffles a plain scan and
    the adaptive planner can split the requests of a hot route.
    """
    slots = max(MINUTES_PER_DAY // max(tolerance, 1), 1)
    width = MINUTES_PER_DAY / slots

    offered = (
        schedule.where(F.col("offered_minutes").isNotNull())
        .groupBy(*ROUTE, "offered_minutes")
        .agg(F.min(F.struct("page", "item", "dep_clock", "arr_clock")).alias("flight"))
        .withColumn("slot", F.floor(F.col("offered_minutes") / width).cast("int"))
    )
    asked = requests.select(*ROUTE, "dep_minutes").where(F.col("dep_minutes").isNotNull()).distinct()
    own = F.floor(F.col("dep_minutes") / width).cast("int")
    near = F.array_distinct(F.array(*[F.pmod(own + step, F.lit(slots)) for step in (-1, 0, 1)]))
    answers = (
        asked.withColumn("slot", F.explode(near))
        .join(offered, [*ROUTE, "slot"])
        .where(clock_distance(F.col("offered_minutes"), F.col("dep_minutes")) <= tolerance)
        .groupBy(*ROUTE, "dep_minutes")
        .agg(F.min("flight").alias("matched"))
    )
    return requests.join(stage(answers, "answers"), [*ROUTE, "dep_minutes"], "left")
