"""Table contracts: schema families, required columns, keys and value ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.fields import weather_columns

# The Spark types each contract family accepts.
FAMILIES: dict[str, tuple[type[T.DataType], ...]] = {
    "text": (T.StringType,),
    "whole": (T.LongType, T.IntegerType, T.ShortType, T.ByteType),
    "real": (T.DoubleType, T.FloatType, T.DecimalType),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
}


class SchemaMismatch(ValueError):
    """A table's columns do not match its contract."""


class ContractBroken(ValueError):
    """A table's rows break its contract."""


@dataclass(frozen=True)
class Contract:
    """Ordered columns with type families, columns that may not be NULL, and the key."""

    name: str
    columns: tuple[tuple[str, str], ...]
    required: tuple[str, ...] = ()
    key: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.columns]


# The five tables of the pipeline.
FLIGHTS = Contract(
    "flight_data",
    (
        ("date", "date"), ("year", "whole"), ("month", "whole"), ("day_of_month", "whole"),
        ("day_of_week", "whole"), ("flight_number", "real"), ("origin", "text"),
        ("origin_city_name", "text"), ("dest", "text"), ("dest_city_name", "text"),
        ("pred_dep_time", "whole"), ("pred_arr_time", "whole"), ("pred_elapsed_time", "real"),
        ("distance", "real"), ("total_delay", "real"),
    ),
    required=("date", "flight_number", "origin", "dest"),
)
AIRPORTS = Contract(
    "airport_data",
    (("name", "text"), ("lat", "real"), ("long", "real"), ("code", "text")),
    required=("name", "lat", "long", "code"),
)
WEATHER_REQUESTS = Contract(
    "weather_req_table",
    (
        ("date", "date"), ("code", "text"), ("name", "text"), ("lat", "real"), ("long", "real"),
        ("status", "text"), ("attempt_count", "whole"), ("last_error", "text"),
        ("updated_at", "timestamp"),
    ),
    required=("date", "code", "name", "lat", "long"),
)
WEATHER_RAW = Contract(
    "weather_response_raw",
    (
        ("code", "text"), ("date", "date"), ("api_url", "text"), ("fetched_at", "timestamp"),
        ("payload", "text"),
    ),
    required=("code", "date", "api_url", "fetched_at"),
    key=("code", "date"),
)
MODEL_DATASET = Contract(
    "model_dataset",
    (
        ("id", "whole"), ("flight_date", "date"), ("year", "whole"), ("month", "whole"),
        ("day_of_month", "whole"), ("day_of_week", "whole"), ("flight_num", "real"),
        ("origin", "text"), ("origin_city_name", "text"), ("dest", "text"),
        ("dest_city_name", "text"), ("pred_dep_time", "whole"), ("pred_arr_time", "whole"),
        ("pred_elapsed_time", "real"), ("fl_distance", "real"), ("delay", "real"),
        *((name, "real") for name in weather_columns("origin")),
        *((name, "real") for name in weather_columns("dest")),
    ),
)


def check_schema(df: DataFrame, contract: Contract) -> DataFrame:
    """Count, then order and names, then type families; the first difference raises."""
    actual = df.schema.fields
    if len(actual) != len(contract.columns):
        raise SchemaMismatch(
            f"{contract.name} has {len(actual)} columns, expected {len(contract.columns)}"
        )
    for field, (name, family) in zip(actual, contract.columns):
        if field.name != name:
            raise SchemaMismatch(f"{contract.name}: expected column {name}, found {field.name}")
        if not isinstance(field.dataType, FAMILIES[family]):
            raise SchemaMismatch(
                f"{contract.name}.{name} is {field.dataType.simpleString()}, expected {family}"
            )
    return df


def _any_null(columns: tuple[str, ...]) -> Column:
    broken = F.lit(False)
    for name in columns:
        broken = broken | F.col(name).isNull()
    return broken


def row_counts(contract: Contract) -> list[Column]:
    """The aggregates behind a contract: all rows, rows with any required NULL, NULLs per column."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_any_null(contract.required)).alias("rows_with_nulls"),
        *[F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in contract.required],
    ]


def row_faults(contract: Contract, counts: dict[str, int]) -> list[str]:
    faults = []
    if counts["rows"] == 0:
        faults.append(f"{contract.name} is empty")
    if counts["rows_with_nulls"]:
        faults.append(
            f"{contract.name} has {counts['rows_with_nulls']} rows with nulls in {list(contract.required)}"
        )
    return faults


def repeated_keys(df: DataFrame, contract: Contract) -> int:
    """How many keys more than one row holds; 0 for a contract without a key."""
    return key_violations(df, contract.key).count() if contract.key else 0


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per check with the number of failing rows, from a single pass."""
    counts = check_schema(df, contract).agg(*row_counts(contract))
    checks = [("not_empty", F.when(F.col("rows") == 0, 1).otherwise(0))]
    checks.append(("required_not_null", F.col("rows_with_nulls")))
    checks += [(f"not_null_{name}", F.col(f"null_{name}")) for name in contract.required]
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), failing.cast("bigint").alias("failing_rows"))
        for name, failing in checks
    ])
    return (
        counts.select(F.col("rows").alias("total_rows"), F.inline(rows))
        .select(
            F.lit(contract.name).alias("table_name"), "check_name", "total_rows", "failing_rows",
            (F.col("failing_rows") == 0).alias("passed"),
        )
    )


def key_violations(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys held by more than one row, with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def result_violations(df: DataFrame) -> DataFrame:
    """Scored rows outside the result contract, with the field that broke it."""
    probability = F.col("significant_delay_probability")
    fault = (
        F.when(F.col("is_significant_delay").isNull(), "is_significant_delay")
        .when(probability.isNotNull() & ~probability.between(0, 1), "significant_delay_probability")
        .when(~F.coalesce(F.col("fl_distance") >= 0, F.lit(False)), "fl_distance")
    )
    return df.withColumn("broken_field", fault).where(F.col("broken_field").isNotNull())
