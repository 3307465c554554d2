"""Flight and airport CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns each file must have.
FLIGHT_COLUMNS = (
    "fl_date", "year", "month", "day_of_month", "day_of_week", "op_carrier_fl_num",
    "origin", "origin_city_name", "dest", "dest_city_name",
    "crs_dep_time", "crs_arr_time", "crs_elapsed_time", "distance",
    "carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay",
)
AIRPORT_COLUMNS = ("name", "latitude_deg", "longitude_deg", "iata_code")
MALFORMED = "_line"


class MissingColumns(ValueError):
    """A source lacks columns that its cleaning step reads."""


class MalformedLines(ValueError):
    """A source has lines whose number of fields differs from its header's."""


def require_names(present: Sequence[str], columns: tuple[str, ...], source: str) -> None:
    names = {name.lower() for name in present}
    absent = [name for name in columns if name not in names]
    if absent:
        raise MissingColumns(f"{source} lacks {absent}")


def require_columns(df: DataFrame, columns: tuple[str, ...], source: str) -> DataFrame:
    require_names(df.columns, columns, source)
    return df.select(*columns)


def scan_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All-text scan with the raw text of malformed lines in ``_line``, NULL for good ones.

    The header names come from the first file; ``enforceSchema`` off makes Spark check every further file's header against
    them instead of trusting positions. All columns are read, since a line's length shows only then.
    """
    options = {"header": True, "quote": '"', "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    require_names(header, columns, path)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*header, MALFORMED)])
    return spark.read.options(
        **options, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, columnPruning=False
    ).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The wanted columns of the well-formed lines; empty text, quoted or not, is NULL."""
    rows = scan_csv(spark, path, columns).where(F.col(MALFORMED).isNull())
    return rows.select(*[F.nullif(F.col(name), F.lit("")).alias(name) for name in columns])


def malformed_lines(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Lines with too few or too many fields, which ``read_csv`` leaves out: file and raw text."""
    rows = scan_csv(spark, path, columns).withColumn("file", F.col("_metadata.file_name"))
    # Spark refuses a scan of nothing but the raw text; any hash is at least the smallest number, so this keeps all rows.
    read = F.xxhash64(*columns) >= F.lit(-(2**63))
    return rows.where(read & F.col(MALFORMED).isNotNull()).select("file", F.col(MALFORMED).alias("line"))


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FLIGHT_COLUMNS)


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, AIRPORT_COLUMNS)
