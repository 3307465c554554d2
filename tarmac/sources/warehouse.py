"""Published Parquet tables under one root folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.contracts import Contract, ContractBroken, check_schema, repeated_keys, row_counts, row_faults

RECORD = (
    "name string, path string, rows bigint, columns string, parts array<struct<folder: string, rows: bigint>>, high bigint, "
    "sources array<string>, read_until timestamp"
)
PUBLISHED = f"{RECORD}, published_at timestamp"


@dataclass(frozen=True)
class Version:
    """One publication of a table.

    ``parts`` maps the folders that hold its rows, relative to the table, to their number of rows; ``high`` is the highest mark
    ever published, ``sources`` and ``read_until`` say what the version was built from.
    """

    path: str
    rows: int
    schema: T.StructType
    parts: dict[str, int]
    high: int | None = None
    sources: tuple[str, ...] = ()
    read_until: object = None


def partition_of(folder: str) -> str:
    """The partition that a part holds, as ``year=2024/month=1``; empty for tables without partitions."""
    return folder.partition("/")[2]


class Warehouse:
    """Tables that are replaced as a whole or part by part.

    Each publication writes a fresh folder and is then recorded in an append-only
    ledger, with the older folders that it keeps; readers take the newest record. A table that breaks its contract is
    never recorded, and nothing overwrites a path that a query may be reading.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.ledger_path = f"{self.root}/_published"

    def _ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(PUBLISHED).parquet(self.ledger_path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], PUBLISHED)

    def publish(
        self, name: str, df: DataFrame, contract: Contract | None = None, partition_by: Sequence[str] = (), **record
    ) -> DataFrame:
        """Write a table, check what was written and make it current.

        The check reads only the required columns of the new files. A partitioned
        table is rebalanced on its partition columns first, so that a task does not
        write a small file into every folder; the adaptive planner splits the share
        of a large folder over several tasks. ``record`` goes to ``_write``.
        """
        return self._written(name, self._write(name, df, contract, partition_by, **record))

    def extend(
        self, name: str, df: DataFrame, contract: Contract | None = None, partition_by: Sequence[str] = (),
        replaced: Sequence[str] = (), **record,
    ) -> DataFrame:
        """Publish a version that keeps the files of the current one and adds rows, in the same columns.

        The rows take the place of the ``replaced`` folders, so a partition is rebuilt by naming its folders; all other files
        stay as they are and are not read. Only the new rows are checked: keys that they share with kept rows are the caller's
        concern. Versions that readers hold stay whole, and one writer of a table works at a time.
        """
        before = self.version(name)
        if df.schema.simpleString() != before.schema.simpleString():
            raise ValueError(f"{name} has columns {before.schema.simpleString()}, the new rows {df.schema.simpleString()}")
        kept = {folder: rows for folder, rows in before.parts.items() if folder not in set(replaced)}
        return self._written(name, self._write(name, df, contract, partition_by, kept=kept, before=before, **record))

    def _write(
        self, name: str, df: DataFrame, contract: Contract | None, partition_by: Sequence[str], mark: str | None = None,
        sources: Sequence[str] = (), read_until=None, kept: dict[str, int] | None = None, before: Version | None = None,
    ) -> Version:
        """Write and check rows, then record them with the kept folders as the current version.

        ``mark`` names a column of numbers whose highest value is recorded, such as a dense id; ``sources`` and ``read_until`` are
        recorded as given.
        """
        if contract:
            check_schema(df, contract)
        version = f"_publication={uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{version}"
        placed = df.hint("rebalance", *partition_by) if partition_by else df
        placed.write.partitionBy(*partition_by).parquet(path)
        files = self.spark.read.schema(df.schema).parquet(path)
        checked = contract or Contract(name, ())
        # One row for each folder that was written, which is one for each partition.
        folders = files.groupBy(F.regexp_extract("_metadata.file_path", f"({version}.*)/[^/]+$", 1).alias("folder")).agg(
            *row_counts(checked), F.max(mark or F.lit(None).cast("bigint")).alias("high")).collect()
        names = [column for column in folders[0].asDict() if column not in ("folder", "high")] if folders else ["rows"]
        counts = {column: sum(row[column] for row in folders) for column in names}
        faults = row_faults(contract, {"rows_with_nulls": 0, **counts}) if contract else []
        if contract and (repeated := repeated_keys(files.select(*df.schema.names), contract)):
            faults.append(f"{name} has {repeated} keys {list(contract.key)} in more than one row")
        if faults:
            raise ContractBroken("; ".join(faults))
        parts = {**(kept or {}), **{unquote(row.folder): row.rows for row in folders}}
        marks = [row.high for row in folders if row.high is not None] + ([before.high] if before and before.high is not None else [])
        made = Version(path, sum(parts.values()), df.schema, parts, max(marks, default=None), tuple(sources), read_until)
        row = (name, path, made.rows, df.schema.json(), list(parts.items()), made.high, list(made.sources), made.read_until)
        record = self.spark.createDataFrame([row], RECORD).withColumn("published_at", F.current_timestamp())
        record.coalesce(1).write.mode("append").parquet(self.ledger_path)
        return made

    def _written(self, name: str, version: Version) -> DataFrame:
        return self.files(name, version).select(*version.schema.names)

    def files(self, name: str, version: Version, folders: Sequence[str] | None = None) -> DataFrame:
        """The files of a version, or those of some of its folders, before columns are chosen: ``_metadata`` can be asked for."""
        wanted = list(version.parts if folders is None else folders)
        if not wanted:
            return self.spark.createDataFrame([], version.schema)
        base = f"{self.root}/{name}"
        return self.spark.read.schema(version.schema).option("basePath", base).parquet(*(f"{base}/{folder}" for folder in wanted))

    def current(self) -> DataFrame:
        """One row per table: where its newest version lies."""
        fields = ("path", "rows", "columns", "parts", "high", "sources", "read_until")
        newest = F.max_by(F.struct(*fields), "published_at").alias("newest")
        return self._ledger().groupBy("name").agg(newest).select("name", "newest.*")

    def version(self, name: str) -> Version:
        """What is recorded of the newest version of a table."""
        found = self.current().where(F.col("name") == name).collect()
        if not found:
            raise LookupError(f"no published table {name}")
        row = found[0]
        # Records from before tables had parts name one folder.
        whole = {row.path.removeprefix(f"{self.root}/{name}/"): row.rows}
        parts = whole if row.parts is None else {part.folder: part.rows for part in row.parts}
        schema = T.StructType.fromJson(json.loads(row.columns))
        return Version(row.path, row.rows, schema, parts, row.high, tuple(row.sources or ()), row.read_until)

    def table(self, name: str) -> DataFrame:
        """The newest version with the columns it was published with, in their order."""
        return self._written(name, self.version(name))

    def table_or_empty(self, name: str, schema: str | T.StructType) -> DataFrame:
        try:
            return self.table(name)
        except LookupError:
            return self.spark.createDataFrame([], schema)

    def append(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Add rows to a log table, which keeps every version."""
        df.write.mode("append").partitionBy(*partition_by).parquet(f"{self.root}/{name}")

    def log(self, name: str, schema: T.StructType) -> DataFrame:
        """All rows of a log table, empty when nothing was appended yet."""
        path = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path).select(*schema.names)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


def describe(df: DataFrame) -> DataFrame:
    """Column names and types, in order."""
    rows = [(field.name, field.dataType.simpleString()) for field in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named table."""
    counts = [
        df.select(F.lit(1).alias("one")).agg(F.count("one").alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
