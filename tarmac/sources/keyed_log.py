"""Append-only logs whose newest rows are kept in a bucketed snapshot.

A log lies in generations, and each snapshot names the generation it opened. Its rows are hashed into buckets by key and sorted inside
them, so that the newest rows of the log's tail are brought to the buckets and joined there: the snapshot itself is never
shuffled, and a read costs the state and the tail, however many runs wrote before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.state import latest_by_key
from tarmac.sources.warehouse import Warehouse

SNAPSHOTS = "generation bigint, path string, buckets int, columns string, at timestamp"


class KeyedLog:
    """A log table ``name`` with a key and an order; rows that come later in the order replace those before.

    ``day`` is the date column of the key. The log lies in folders by its month, and the buckets are sorted by it.
    """

    def __init__(self, warehouse: Warehouse, name: str, schema: T.StructType, key: Sequence[str], order: Sequence[str],
                 day: str = "date", buckets: int = 32):
        self.warehouse, self.spark = warehouse, warehouse.spark
        self.path = f"{warehouse.root}/{name}"
        self.name, self.schema, self.key, self.order, self.day, self.buckets = name, schema, list(key), list(order), day, buckets

    def _records(self) -> list:
        try:
            return self.spark.read.schema(SNAPSHOTS).parquet(f"{self.path}/_snapshots").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _record(self, generation: int, path: str | None) -> None:
        self.spark.range(1).select(
            F.lit(generation).cast("bigint").alias("generation"), F.lit(path).cast("string").alias("path"),
            F.lit(self.buckets).alias("buckets"), F.lit(self.schema.json()).alias("columns"), F.current_timestamp().alias("at"),
        ).write.mode("append").parquet(f"{self.path}/_snapshots")

    def generation(self) -> int:
        return max((row.generation for row in self._records()), default=0)

    def append(self, rows: DataFrame) -> None:
        """Add rows; repeating an append adds versions that change nothing."""
        month = F.date_format(self.day, "yyyy-MM").alias("month")
        self.warehouse.append(f"{self.name}/gen={self.generation()}", rows.select(*self.schema.names, month), partition_by=("month",))

    def _in_months(self, rows: DataFrame, keys: DataFrame | None) -> DataFrame:
        if keys is None:
            return rows
        # A thousand years have 12,000 months.
        months = [row.month for row in keys.select(F.date_format(self.day, "yyyy-MM").alias("month")).distinct().collect()]
        return rows.where(F.col("month").isin(months))

    def _of(self, rows: DataFrame, keys: DataFrame | None) -> DataFrame:
        return rows if keys is None else rows.join(keys.select(*self.key).distinct(), self.key, "left_semi")

    def _logged(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("month", T.StringType())])

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """Every row ever appended, or those of some keys, of which only the months are read."""
        return self._of(self._in_months(self.warehouse.log(self.name, self._logged()), keys), keys).select(*self.schema.names)

    def _tail(self, start: int, stop: int, keys: DataFrame | None) -> DataFrame:
        """Newest rows of the generations ``start`` to ``stop``; older folders are not even listed."""
        found = self.spark.createDataFrame([], self._logged())
        for generation in range(max(0, start), stop + 1):
            found = found.unionByName(self.warehouse.log(f"{self.name}/gen={generation}", self._logged()))
        return latest_by_key(self._of(self._in_months(found, keys), keys).select(*self.schema.names), self.key, self.order)

    def _newest(self):
        return max((row for row in self._records() if row.path), key=lambda row: row.generation, default=None)

    def snapshot(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The newest snapshot as a bucketed scan; with keys only files and row groups with days of their span are read."""
        newest = self._newest()
        if newest is None:
            return None
        schema = T.StructType.fromJson(json.loads(newest.columns))
        table = self._register(newest.path, schema, newest.buckets)
        if keys is not None:
            span = keys.agg(F.min(self.day).alias("low"), F.max(self.day).alias("high")).collect()[0]
            table = table.where(F.lit(False) if span.low is None else F.col(self.day).between(span.low, span.high))
        return table.select(*self.schema.names)

    def _table_name(self, path: str) -> str:
        return f"tarmac_{self.name}_{path.rsplit('/', 1)[1]}"

    def _register(self, path: str, schema: T.StructType, buckets: int) -> DataFrame:
        """The files of a snapshot under a name of this session, which is how Spark learns that they are bucketed."""
        name = self._table_name(path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
            keys = ", ".join(f"`{part}`" for part in self.key)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                           f"INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def state(self, keys: DataFrame | None = None) -> DataFrame:
        """The newest row of every key, or of some keys."""
        records = self._records()
        last = max((row.generation for row in records), default=0)
        covered = max((row.generation for row in records if row.path), default=0)
        return self._merged(covered, last, keys)

    def _merged(self, covered: int, last: int, keys: DataFrame | None = None) -> DataFrame:
        # A writer that began before the snapshot may still have added to the generation before it, so that one is read again.
        tail = self._tail(covered - 1, last, keys)
        kept = self.snapshot(keys)
        if kept is None:
            return tail
        # Left to itself the planner would shuffle the snapshot too where more shuffle partitions than buckets are set.
        tail = tail.repartition(self._newest().buckets, *self.key)
        old = kept.select(*(F.col(name).alias(f"old_{name}") for name in self.schema.names))
        met = old.join(tail, [F.col(f"old_{part}") == F.col(part) for part in self.key], "full_outer")
        newer = F.col(f"old_{self.key[0]}").isNull() | (
            F.struct(*self.order) > F.struct(*(F.col(f"old_{name}").alias(name) for name in self.order)))
        merged = met.select(*(F.when(F.coalesce(newer, F.lit(False)), F.col(name)).otherwise(F.col(f"old_{name}")).alias(name) for name in self.schema.names))
        return self._of(merged, keys)

    def compact(self) -> None:
        """Write a new snapshot of everything appended so far.

        New appends go to a fresh generation first. A compaction that breaks off leaves that generation and no snapshot; readers then go
        on from the snapshot before. One compaction of a log runs at a time.
        """
        records = self._records()
        last = max((row.generation for row in records), default=0)
        covered = max((row.generation for row in records if row.path), default=0)
        self._record(last + 1, None)
        path = f"{self.path}/_snapshot/{uuid.uuid4().hex}"
        # Merged rows already lie by bucket; those of a first snapshot, or of another number of buckets, are dealt out here.
        merged, before = self._merged(covered, last), self._newest()
        placed = merged if before is not None and before.buckets == self.buckets else merged.repartition(self.buckets, *self.key)
        placed.write.bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", path).saveAsTable(self._table_name(path))
        self._record(last + 1, path)

    def compact_if_due(self, files: int = 200) -> bool:
        """Compact once the tail has more than this many files, so that runs pay for their own rows and not for the log's age."""
        records = self._records()
        last = max((row.generation for row in records), default=0)
        covered = max((row.generation for row in records if row.path), default=0)
        own = sum(len(self.warehouse.log(f"{self.name}/gen={generation}", self._logged()).inputFiles()) for generation in range(covered, last + 1))
        if own <= files:
            return False
        self.compact()
        return True
