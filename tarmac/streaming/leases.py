"""Leases on claimed requests, kept as timers beside keyed state in a stream over the request log.

The stream follows the log. A claim sets a timer for the end of its lease and every later row of its key takes the timer back; a timer that
goes off returns the request to the queue. A claim that a broken run left behind thus comes back by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tarmac.operators import state
from tarmac.operators.enrich import Attempt, Reply, RetryPolicy
from tarmac.plans import ingest
from tarmac.sources.scratch import stage
from tarmac.sources.warehouse import Warehouse

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETURNED = "date date, code string, seq bigint, at_us bigint, rest string"
_STATE = "seq bigint, at_us bigint, claimed boolean, rest string"


class Leases(StatefulProcessor):
    """Per key: the newest row of its log, and a timer while that row is a claim."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = tuple(self.newest.get())[:2] if self.newest.exists() else None
        best = None
        for frame in rows:
            for row in zip(frame["seq"], frame["at_us"], frame["status"], frame["rest"]):
                if (best is None or row[:2] > best[:2]) and (seen is None or row[:2] > seen):
                    best = row
        if best is None:
            return
        seq, at_us, status, rest = best
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        claimed = status == "in_progress"
        self.newest.update((int(seq), int(at_us), claimed, rest))
        if claimed:
            # Timers count in milliseconds.
            self.handle.registerTimer(-(-int(at_us) // 1000) + self.lease_ms)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, at_us, claimed, rest = tuple(self.newest.get())
        if not claimed:
            return
        over = at_us + self.lease_ms * 1000
        self.newest.update((seq + 1, over, False, rest))
        yield pd.DataFrame({"date": [key[0]], "code": [key[1]], "seq": [seq + 1], "at_us": [over], "rest": [rest]})

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state_in_rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which spills to disk; timers need it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def watch_leases(
    warehouse: Warehouse,
    checkpoint: str,
    lease_seconds: int = 60,
    clock: str = "processing",
    retake: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Follow the request log and append a ``pending`` row for every claim whose lease ran out.

    ``clock`` tells time by the machines (``processing``) or by the newest ``updated_at`` in the log (``event``), which makes replays
    repeatable. ``retake`` gets each batch of returned rows as a written table, for example to answer them at once. A
    batch that is repeated appends the same rows again, which changes no state. Keys without a date or code are not followed.
    """
    spark = warehouse.spark
    log = ingest.request_log(warehouse)
    names = log.columns
    rest = [name for name in names if name not in (*state.KEY, "seq", "status", "updated_at")]
    rest_type = log.select(*rest).schema
    ingest.append_log(warehouse, log.limit(0))  # the folder exists before it is followed
    rows = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{warehouse.root}/{ingest.LOG}")
    events = rows.where("date IS NOT NULL AND code IS NOT NULL").select(
        "date", "code", "updated_at", "seq", "status", F.unix_micros("updated_at").alias("at_us"), F.to_json(F.struct(*rest)).alias("rest"))
    if clock == "event":
        events = events.withWatermark("updated_at", "0 seconds")
    returned = events.groupBy("date", "code").transformWithStateInPandas(
        statefulProcessor=Leases(lease_seconds * 1000), outputStructType=RETURNED, outputMode="Append",
        timeMode="EventTime" if clock == "event" else "ProcessingTime")

    def handle(batch: DataFrame, _: int) -> None:
        back = stage(batch.select(
            "*", F.from_json("rest", rest_type).alias("_rest"), F.lit("pending").alias("status"), F.timestamp_micros("at_us").alias("updated_at")
        ).select("date", "code", *(F.col(f"_rest.{name}") for name in rest), "status", "updated_at", "seq").select(*names), "leases-over")
        if back.isEmpty():
            return
        ingest.append_log(warehouse, back)
        if retake is not None:
            retake(back)

    with _keyed_state_in_rocksdb(spark):
        return returned.writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"processingTime": "10 seconds"})).start()


def answer_again(warehouse: Warehouse, base_url: str, fetch: Callable[[str, Attempt], Reply], policy: RetryPolicy = RetryPolicy(),
                 partitions: int | None = None, threads: int = 10) -> Callable[[DataFrame], None]:
    """A ``retake`` for ``watch_leases`` that claims the returned requests and looks them up."""
    def retake(back: DataFrame) -> None:
        claimed = stage(state.claim_batch(back, F.current_timestamp()).select(*back.columns), "claimed")
        ingest.answer(warehouse, claimed, base_url, fetch, policy, partitions, threads)

    return retake
