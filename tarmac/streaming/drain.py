"""Backfill as an incremental job over arriving request files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarmac.operators import state
from tarmac.operators.enrich import Attempt, Reply, RetryPolicy
from tarmac.plans.ingest import answer, append_log, request_state
from tarmac.sources.scratch import stage
from tarmac.sources.warehouse import Warehouse


def drain_arrivals(
    warehouse: Warehouse,
    arrivals: str,
    checkpoint: str,
    base_url: str,
    fetch: Callable[[str, Attempt], Reply],
    policy: RetryPolicy = RetryPolicy(),
    partitions: int | None = None,
    threads: int = 10,
    files_per_batch: int = 1000,
    lease: str = "1 minute",
) -> StreamingQuery:
    """Answer request files that arrived since the last run, then stop.

    The checkpoint remembers which files were handled. Arrivals meet the state that the log has for their keys, of which only
    the months are read: new keys are opened, pending ones go on from their state, and those done, failed or claimed by
    someone else stay as they are. A claim that a broken run left behind returns to the queue after the lease, by a later
    arrival or a backfill.
    """
    columns = warehouse.table("weather_req_table").schema
    opened = state.open_log(warehouse.spark.createDataFrame([], columns)).schema

    def handle(batch: DataFrame, _: int) -> None:
        now = F.current_timestamp()
        arrived = stage(state.open_log(batch.select(*columns.names)), "arrivals")
        known = stage(request_state(warehouse, arrived).select(*opened.names), "known-arrivals")
        stale = stage(state.requeue_stale(known, now, lease).select(*opened.names), "requeued")
        append_log(warehouse, stale)
        fresh = arrived.join(known.select(*state.KEY), list(state.KEY), "left_anti").select(*opened.names)
        waiting = known.where("status = 'pending'").unionByName(stale).unionByName(fresh)
        claimed = stage(state.claim_batch(waiting, now).select(*opened.names), "claimed")
        answer(warehouse, claimed, base_url, fetch, policy, partitions, threads)

    incoming = (
        warehouse.spark.readStream.schema(columns)
        .option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    )
    return (
        incoming.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


