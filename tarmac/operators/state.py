"""Request state kept as an append-only log and reduced to the newest row per key.

Parquet has no UPDATE. Each transition appends rows whose ``seq`` is one above
the state they came from; the current state is the highest ``seq`` per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.hot_keys import lookup_join

KEY = ("date", "code")


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` per key.

    ``max_by`` reduces inside each task before the shuffle, so a key with very
    many versions never gathers in one task the way a ranking window would.
    """
    rest = [name for name in df.columns if name not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return df.groupBy(*key).agg(newest).select(*key, *[F.col(f"newest.{name}").alias(name) for name in rest])


def current_state(log: DataFrame) -> DataFrame:
    return latest_by_key(log, KEY, ("seq", "updated_at"))


def open_log(requests: DataFrame) -> DataFrame:
    """First log rows for new requests, one per key: the smallest of rows that repeat it."""
    rest = [name for name in requests.columns if name not in KEY]
    first = requests.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("first"))
    return first.select(*KEY, *(F.col(f"first.{name}").alias(name) for name in rest)).select(
        *requests.columns, F.lit(0).cast("bigint").alias("seq"))


def _transition(rows: DataFrame, status: str, now: Column, **changes: Column) -> DataFrame:
    return rows.withColumns({
        "status": F.lit(status), "updated_at": now, "seq": F.col("seq") + 1, **changes,
    })


def claim_batch(state: DataFrame, now: Column, batch_size: int | None = None) -> DataFrame:
    """Log rows that move pending requests to ``in_progress``, oldest first.

    A batch size asks for that many by (date, code) as one distributed top-n.
    Without one every pending request is claimed and no sort happens: the
    partitions of the next stage are the batches.
    """
    pending = state.where(F.col("status") == "pending")
    if batch_size is not None:
        pending = pending.orderBy("date", "code").limit(batch_size)
    return _transition(
        pending, "in_progress", now,
        attempt_count=F.coalesce(F.col("attempt_count"), F.lit(0)) + 1,
    )


def requeue_stale(state: DataFrame, now: Column, lease: str = "1 minute") -> DataFrame:
    """Log rows that return requests claimed longer than the lease ago to ``pending``."""
    stale = (F.col("status") == "in_progress") & (F.col("updated_at") < now - F.expr(f"INTERVAL {lease}"))
    return _transition(state.where(stale), "pending", now)


def mark(rows: DataFrame, status: str, now: Column, error: Column | None = None) -> DataFrame:
    """Log rows with a final status; success clears the last error."""
    return _transition(rows, status, now, last_error=F.lit(None).cast("string") if error is None else error)


def outstanding(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without a stored response.

    Keys are made distinct first: a key with very many versions then crosses the
    shuffle once per task.
    """
    return requests.join(responses.select(*KEY).distinct(), list(KEY), "left_anti")


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with a stored response."""
    return requests.join(responses.select(*KEY).distinct(), list(KEY), "left_semi")


def with_membership(df: DataFrame, code: str, known: DataFrame, flag: str, heavy: DataFrame | None = None) -> DataFrame:
    """Add a boolean column: does the code occur in ``known``? Codes that very many rows share are spread over tasks."""
    marked = known.select(F.col("code").alias(code)).distinct().withColumn(flag, F.lit(True))
    return lookup_join(df, marked, code, heavy=heavy).withColumn(flag, F.coalesce(flag, F.lit(False)))


def run_stats(outcomes: DataFrame) -> DataFrame:
    """Counts of one enrichment run; ``fetched`` includes failed fetches.

    Every claimed request is queued for a lookup. Outcomes are stored as a whole, so a write that fails ends the run and
    none of its rows counts as written.
    """
    ok = F.col("ok")
    return outcomes.agg(
        F.count(F.lit(1)).alias("queued"),
        F.count(F.lit(1)).alias("claimed"),
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(ok).alias("written"),
        F.count_if(~ok).alias("failed_fetch"),
        F.lit(0).cast("bigint").alias("failed_write"),
    )
