"""Enrichment of keys through an external lookup supplied by the caller."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from queue import Empty, Queue
from threading import Thread
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.text import redact_url, weather_url
from tarmac.sources.portions import Portions

OUTCOME = (
    "date date, code string, api_url string, ok boolean, payload string, "
    "status_code int, error string, attempts int"
)


# About so many lookups go to one task when the caller names no number of tasks, and so many are stored at once.
LOOKUPS_PER_TASK = 500
PORTION = 25
_STORED = pa.schema([("date", pa.date32()), ("code", pa.string()), ("ok", pa.bool_()), ("payload", pa.string()),
                     ("status_code", pa.int32()), ("error", pa.string()), ("attempts", pa.int32())])


class Attempt(NamedTuple):
    """What a fetch function is told beside the address: the attempt, from 0, and how long it may take."""

    number: int
    timeout_seconds: float


class Reply(NamedTuple):
    """What a fetch function returns for one address."""

    status: int
    text: str


class TransportError(Exception):
    """Raised by a fetch function when no response arrived."""


@dataclass(frozen=True)
class RetryPolicy:
    # Attempts, time for each, retryable statuses and backoff.
    attempts: int = 3
    timeout_seconds: float = 25.0
    retryable: tuple[int, ...] = (408, 429, 500, 502, 503, 504)
    delay_seconds: float = 3.0
    exhausted_status: int = 408
    sleep: Callable[[float], None] = field(default=time.sleep)


class Rule(NamedTuple):
    """What follows from a status in a range, before the last attempt and on it."""

    lowest: int
    highest: int
    before_last: str
    on_last: str


def rules(policy: RetryPolicy) -> list[Rule]:
    """The rules of a policy, of which the first that fits a status holds; ``decide`` and ``retry_decision`` both read them."""
    return [Rule(200, 299, "done", "done"), *(Rule(status, status, "retry", "failed") for status in policy.retryable)]


# No response at all, and a status that no rule names.
NO_RESPONSE, OTHERWISE = ("retry", "failed"), ("failed", "failed")


def decide(status: int | None, attempt: int, policy: RetryPolicy) -> str:
    """``done``, ``retry`` or ``failed`` for a status (None: no response) on a 0-based attempt."""
    found = NO_RESPONSE if status is None else next(
        (rule[2:] for rule in rules(policy) if rule.lowest <= status <= rule.highest), OTHERWISE)
    return found[attempt >= policy.attempts - 1]


def retry_decision(status: Column, attempt: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """``decide`` as a column, for statuses in a table."""
    def on(outcomes: tuple[str, str]) -> Column:
        return F.when(attempt >= policy.attempts - 1, outcomes[1]).otherwise(outcomes[0])

    decision = F.when(status.isNull(), on(NO_RESPONSE))
    for rule in rules(policy):
        decision = decision.when(status.between(rule.lowest, rule.highest), on(rule[2:]))
    return decision.otherwise(on(OTHERWISE))


def within(seconds: float, function: Callable[[], Reply]) -> Reply:
    """The function's result, or TimeoutError once the time is over.

    A call that hangs is given up, not stopped: its thread waits on in the background and ends with the worker at the latest.
    """
    result: Queue = Queue(1)

    def run() -> None:
        try:
            result.put((function(), None))
        except BaseException as error:
            result.put((None, error))

    Thread(target=run, daemon=True).start()
    try:
        reply, error = result.get(timeout=seconds)
    except Empty:
        raise TimeoutError(f"no response within {seconds:g} s") from None
    if error is not None:
        raise error
    return reply


def as_document(text: str) -> str:
    """JSON object text: other JSON is wrapped as ``data``, plain text as ``content``."""
    try:
        value = json.loads(text)
    except ValueError:
        return json.dumps({"content": text})
    return text if isinstance(value, dict) else json.dumps({"data": value})


def call(fetch: Callable[[str, Attempt], Reply], url: str, policy: RetryPolicy) -> tuple:
    """(ok, payload, status, error, attempts) of one lookup under the retry policy.

    A lost connection or a timeout counts as no response, and so does an attempt that takes longer than the policy allows,
    whatever the fetch function does about it. Any other error of the fetch function fails this lookup with its text and leaves the others alone.
    """
    for attempt in range(policy.attempts):
        status, text = None, ""
        try:
            told = Attempt(attempt, policy.timeout_seconds)
            status, text = within(policy.timeout_seconds, lambda told=told: fetch(url, told))
        except (TransportError, OSError) as failure:
            text = str(failure) or type(failure).__name__
        except Exception as failure:
            return False, None, None, f"{type(failure).__name__}: {failure}", attempt + 1
        decision = decide(status, attempt, policy)
        if decision == "done":
            return True, as_document(text), status, None, attempt + 1
        if decision == "failed":
            return False, None, policy.exhausted_status if status is None else status, text, attempt + 1
        policy.sleep(policy.delay_seconds * 2**attempt)
    raise ValueError("a retry policy needs at least one attempt")


def enrich(
    requests: DataFrame,
    base_url: str,
    fetch: Callable[[str, Attempt], Reply],
    policy: RetryPolicy = RetryPolicy(),
    partitions: int | None = None,
    threads: int = 10,
    portions: str | None = None,
    portion: int = PORTION,
) -> DataFrame:
    """Look up every request (date, code, lat, long) and return one outcome row each.

    Lookups run inside the tasks, ``threads`` at a time, one Arrow batch in memory.
    At most ``threads`` x running tasks are in flight; ``partitions`` bounds it
    further and otherwise follows the number of requests. A named number of tasks is kept as it is, while the adaptive
    planner would merge them by their few bytes. Write the result once before using it twice.

    ``portions`` names a shared folder, one for each piece of work. Every ``portion`` lookups a task stores their outcomes there, and a task
    that is repeated, or the same work run again with as many tasks, looks up only what is not stored. Without it a repeated task repeats all its lookups.
    """
    if portions:
        Portions.check(portions)
    addressed = requests.select(
        "date", "code", weather_url(base_url, F.col("lat"), F.col("long"), F.col("date")).alias("api_url")
    )
    # distinct keys, so hashing them spreads the lookups evenly
    tasks = partitions or max(1, math.ceil(requests.count() / LOOKUPS_PER_TASK))
    spread = addressed.repartition(tasks, "date", "code")

    def outcomes(batch: pd.DataFrame, pool: ThreadPoolExecutor) -> pd.DataFrame:
        replies = list(pool.map(lambda url: call(fetch, url, policy), batch["api_url"]))
        outcome = pd.DataFrame(
            replies, columns=["ok", "payload", "status_code", "error", "attempts"], index=batch.index
        ).astype({"status_code": "Int32"})
        return pd.concat([batch, outcome], axis=1)

    def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield outcomes(batch, pool)

    def stored_lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Addresses are made anew and not stored, as they hold the caller's key.
        kept = Portions(portions, TaskContext.get().partitionId())
        known = kept.read()
        known = pd.DataFrame(columns=_STORED.names) if known is None else known.drop_duplicates(["date", "code"])
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                met = batch.merge(known, "left", ["date", "code"], indicator=True)
                seen = (met.pop("_merge") == "both").to_numpy()
                if seen.any():
                    yield met[seen].astype({"status_code": "Int32", "ok": "bool", "attempts": "int32"})
                fresh = batch[~seen]
                for start in range(0, len(fresh), portion):
                    found = outcomes(fresh[start:start + portion], pool)
                    kept.write(found[_STORED.names], _STORED)
                    yield found

    return spread.mapInPandas(stored_lookup if portions else lookup, OUTCOME).withColumn("api_url", redact_url(F.col("api_url")))
