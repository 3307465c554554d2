from __future__ import annotations

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.operators import state
from tarmac.operators.enrich import Attempt, Reply, RetryPolicy, call, decide, enrich, retry_decision, rules, within
from tarmac.plans import ingest
from tarmac.plans.counters import RunCounters, counted
from tarmac.sources.portions import Portions, UnknownStore
from tarmac.sources.scratch import stage
from tarmac.sources.warehouse import Warehouse
from tests.test_state import LOG, NOW, QUICK, answer, entry, opened, statuses, warehouse  # noqa: F401

BASE = "https://w.example?apikey=SECRET"


def requests(spark, n):
    return spark.range(n).selectExpr("date_add(DATE'2024-01-01', CAST(id AS INT)) AS date", "CAST(id % 7 AS STRING) AS code", "1.0D AS lat", "2.0D AS long")


def test_a_fetch_that_hangs_is_given_up():
    slept, begun = [], time.monotonic()
    policy = RetryPolicy(attempts=2, timeout_seconds=0.3, sleep=slept.append)
    outcome = call(lambda url, attempt: time.sleep(60), "u", policy)
    assert time.monotonic() - begun < 5
    assert outcome == (False, None, 408, "no response within 0.3 s", 2) and slept == [3.0]


def test_a_fetch_that_hangs_once_is_asked_again():
    def fetch(url, attempt):
        if attempt.number == 0:
            time.sleep(60)
        return Reply(200, "{}")

    assert call(fetch, "u", RetryPolicy(timeout_seconds=0.3, sleep=lambda s: None)) == (True, "{}", 200, None, 2)


def test_within_hands_on_results_and_errors():
    assert within(5, lambda: Reply(200, "a")) == Reply(200, "a")
    with pytest.raises(KeyError):
        within(5, lambda: {}["a"])


def test_hanging_lookups_become_rows_with_408(spark):
    def fetch(url: str, attempt: Attempt) -> Reply:
        if "2024-01-03" in url:
            time.sleep(60)
        return Reply(200, "{}")

    rows = enrich(requests(spark, 6), BASE, fetch, RetryPolicy(attempts=1, timeout_seconds=0.5), partitions=2).collect()
    assert Counter((row.ok, row.status_code) for row in rows) == {(True, 200): 5, (False, 408): 1}


def test_loop_and_column_follow_one_table(spark):
    policy = RetryPolicy(attempts=2, retryable=(418, 503))
    statuses_ = [None, 199, 200, 250, 299, 300, 404, 418, 500, 503]
    frame = spark.createDataFrame([(s, a) for s in statuses_ for a in range(3)], "status int, attempt int")
    found = frame.withColumn("decision", retry_decision(F.col("status"), F.col("attempt"), policy)).collect()
    assert all(row.decision == decide(row.status, row.attempt, policy) for row in found)
    assert [rule[:2] for rule in rules(policy)] == [(200, 299), (418, 418), (503, 503)]


@pytest.mark.parametrize("killed_at", [90, 199])
def test_a_task_killed_half_way_repeats_under_a_tenth(spark, tmp_path, killed_at):
    calls, folder = tmp_path / "calls", str(tmp_path / "portions")

    def fetch(url: str, attempt: Attempt) -> Reply:
        with open(calls, "a") as log:
            log.write(url + "\n")
        if not (tmp_path / "again").exists() and len(calls.read_text().splitlines()) > killed_at:
            os._exit(1)  # as an executor that is lost
        return Reply(200, "{}")

    asked = requests(spark, 200)
    with pytest.raises(Exception):
        enrich(asked, BASE, fetch, QUICK, partitions=1, threads=4, portions=folder, portion=10).collect()
    (tmp_path / "again").touch()
    rows = enrich(asked, BASE, fetch, QUICK, partitions=1, threads=4, portions=folder, portion=10).collect()
    assert len({(row.date, row.code) for row in rows}) == len(rows) == 200 and all(row.ok and row.attempts == 1 for row in rows)
    assert all(row.api_url and "SECRET" not in row.api_url for row in rows)
    made = calls.read_text().splitlines()
    assert len(set(made)) == 200 and len(made) - 200 < 20
    stored = b"".join(path.read_bytes() for path in (tmp_path / "portions").rglob("*.parquet"))
    assert stored and b"SECRET" not in stored


def test_portions_of_unknown_stores_are_refused_at_once(spark):
    with pytest.raises(UnknownStore, match="viewfs"):
        enrich(requests(spark, 1), BASE, answer, QUICK, portions="viewfs://x/y")


def test_unfinished_files_are_not_read(tmp_path):
    kept = Portions(f"file:{tmp_path}", 3)
    assert kept.read() is None
    (tmp_path / "part-000003").mkdir()
    (tmp_path / "part-000003" / "x.part").write_bytes(b"half")
    assert kept.read() is None


def test_metrics_are_taken_as_rows_are_written(spark):
    frame, counts = counted(spark.range(100), lambda rows: stage(rows, "counted"), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert counts == {"n": 100, "odd": 50} and frame.count() == 100
    assert counted(spark.range(0), lambda rows: stage(rows, "counted"), n=F.count(F.lit(1)))[1] == {"n": 0}
    assert RunCounters(1, 2) + RunCounters(queued=1, failed_write=5) == RunCounters(2, 2, failed_write=5)


class NoSpace(Warehouse):
    def append(self, name, df, partition_by=()):
        if name.startswith(ingest.RESPONSES):
            raise OSError("no space left")
        super().append(name, df, partition_by)


def test_responses_that_cannot_be_stored_are_counted_and_fail_their_requests(spark, warehouse):  # noqa: F811
    opened(warehouse)
    row = ingest.backfill(NoSpace(spark, warehouse.root), "https://w.example", answer, QUICK, batch_size=4).collect()[0]
    assert row.asDict() == {"queued": 6, "claimed": 4, "fetched": 4, "written": 0, "failed_fetch": 2, "failed_write": 2}
    assert statuses(warehouse) == {"failed": 4, "pending": 2}
    errors = Counter(r.last_error for r in state.current_state(ingest.request_log(warehouse)).where("status = 'failed'").collect())
    assert errors == {"down": 2, "response was not stored: OSError": 2}
    assert ingest.responses(warehouse).count() == 0
