from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarmac.operators import contracts, state
from tarmac.operators.enrich import Reply, RetryPolicy, TransportError, as_document, call, enrich
from tarmac.plans import ingest
from tarmac.sources.warehouse import Warehouse
from tarmac.streaming.drain import drain_arrivals
from tests import fixtures

NOW = datetime(2024, 3, 1, 12, 0)
LOG = (
    "date date, code string, name string, lat double, long double, status string, attempt_count int, "
    "last_error string, updated_at timestamp, seq bigint"
)


def entry(day, code, status, attempts=0, error=None, age=0, seq=0):
    return (date(2024, 1, day), code, code, 1.0, 2.0, status, attempts, error, NOW - timedelta(seconds=age), seq)


def keyed(df):
    return {(r.date.day, r.code): (r.status, r.attempt_count, r.last_error, r.seq) for r in df.collect()}


def test_claim_takes_the_oldest_pending(spark):
    log = spark.createDataFrame([
        entry(2, "B", "pending"), entry(2, "A", "pending", None), entry(1, "Z", "pending", 3, "old"),
        entry(1, "A", "done"), entry(1, "B", "failed"),
    ], LOG)
    claimed = state.claim_batch(log, F.lit(NOW), 2)
    assert keyed(claimed) == {(1, "Z"): ("in_progress", 4, "old", 1), (2, "A"): ("in_progress", 1, None, 1)}
    assert set(keyed(state.claim_batch(log, F.lit(NOW)))) == {(1, "Z"), (2, "A"), (2, "B")}


def test_requeue_only_stale_claims_and_keep_the_error(spark):
    log = spark.createDataFrame([
        entry(1, "A", "in_progress", 1, "why", age=61), entry(1, "B", "in_progress", age=59), entry(1, "C", "pending", age=99),
    ], LOG)
    assert keyed(state.requeue_stale(log, F.lit(NOW))) == {(1, "A"): ("pending", 1, "why", 1)}


def test_current_state_conserves_keys(spark):
    log = spark.createDataFrame([
        entry(1, "A", "pending"), entry(1, "A", "in_progress", 1, seq=1), entry(1, "B", "pending"),
        entry(1, "A", "failed", 1, "x", seq=2),
    ], LOG)
    assert keyed(state.current_state(log)) == {(1, "A"): ("failed", 1, "x", 2), (1, "B"): ("pending", 0, None, 0)}
    failed = state.current_state(log).where("status = 'failed'")
    assert keyed(state.mark(failed, "done", F.lit(NOW))) == {(1, "A"): ("done", 1, None, 3)}


def test_outstanding_and_answered(spark):
    requests = spark.createDataFrame([entry(1, code, "pending") for code in "ABC"], LOG)
    stored = spark.createDataFrame([(date(2024, 1, 1), "A")] * 5 + [(date(2024, 1, 2), "B")], "date date, code string")
    assert {r.code for r in state.outstanding(requests, stored).collect()} == {"B", "C"}
    assert [r.code for r in state.answered(requests, stored).collect()] == ["A"]
    flagged = state.with_membership(requests, "code", stored, "known")
    assert {r.code: r.known for r in flagged.collect()} == {"A": True, "B": True, "C": False}
    assert flagged.count() == 3


@pytest.mark.parametrize("replies, expected, waits", [
    ([(200, "{}")], (True, "{}", 200, None, 1), []),
    ([(503, "busy"), (200, "[1]")], (True, '{"data": [1]}', 200, None, 2), [3.0]),
    ([(500, "a"), (502, "b"), (504, "c")], (False, None, 504, "c", 3), [3.0, 6.0]),
    ([(404, "gone")], (False, None, 404, "gone", 1), []),
    ([None, None, None], (False, None, 408, "reset", 3), [3.0, 6.0]),
    ([None, (429, "slow"), (200, "text")], (True, '{"content": "text"}', 200, None, 3), [3.0, 6.0]),
])
def test_retry_policy(replies, expected, waits):
    pending, slept = list(replies), []

    def fetch(url, attempt):
        assert attempt.timeout_seconds == 25.0 and attempt.number == len(replies) - len(pending)
        reply = pending.pop(0)
        if reply is None:
            raise TransportError("reset")
        return Reply(*reply)

    assert call(fetch, "u", RetryPolicy(sleep=slept.append)) == expected
    assert slept == waits and not pending


def test_as_document():
    assert as_document('{"a": 1}') == '{"a": 1}'
    assert as_document("5") == '{"data": 5}'
    assert as_document("<html>") == '{"content": "<html>"}'


def answer(url, attempt):
    day = int(url.split("start_date=")[1][8:10])
    return Reply(500, "down") if day == 2 else Reply(200, fixtures.weather_document(float(day)))


QUICK = RetryPolicy(sleep=lambda seconds: None)


@pytest.fixture
def warehouse(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    requests = spark.createDataFrame(
        [entry(day, code, "pending") for day in (1, 2, 3) for code in "AB"], LOG
    ).drop("seq")
    warehouse.publish("weather_req_table", requests, contracts.WEATHER_REQUESTS)
    return warehouse


def opened(warehouse):
    ingest.append_log(warehouse, state.open_log(warehouse.table("weather_req_table")))
    return warehouse


def statuses(warehouse):
    rows = state.current_state(ingest.request_log(warehouse)).groupBy("status").count().collect()
    return {r["status"]: r["count"] for r in rows}


def test_enrich_keeps_one_row_per_request(spark, warehouse):
    outcomes = enrich(warehouse.table("weather_req_table"), "https://w.example?apikey=SECRET", answer, QUICK, partitions=2)
    rows = outcomes.collect()
    assert len(rows) == 6 and sum(r.ok for r in rows) == 4
    assert all("SECRET" not in r.api_url for r in rows)
    assert {r.attempts for r in rows if not r.ok} == {3}


def test_backfill_in_batches_and_again(spark, warehouse):
    opened(warehouse)
    first = ingest.backfill(warehouse, "https://w.example", answer, QUICK, batch_size=4).collect()[0]
    assert (first.claimed, first.fetched, first.written, first.failed_fetch) == (4, 4, 2, 2)
    assert statuses(warehouse) == {"done": 2, "failed": 2, "pending": 2}
    total = ingest.drain(warehouse, "https://w.example", answer, policy=QUICK, batch_size=1).collect()[0]
    assert (total.claimed, total.written) == (2, 2)
    assert statuses(warehouse) == {"done": 4, "failed": 2}
    raw = ingest.compact_responses(warehouse)
    assert contracts.key_violations(raw, contracts.WEATHER_RAW.key).count() == 0
    assert raw.count() == 4


def test_crashed_claim_is_requeued_and_upsert_is_idempotent(spark, warehouse):
    opened(warehouse)
    current = state.current_state(ingest.request_log(warehouse))
    ingest.append_log(warehouse, state.claim_batch(current, F.lit(NOW), 3))
    assert statuses(warehouse) == {"in_progress": 3, "pending": 3}
    ingest.backfill(warehouse, "https://w.example", answer, QUICK)
    assert statuses(warehouse) == {"done": 4, "failed": 2}
    before = {(r.date, r.code, r.payload) for r in ingest.compact_responses(warehouse).collect()}
    stored = ingest.responses(warehouse)
    ingest.append_responses(warehouse, stored)
    assert {(r.date, r.code, r.payload) for r in ingest.compact_responses(warehouse).collect()} == before


def test_stream_answers_each_arrival_once(spark, warehouse, tmp_path):
    arrivals, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    table = warehouse.table("weather_req_table")
    for share in ("day(date) = 1", "day(date) <= 3"):
        table.where(share).write.mode("append").parquet(arrivals)
        drain_arrivals(warehouse, arrivals, checkpoint, "https://w.example", answer, QUICK).awaitTermination()
    assert statuses(warehouse) == {"done": 4, "failed": 2}
    assert ingest.responses(warehouse).count() == 4


@pytest.mark.parametrize("failure, text, attempts", [
    (ConnectionResetError("gone"), "gone", 3), (TimeoutError(), "TimeoutError", 3), (OSError("no route"), "no route", 3),
    (KeyError("daily"), "KeyError: 'daily'", 1),
])
def test_errors_of_the_fetch_function_become_failed_rows(failure, text, attempts):
    def fetch(url, attempt):
        raise failure

    ok, payload, status, error, made = call(fetch, "u", QUICK)
    assert (ok, payload, error, made) == (False, None, text, attempts)
    assert status == (408 if attempts == 3 else None)


def test_lookups_spread_over_the_named_number_of_tasks(spark):
    requests = spark.range(20_000).selectExpr(
        "DATE'2024-01-01' AS date", "CAST(id AS STRING) AS code", "1.0D AS lat", "2.0D AS long")
    outcomes = enrich(requests, "https://w.example", lambda url, attempt: Reply(200, "{}"), QUICK, partitions=40)
    sizes = [row["count"] for row in outcomes.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 3 * 20_000 / 40


def test_log_reads_are_pruned_to_the_months_of_the_keys(spark, warehouse):
    opened(warehouse)
    keys = warehouse.table("weather_req_table").where("day(date) = 1")
    rows = ingest.request_log(warehouse, keys)
    assert "PartitionFilters: [isnotnull(month" in rows._jdf.queryExecution().toString()
    assert rows.count() == 2


def test_stream_continues_the_state_of_known_keys(spark, warehouse, tmp_path):
    opened(warehouse)
    table, now = warehouse.table("weather_req_table"), F.current_timestamp()
    current = state.current_state(ingest.request_log(warehouse))
    ingest.append_log(warehouse, state.claim_batch(current, F.lit(NOW)))
    claimed = state.current_state(ingest.request_log(warehouse))
    ingest.append_log(warehouse, state.requeue_stale(claimed, now))
    table.write.parquet(str(tmp_path / "in"))
    drain_arrivals(warehouse, str(tmp_path / "in"), str(tmp_path / "cp"), "https://w.example", answer, QUICK).awaitTermination()
    rows = state.current_state(ingest.request_log(warehouse)).collect()
    assert {row.seq for row in rows} == {4} and {row.attempt_count for row in rows} == {2}
    assert statuses(warehouse) == {"done": 4, "failed": 2}
