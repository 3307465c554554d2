from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tarmac.operators import contracts, state
from tarmac.plans import ingest
from tarmac.sources.warehouse import Warehouse
from tarmac.streaming import leases
from tests.test_state import LOG, NOW, QUICK, answer, entry, keyed, opened, statuses, warehouse  # noqa: F401

ONCE = {"availableNow": True}


@pytest.fixture
def empty(spark, tmp_path):
    found = Warehouse(spark, str(tmp_path / "wh"))
    found.publish("weather_req_table", spark.createDataFrame([entry(1, "A", "pending")], LOG).drop("seq"), contracts.WEATHER_REQUESTS)
    return found


def watched(spark, warehouse, tmp_path, rows, **more):
    ingest.append_log(warehouse, spark.createDataFrame(rows, LOG))
    leases.watch_leases(warehouse, str(tmp_path / "cp"), 60, "event", trigger=ONCE, **more).awaitTermination()
    return keyed(ingest.request_state(warehouse))


def test_only_leases_that_ran_out_return_and_once(spark, empty, tmp_path):
    rows = [entry(1, "A", "in_progress", 1, "why", age=600, seq=1), entry(1, "B", "in_progress", 2, age=600, seq=1), entry(1, "B", "done", 2, age=590, seq=2),
            entry(2, "A", "in_progress", 1, age=30, seq=1), entry(3, "B", "pending", age=0)]
    first = watched(spark, empty, tmp_path, rows)
    assert first == {(1, "A"): ("pending", 1, "why", 2), (1, "B"): ("done", 2, None, 2), (2, "A"): ("in_progress", 1, None, 1), (3, "B"): ("pending", 0, None, 0)}
    # The stream goes on from its checkpoint: its own row comes back and changes nothing, the next lease ends, one that was answered does not.
    more = [entry(3, "B", "in_progress", 1, age=-10, seq=1), entry(3, "B", "failed", 1, "no", age=-20, seq=2), entry(4, "B", "pending", age=-300)]
    second = watched(spark, empty, tmp_path, more)
    assert second == {**first, (2, "A"): ("pending", 1, None, 2), (3, "B"): ("failed", 1, "no", 2), (4, "B"): ("pending", 0, None, 0)}
    assert ingest.request_log(empty).where("seq = 2 AND code = 'A'").count() == 2


def test_returned_requests_keep_all_their_columns(spark, empty, tmp_path):
    watched(spark, empty, tmp_path, [entry(1, "A", "in_progress", None, None, age=600, seq=4), entry(3, "B", "pending")])
    row = ingest.request_state(empty).where("code = 'A'").collect()[0]
    assert (row.name, row.lat, row.long, row.attempt_count, row.last_error, row.seq) == ("A", 1.0, 2.0, None, None, 5)
    assert (NOW - row.updated_at).total_seconds() == 540


def test_a_broken_claim_is_answered_without_any_arrival(spark, warehouse, tmp_path):  # noqa: F811
    opened(warehouse)
    current = state.current_state(ingest.request_log(warehouse))
    ingest.append_log(warehouse, state.claim_batch(current, F.current_timestamp()))  # the run that claimed them is gone
    again = leases.answer_again(warehouse, "https://w.example", answer, QUICK)
    query = leases.watch_leases(warehouse, str(tmp_path / "cp"), 3, retake=again, trigger={"processingTime": "1 second"})
    limit = time.time() + 90
    while statuses(warehouse) != {"done": 4, "failed": 2} and time.time() < limit:
        assert query.exception() is None
        time.sleep(1)
    query.stop()
    assert statuses(warehouse) == {"done": 4, "failed": 2}
    assert {row.attempt_count for row in ingest.request_state(warehouse).collect()} == {2}
