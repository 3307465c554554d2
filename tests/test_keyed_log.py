from __future__ import annotations

import re

from pyspark.sql import functions as F

from tarmac.operators import state
from tarmac.plans import ingest
from tarmac.sources.keyed_log import KeyedLog
from tests.test_state import LOG, NOW, QUICK, answer, entry, keyed, opened, statuses, warehouse  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log_of(warehouse, buckets=8):  # noqa: F811
    schema = state.open_log(warehouse.table("weather_req_table")).schema
    return KeyedLog(warehouse, "a_log", schema, state.KEY, ("seq", "updated_at"), buckets=buckets)


def test_state_equals_the_newest_rows_at_every_step(spark, warehouse):  # noqa: F811
    log, seen = log_of(warehouse), []
    steps = [[entry(1, "A", "pending"), entry(2, "B", "pending")], [entry(1, "A", "in_progress", 1, seq=1), entry(3, "C", "pending")],
             [entry(1, "A", "pending", 0, seq=0)], [entry(2, "B", "failed", 1, "x", seq=2), entry(2, "B", "failed", 1, "x", seq=2)]]
    for compacting, rows in enumerate(steps):
        log.append(spark.createDataFrame(rows, LOG))
        seen += rows
        expected = keyed(state.current_state(spark.createDataFrame(seen, LOG)))
        assert keyed(log.state()) == expected
        if compacting % 2 == 0:
            log.compact()
            assert keyed(log.state()) == expected and log.state().count() == len(expected)
    assert log.rows().count() == len(seen)
    keys = spark.createDataFrame([entry(2, "B", "pending"), entry(9, "Q", "pending")], LOG)
    assert keyed(log.state(keys)) == {(2, "B"): ("failed", 1, "x", 2)}
    assert log.state(keys.limit(0)).count() == 0


def test_an_empty_log_and_another_number_of_buckets(spark, warehouse):  # noqa: F811
    log = log_of(warehouse)
    assert log.state().count() == 0
    log.compact()
    log.append(spark.createDataFrame([entry(1, "A", "pending")], LOG))
    wider = log_of(warehouse, 16)
    wider.compact()
    assert keyed(wider.state()) == {(1, "A"): ("pending", 0, None, 0)}
    assert "16 out of 16" in plan(wider.state())


def test_rows_of_a_writer_that_began_before_the_snapshot_are_seen(spark, warehouse):  # noqa: F811
    log = log_of(warehouse)
    log.append(spark.createDataFrame([entry(1, "A", "pending")], LOG))
    log.compact()
    late = spark.createDataFrame([entry(1, "A", "done", 1, seq=2)], LOG).withColumn("month", F.lit("2024-01"))
    warehouse.append("a_log/gen=0", late, partition_by=("month",))
    assert keyed(log.state()) == {(1, "A"): ("done", 1, None, 2)}
    log.compact()
    log.compact()
    assert keyed(log.state()) == {(1, "A"): ("done", 1, None, 2)}


def test_a_compaction_that_breaks_off_loses_nothing(spark, warehouse):  # noqa: F811
    log = log_of(warehouse)
    log.append(spark.createDataFrame([entry(1, "A", "pending")], LOG))
    log.compact()
    log.append(spark.createDataFrame([entry(1, "A", "in_progress", 1, seq=1)], LOG))
    log._record(log.generation() + 1, None)
    log.append(spark.createDataFrame([entry(1, "A", "done", 1, seq=2)], LOG))
    assert keyed(log.state()) == {(1, "A"): ("done", 1, None, 2)}
    log.compact()
    assert keyed(log.state()) == {(1, "A"): ("done", 1, None, 2)}


def test_the_snapshot_is_never_shuffled(spark, warehouse):  # noqa: F811
    log = log_of(warehouse)
    log.append(spark.createDataFrame([entry(day, "A", "pending") for day in range(1, 20)], LOG))
    log.compact()
    log.append(spark.createDataFrame([entry(3, "A", "done", seq=1)], LOG))
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(log.state())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    join = text.index("SortMergeJoin")
    old, tail = text[join:].split("+- Sort", 1)[0], text[join:].split("Bucketed: true", 1)
    assert len(tail) == 2 and "Exchange" not in tail[0] and "SelectedBucketsCount: 8 out of 8" in text and old
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # both of the tail


def test_a_run_lists_and_reads_only_what_follows_the_snapshot(spark, warehouse):  # noqa: F811
    opened(warehouse)
    for batch in range(3):
        ingest.backfill(warehouse, "https://w.example", answer, QUICK, batch_size=2)
        ingest.compact_state(warehouse)
    files = ingest.request_state(warehouse).inputFiles()
    generations = {int(part) for path in files for part in re.findall(r"gen=(\d+)", path)}
    assert generations <= {2, 3} and any("_snapshot" in path for path in files)
    assert statuses(warehouse) == {"done": 4, "failed": 2}
    assert keyed(ingest.request_state(warehouse)) == keyed(state.current_state(ingest.request_log(warehouse)))
    assert ingest.compact_responses(warehouse).count() == 4


def test_compaction_follows_the_number_of_files(spark, warehouse):  # noqa: F811
    log = log_of(warehouse)
    for step in range(3):
        log.append(spark.createDataFrame([entry(1, "A", "pending", seq=step)], LOG).coalesce(1))
    assert not log.compact_if_due(3) and log.compact_if_due(2) and not log.compact_if_due(2)
