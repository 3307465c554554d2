"""Physical plans that must hold at any size."""

from __future__ import annotations

import re

import pytest

from tarmac.checks import analytics, ingest
from tarmac.checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
LAZY = sorted(set(QUERIES) - {
    "rf_scores", "run_log", "search_results", "batch_score", "backfill", "drain_arrivals_stream", "published_flights",
    "flights_csv_scan", "airports_csv_scan", "enrich_fake", "run_stats",
})


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_global_window_over_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # only windows over per-class or per-range summaries may lack a partition
    if name not in ("class_distribution", "class_weights", "score_auc"):
        assert "Window" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(ingest.flights_clean(spark, SF))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", text)
    text = plan(analytics.calendar_parts(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_shipdate:timestamp_ntz>" in text


def test_key_filter_reaches_a_parquet_scan(spark, tmp_path):
    from tarmac.checks import views
    from tarmac.operators.clean import clean_flights

    path = str(tmp_path / "raw")
    views.raw_flights(spark, SF).write.parquet(path)
    text = plan(clean_flights(spark.read.parquet(path)))
    assert "PushedFilters: [IsNotNull(fl_date), IsNotNull(op_carrier_fl_num), IsNotNull(origin), IsNotNull(dest)]" in text


def test_split_adds_no_shuffle(spark):
    assert "Exchange" not in plan(analytics.split_assign(spark, SF))
