from __future__ import annotations

from tarmac.checks import analytics

SF = "/root/testdata/sf0.001"


def test_every_stage_of_the_outcomes_is_compiled(spark):
    """Without the fallback a stage whose code grows beyond 64 KB, and would be interpreted row by row, is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert len(analytics.request_features(spark, SF).collect()) > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
