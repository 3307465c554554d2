from __future__ import annotations

from pathlib import Path

import pytest

from tarmac.sources.scratch import released, scratch_path, stage


def folders(spark):
    return {path.name for path in Path(scratch_path(spark, "x")).parent.glob("*")}


def test_only_what_is_kept_outlasts_a_step(spark):
    before = stage(spark.range(3), "before")
    known = folders(spark)
    with released(spark, "outer") as keep:
        with released(spark, "inner") as keep_inner:
            first = keep_inner(stage(spark.range(5), "lost").where("id > 1"), "first")
        second = keep(first.where("id > 2"), "second")
    assert [row.id for row in second.orderBy("id").collect()] == [3, 4] and before.count() == 3
    left = folders(spark) - known
    assert len(left) == 1 and left.pop().startswith("second-")


def test_a_failing_step_leaves_nothing(spark):
    stage(spark.range(1), "some")
    known = folders(spark)
    with pytest.raises(ZeroDivisionError):
        with released(spark, "failing"):
            stage(spark.range(5), "lost")
            1 / 0
    assert folders(spark) == known
    assert stage(spark.range(2), "after").count() == 2
