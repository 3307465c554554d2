from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.operators import metrics, profile, split
from tarmac.plans.training import baseline_scores


def frame(n=400):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "flat": 2024.0})
    table["b"] = table.a * 2 + rng.normal(size=n)
    table["significant"] = (table.b > 0.8).astype(int)
    return table


def test_class_distribution_and_weights(spark):
    rows = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "significant int")
    assert [tuple(r) for r in profile.class_distribution(rows).collect()] == [
        (0, "not_significant", 6, 0.75), (1, "significant", 2, 0.25)
    ]
    assert {r.significant: r.weight for r in profile.class_weights(rows).collect()} == {0: 8 / 12, 1: 2.0}


def test_missing_by_target_matches_pandas(spark):
    table = frame()
    table["a"] = table.a.where(table.a > -0.5)
    table["b"] = table.b.where(table.significant == 1)
    rows = spark.createDataFrame(table).withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("a", "b")})
    found = {r.feature: (r.not_significant, r.significant) for r in profile.missing_by_target(rows, ["a", "b", "flat"]).collect()}
    expected = table.groupby("significant")[["a", "b", "flat"]].apply(lambda g: g.isna().mean()).T
    assert found == {name: pytest.approx((row[0], row[1])) for name, row in expected.iterrows()}


def test_correlation_matches_pandas_and_drops_constants(spark):
    table = frame()
    found = profile.target_correlation(spark.createDataFrame(table), ["a", "b", "flat"]).collect()
    expected = table[["a", "b", "significant"]].corr()["significant"]
    assert [r.feature for r in found] == sorted(["a", "b"], key=lambda name: abs(expected[name]))
    for row in found:
        assert row.correlation == pytest.approx(expected[row.feature])


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("limit, seed", [(20_000, 1), (3, 1), (1, 9)])
def test_split_is_exact_per_class(spark, monkeypatch, limit, seed):
    """Any refinement depth gives the rows a full sort by hash would give."""
    monkeypatch.setattr(split, "FETCH_LIMIT", limit)
    labels = {i: int(i % 7 == 0) for i in range(5003)}
    rows = spark.createDataFrame(list(labels.items()), "id int, significant int")
    parted = split.train_test(rows, 0.2, seed=seed).collect()
    assert len(parted) == len(labels)
    for value in (0, 1):
        keys = sorted((k for k, v in labels.items() if v == value), key=lambda k: digest(seed, k))
        assert {r.id for r in parted if r.significant == value and r.is_test} == set(keys[: round(0.2 * len(keys))])


@pytest.mark.parametrize("margin, size", [(0.0, 8), (0.02, 8), (0.005, 4096)])
def test_brackets_that_miss_are_opened_and_three_passes_do_otherwise(spark, monkeypatch, margin, size):
    monkeypatch.setattr(split, "MARGIN", margin)
    monkeypatch.setattr(split, "SKETCH_SIZE", size)
    passes, count = [], split._histograms
    monkeypatch.setattr(split, "_histograms", lambda *given: passes.append(1) or count(*given))
    rows = spark.range(20_000).select("id", (F.col("id") % 9 == 0).cast("int").alias("significant"))
    parted = split.stratified_parts(rows, [0.1, 0.25, 0.3]).collect()
    for value in (0, 1):
        keys = sorted((r.id for r in parted if r.significant == value), key=lambda k: digest(1, k))
        cuts = [0, *(round(end * len(keys)) for end in (0.1, 0.35, 0.65)), len(keys)]
        for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
            assert {r.id for r in parted if r.significant == value and r.part == part} == set(keys[low:high])
    assert size < 4096 or len(passes) == 1  # between the sketch and the fetch


def test_rows_without_a_label_stay_in_the_last_part(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, 1).alias("significant"))
    parts = Counter((r.significant, r.part) for r in split.stratified_parts(rows, [0.5]).collect())
    assert parts == {(1, 0): 25, (1, 1): 25, (None, 1): 50}


def test_folds_cover_every_row_once(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("significant"))
    counts = Counter((r.significant, r.fold) for r in split.folds(rows, 3).collect())
    assert sum(counts.values()) == 1000
    assert {counts[(0, f)] for f in range(3)} == {250} and {counts[(1, f)] for f in range(3)} <= {83, 84}


def test_empty_and_single_class_splits(spark):
    one = spark.range(3).select("id", F.lit(1).alias("significant"))
    assert sum(r.is_test for r in split.train_test(one).collect()) == 1
    assert split.train_test(one.where("id < 0")).count() == 0


def test_score_metrics(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(0, 0)] * 4, "significant int, prediction int")
    row = metrics.score_metrics(rows).collect()[0]
    assert (row.tp, row.fp, row.fn, row.tn) == (3, 1, 2, 4)
    assert (row.accuracy, row.precision, row.recall) == (0.7, 0.75, 0.6)
    assert row.f1 == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    nothing = metrics.score_metrics(rows.withColumn("prediction", F.lit(0))).collect()[0]
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)
    assert {(r.significant, r.prediction): r.n for r in metrics.confusion(rows).collect()}[(1, 1)] == 3


def brute_auc(rows):
    positive = [s for y, s in rows if y == 1]
    negative = [s for y, s in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in positive for n in negative) / (len(positive) * len(negative))


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_auc_counts_ties_half(spark, monkeypatch, per_task):
    monkeypatch.setattr(metrics, "SCORES_PER_TASK", per_task)
    rng = np.random.default_rng(5)
    rows = [(int(y), float(round(s + 0.2 * y, 2))) for y, s in zip(rng.integers(0, 2, 500), rng.random(500))]
    rows += [(0, 0.5)] * 200
    df = spark.createDataFrame(rows, "significant int, probability double")
    row = metrics.roc_auc(df).collect()[0]
    assert row.auc == pytest.approx(brute_auc(rows))
    assert metrics.roc_auc(df.where("significant = 1")).collect()[0].auc is None


def test_baselines(spark):
    rows = spark.range(20000).select("id", (F.col("id") % 4 == 0).cast("int").alias("significant"))
    parted = split.train_test(rows)
    scores = {r.strategy: r.accuracy for r in baseline_scores(parted.where("NOT is_test"), parted.where("is_test")).collect()}
    assert scores["most_frequent"] == 0.75
    assert math.isclose(scores["stratified"], 0.625, abs_tol=0.03)
    assert math.isclose(scores["uniform"], 0.5, abs_tol=0.03)
