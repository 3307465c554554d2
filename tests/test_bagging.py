from __future__ import annotations

import threading
import time
from collections import Counter

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tarmac.checks import analytics
from tarmac.operators.features import training_rows
from tarmac.plans import bagging, training
from tarmac.plans.concurrent import side_by_side
from tarmac.sources.scratch import stage

SF = "/root/testdata/sf0.001"
SMALL = {"numTrees": 3, "maxDepth": 4, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.8}


@pytest.fixture(scope="module")
def rows(spark):
    return stage(training_rows(analytics._dataset(spark, SF)).withColumn("significant", F.expr("CAST(id % 11 = 0 AS INT)")), "bagged")


def test_poisson_limits_end_at_one_and_give_the_mean():
    for rate in (0.1, 0.7, 1.0, 3.0):
        limits = bagging.poisson_limits(rate)
        chances = [b - a for a, b in zip([0.0, *limits], limits)]
        assert limits == sorted(limits) and limits[-1] > 1 - 1e-9
        assert sum(i * c for i, c in enumerate(chances)) == pytest.approx(rate, abs=1e-6)


def test_weights_balance_every_bootstrap(spark, rows):
    found = bagging.bootstrap_weights(rows, "id", 4, 0.8).collect()
    by_tree = {}
    for row in found:
        by_tree.setdefault(row.tree, {})[row.significant] = row.n * row.weight
    assert len(by_tree) == 4 and all(sides[0] == pytest.approx(sides[1]) for sides in by_tree.values())
    assert len({row.n for row in found if row.significant == 1}) > 1  # bootstraps differ
    one_sided = bagging.bootstrap_weights(rows.where("significant = 0"), "id", 2, 0.8).collect()
    assert {row.weight for row in one_sided} == {1.0}
    assert bagging.bootstrap_weights(rows.limit(0), "id", 2, 0.8).collect() == []


def test_forest_is_repeatable_and_survives_saving(spark, rows, tmp_path):
    scores = []
    for bound in (1, 3):
        forest = bagging.fit_balanced(rows, bound=bound, **SMALL)
        scores.append({row.id: row.probability for row in forest.predict(rows).select("id", "probability").collect()})
    assert scores[0] == pytest.approx(scores[1]) and len(set(scores[0].values())) > 3
    forest.save(str(tmp_path / "model"))
    again = bagging.BalancedForest.load(str(tmp_path / "model")).predict(rows)
    assert again.columns == [*rows.columns, "prediction", "probability"]
    assert {row.id: row.probability for row in again.collect()} == pytest.approx(scores[0])
    assert all(row.prediction == int(row.probability > 0.5) for row in again.collect())


def test_rare_class_gets_as_much_weight_as_the_other(spark, rows):
    # A feature that says nothing: balanced trees vote one half, where unweighted ones would vote the share of the class.
    flat = VectorAssembler(inputCols=["flat"], outputCol="features").transform(rows.select("id", "significant", F.lit(1.0).alias("flat")))
    trees = bagging.fit_trees(stage(flat, "flat"), "id", {**SMALL, "featureSubsetStrategy": "all"})
    votes = bagging.BalancedForest(None, trees).vote(flat).select("probability").distinct().collect()
    assert [row.probability for row in votes] == [pytest.approx(0.5)]


def test_results_keep_their_order_and_the_bound_holds(spark):
    running, most, lock = Counter(), [], threading.Lock()

    def task(i):
        with lock:
            running["now"] += 1
            most.append(running["now"])
        time.sleep(0.2 if i % 2 else 0.05)
        with lock:
            running["now"] -= 1
        return i

    assert side_by_side(spark, [lambda i=i: task(i) for i in range(9)], 3) == list(range(9))
    assert max(most) == 3 and side_by_side(spark, [], 2) == []
    with pytest.raises(ValueError):
        side_by_side(spark, [], 0)


def test_the_first_error_stops_what_has_not_begun(spark):
    begun = []

    def task(i):
        begun.append(i)
        if i == 1:
            raise RuntimeError("broken")
        time.sleep(0.1)
        return i

    with pytest.raises(RuntimeError, match="broken"):
        side_by_side(spark, [lambda i=i: task(i) for i in range(20)], 2)
    assert len(begun) < 6


def test_search_gives_the_same_table_and_its_jobs_overlap(spark, rows):
    draws = [{**SMALL, "numTrees": trees} for trees in (2, 3)]
    seen, done = [], threading.Event()

    def watch():
        while not done.is_set():
            seen.append(len(spark.sparkContext.statusTracker().getActiveJobsIds()))
            time.sleep(0.02)

    alone = training.search(rows, draws, bound=1).collect()
    watcher = threading.Thread(target=watch)
    watcher.start()
    together = training.search(rows, draws, bound=3).collect()
    done.set()
    watcher.join()
    assert alone == together and max(seen) >= 2
