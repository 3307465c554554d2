from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarmac.fields import CATEGORICAL_FEATURES, MODEL_FEATURES, NUMERIC_FEATURES
from tarmac.operators import contracts, metrics, split
from tarmac.plans import scoring, training
from tarmac.sources.warehouse import Warehouse

SMALL = {"numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.5", "subsamplingRate": 0.9}


@pytest.fixture(scope="module")
def parted(spark):
    noise = F.md5(F.col("id").cast("string"))
    number = F.conv(F.substring(noise, 1, 4), 16, 10).cast("double") / 65536
    columns = {name: (number * (i + 1)) % 1 for i, name in enumerate(NUMERIC_FEATURES)}
    rows = spark.range(600).select(
        "id", *[column.alias(name) for name, column in columns.items()],
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("flight_date"),
        F.concat(F.lit("A"), (F.col("id") % 5).cast("string")).alias("origin"),
        F.concat(F.lit("B"), (F.col("id") % 4).cast("string")).alias("dest"),
        ((number > 0.6) | (F.col("id") % 11 == 0)).cast("int").alias("significant"),
    )
    return split.train_test(rows).cache()


def test_fit_save_load_predict(spark, parted, tmp_path):
    path = str(tmp_path / "model")
    training.save(training.fit(parted.where("NOT is_test"), **SMALL), path)
    test = parted.where("is_test")
    scored = training.predict(training.load(path), test)
    assert scored.count() == test.count()
    assert scored.where("probability < 0 OR probability > 1 OR prediction NOT IN (0, 1)").count() == 0
    assert metrics.roc_auc(scored).collect()[0].auc > 0.8
    unseen = test.withColumn("origin", F.lit("NEW")).withColumn("flight_date", F.lit("2030-01-01").cast("date"))
    assert training.predict(training.load(path), unseen).where("probability IS NOT NULL").count() == test.count()


def test_fresh_model_scores_after_publishing_in_the_same_session(spark, parted, tmp_path):
    train = Warehouse(spark, str(tmp_path / "wh")).publish("rows", parted.where("NOT is_test"))
    scored = training.predict(training.fit(train, **SMALL), parted.where("is_test"))
    assert scored.where("probability IS NOT NULL").count() == parted.where("is_test").count()


def test_weights_balance_the_classes(parted):
    totals = training.with_weights(parted).groupBy("significant").agg(F.sum("weight").alias("w")).collect()
    assert totals[0].w == pytest.approx(totals[1].w)


def test_drawn_parameters_are_distinct_and_from_the_grid():
    draws = training.draw_parameters()
    assert len(draws) == 24 and len({tuple(d.items()) for d in draws}) == 24
    assert all(d[name] in values for d in draws for name, values in training.GRID.items())
    assert draws == training.draw_parameters() != training.draw_parameters(seed=2)


def test_search_reports_every_draw(parted):
    draws = [SMALL, {**SMALL, "numTrees": 2, "maxDepth": None}]
    train = parted.where("NOT is_test")
    results = training.search(train, draws).collect()
    assert len(results) == 2 and results[0].mean_f1 >= results[1].mean_f1
    assert any("maxDepth=30" in r.params for r in results)


def test_run_log_appends(spark, parted, tmp_path):
    scored = parted.where("is_test").select("significant", F.lit(1).alias("prediction"), F.lit(0.5).alias("probability"))
    path = str(tmp_path / "runs")
    for _ in range(2):
        training.log_run(path, metrics.score_metrics(scored), metrics.roc_auc(scored), 0.4, SMALL)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and rows[0].roc_auc == 0.5 and "maxDepth=4" in rows[0].params


def test_only_complete_requests_get_a_prediction(spark, parted):
    model = training.fit(parted.where("NOT is_test"), **SMALL)
    outcomes = parted.select(
        F.col("id").alias("req_id"), F.lit("s").alias("stage"), F.when(F.col("id") % 2 == 0, 200).otherwise(404).alias("status_code"),
        F.lit("m").alias("message"), *[F.lit(None).cast("string").alias(n) for n in scoring.RESPONSE_FIELDS if n not in MODEL_FEATURES],
        *[F.when(F.col("id") % 2 == 0, F.col(name)).alias(name) for name in MODEL_FEATURES],
    )
    scored = scoring.score_requests(outcomes, model)
    assert scored.count() == 600
    assert scored.where("status_code = 200").where("significant_delay_probability IS NULL").count() == 0
    failed = scored.where("status_code <> 200")
    assert failed.where("significant_delay_probability IS NOT NULL OR risk <> '--'").count() == 0
    assert contracts.result_violations(scored.where("status_code = 200")).count() == 0
    assert set(CATEGORICAL_FEATURES) < set(MODEL_FEATURES) and len(MODEL_FEATURES) == 39
