"""Random-forest training, search, baselines and persistence on Spark ML."""

from __future__ import annotations

import random
from math import ceil, prod
from statistics import mean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.fields import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from tarmac.operators.features import scoring_features, training_rows
from tarmac.operators.metrics import roc_auc, score_metrics
from tarmac.operators.profile import class_weights
from tarmac.operators.split import folds, train_test
from tarmac.plans.concurrent import side_by_side
from tarmac.sources.scratch import stage

# The search grid, in MLlib terms. A depth of None is MLlib's maximum.
GRID: dict[str, list] = {
    "numTrees": [150, 250, 350],
    "maxDepth": [12, 18, 24, None],
    "minInstancesPerNode": [2, 5, 10],
    "featureSubsetStrategy": ["sqrt", "log2", "0.5"],
    "subsamplingRate": [0.7, 0.9],
}
# The parameters chosen for the final model.
CHOSEN = {
    "numTrees": 350,
    "maxDepth": 18,
    "minInstancesPerNode": 10,
    "featureSubsetStrategy": "0.5",
    "subsamplingRate": 0.9,
}
DEEPEST = 30
# Training keeps nearly 2 KB of a row of the dataset, and a task reads its whole part at every level of the trees.
ROWS_PER_TASK = 100_000


def forest(**parameters) -> RandomForestClassifier:
    """Weighted forest whose settings suit large tables.

    Node ids are cached and checkpointed, so deep trees do not re-walk the forest
    for every row at every level.
    """
    if parameters.get("maxDepth", 0) is None:
        parameters["maxDepth"] = DEEPEST
    return RandomForestClassifier(**{
        "labelCol": "significant", "featuresCol": "features", "weightCol": "weight",
        "maxBins": 128, "seed": 1, "cacheNodeIds": True, "checkpointInterval": 10,
        "maxMemoryInMB": 1024, **parameters,
    })


def feature_stages() -> list:
    """One-hot categories (unseen ones become all zeros) beside the numeric columns."""
    indexed = [f"{name}_index" for name in CATEGORICAL_FEATURES]
    encoded = [f"{name}_onehot" for name in CATEGORICAL_FEATURES]
    return [
        StringIndexer(inputCols=list(CATEGORICAL_FEATURES), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=[*encoded, *NUMERIC_FEATURES], outputCol="features"),
    ]


def with_weights(rows: DataFrame) -> DataFrame:
    """Balanced class weight per row; the two weights are constants in the plan."""
    weight = F.lit(None).cast("double")
    for row in class_weights(rows).collect():
        weight = F.when(F.col("significant") == row.significant, row.weight).otherwise(weight)
    return rows.withColumn("weight", weight)


def prepare(rows: DataFrame) -> DataFrame:
    return with_weights(scoring_features(rows))


def dealt(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored rows in parts of about ``limit`` rows (``ROWS_PER_TASK``) at most; where no part has more they are returned as they are.

    Files of training rows are so small for their number of rows that a scan packs millions into one task. MLlib draws its
    bootstrap by part, so a forest may depend on the parts, which follow the rows and not the cluster once there are more.
    """
    limit = limit or ROWS_PER_TASK
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) <= limit:
        return rows
    return rows.repartition(ceil(sizes[1] / limit), *[name for name in ("id",) if name in rows.columns])


def fit(train: DataFrame, **parameters) -> PipelineModel:
    """Fit the pipeline on stored rows; parameters default to the chosen ones."""
    return Pipeline(stages=[*feature_stages(), forest(**(parameters or CHOSEN))]).fit(prepare(dealt(train)))


def draw_parameters(draws: int = 24, seed: int = 1, grid: dict[str, list] = GRID) -> list[dict]:
    """Distinct random combinations from the grid."""
    picked = random.Random(seed).sample(range(prod(map(len, grid.values()))), draws)
    maps = []
    for position in picked:
        chosen = {}
        for name, values in grid.items():
            position, index = divmod(position, len(values))
            chosen[name] = values[index]
        maps.append(chosen)
    return maps


def search(train: DataFrame, draws: list[dict] | None = None, seed: int = 1, folds_of: int = 3, bound: int = 4) -> DataFrame:
    """Cross-validated F1 of class 1 for each drawn combination: params, mean_f1, std_f1, best first.

    The folds are exactly stratified and written once. Indexer, encoder and assembler are fitted once per fold, and its feature
    vectors are written once for all draws of that fold; only draws times folds numbers reach the driver. ``bound`` fits run at a
    time, each of which keeps its own rows in executor memory or disk while it runs; the table does not depend on it.
    """
    draws = draws or draw_parameters(seed=seed)
    assigned = stage(prepare(folds(train, folds_of, seed=seed)), "folds")

    def vectors_of(fold: int) -> tuple[DataFrame, DataFrame]:
        features = Pipeline(stages=feature_stages()).fit(assigned.where(F.col("fold") != fold))
        vectors = stage(features.transform(assigned).select("id", "fold", "significant", "weight", "features"), "fold-vectors")
        return dealt(vectors.where(F.col("fold") != fold)), vectors.where(F.col("fold") == fold)

    def score(learn: DataFrame, held: DataFrame, chosen: dict) -> float:
        return score_metrics(forest(**chosen).fit(learn).transform(held)).first().f1

    spark = train.sparkSession
    vectors = side_by_side(spark, [lambda fold=fold: vectors_of(fold) for fold in range(folds_of)], bound)
    scores = side_by_side(spark, [
        lambda fold=fold, chosen=chosen: score(*vectors[fold], chosen) for chosen in draws for fold in range(folds_of)], bound)
    rows = []
    for place, chosen in enumerate(draws):
        own = scores[place * folds_of:(place + 1) * folds_of]
        rows.append((params_text(chosen), mean(own), pstdev(own)))
    return train.sparkSession.createDataFrame(rows, "params string, mean_f1 double, std_f1 double").orderBy(
        F.desc("mean_f1"), "params")


def params_text(chosen: dict) -> str:
    return ",".join(f"{name}={DEEPEST if value is None else value}" for name, value in sorted(chosen.items()))


def best_parameters(results: DataFrame, draws: list[dict]) -> tuple[dict, float]:
    """The drawn combination with the best mean F1, ties by its text, and that F1."""
    best = results.orderBy(F.desc("mean_f1"), "params").first()
    return next(chosen for chosen in draws if params_text(chosen) == best.params), best.mean_f1


def training_run(dataset: DataFrame, path: str, draws: list[dict] | None = None, cap: int | None = None, seed: int = 1) -> PipelineModel:
    """Split the stored dataset, search, fit the best parameters, test them and append the run to the table at ``path``.

    ``cap`` bounds the labelled rows by id. Returns the fitted model; the log has the best cross-validation F1 and parameters.
    """
    parted = stage(train_test(training_rows(dataset, cap)), "training")
    learn, test = parted.where("NOT is_test"), parted.where("is_test")
    draws = draws or draw_parameters(seed=seed)
    chosen, best_f1 = best_parameters(search(learn, draws, seed), draws)
    model = fit(learn, **chosen)
    scored = stage(predict(model, test).select("significant", "prediction", "probability"), "test-scores")
    log_run(path, score_metrics(scored), roc_auc(scored), best_f1, chosen)
    return model


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` (0/1) and the probability of a significant delay."""
    scored = model.transform(scoring_features(rows).withColumn("weight", F.lit(1.0)))
    return scored.withColumns({
        "prediction": F.col("prediction").cast("int"),
        "probability": vector_to_array("probability")[1],
    }).select(*rows.columns, "prediction", "probability")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def uniform_draw(key: str, salt: str) -> Column:
    """A repeatable uniform number in [0, 1) per row."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def baseline_scores(train: DataFrame, test: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """Test accuracy of guessing the most frequent class, by class share, and evenly."""
    counts = {row.significant: row.n for row in train.groupBy("significant").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    share = positive / max(positive + negative, 1)
    guesses = {
        "most_frequent": F.lit(int(positive > negative)),
        "stratified": (uniform_draw(key, f"stratified{seed}") < share).cast("int"),
        "uniform": (uniform_draw(key, f"uniform{seed}") < 0.5).cast("int"),
    }
    hits = test.agg(*[
        F.avg((guess == F.col("significant")).cast("double")).alias(name) for name, guess in guesses.items()
    ])
    rows = F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(name).alias("accuracy")) for name in guesses])
    return hits.select(F.inline(rows))


def log_run(path: str, metrics: DataFrame, auc: DataFrame, best_f1: float | None, params: dict) -> None:
    """Append one run's metrics and parameters to a results table."""
    text = params_text(params)
    scores = metrics.select("accuracy", "precision", "recall", "f1").collect()[0]
    row = auc.select(
        F.current_timestamp().alias("run_at"), F.lit(best_f1).cast("double").alias("best_cv_f1"),
        *[F.lit(scores[name]).alias(name) for name in ("accuracy", "precision", "recall", "f1")],
        F.col("auc").alias("roc_auc"), F.lit(text).alias("params"),
    )
    row.write.mode("append").parquet(path)
