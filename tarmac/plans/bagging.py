"""Forests whose class weights belong to each tree's own bootstrap.

MLlib weighs classes for a whole forest. Here every tree gets its own sample, drawn as a Poisson number for each row from a hash of its
key, the class weights that balance that sample, and one tree is fitted on the weighted rows. Probabilities are averaged over trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.plans import training
from tarmac.plans.concurrent import side_by_side
from tarmac.sources.scratch import stage


def poisson_limits(rate: float) -> list[float]:
    """Upper ends in [0, 1) of the uniform draws that mean 0, 1, 2, ... copies; the last is within 1e-9 of one."""
    limits, chance, total = [], math.exp(-rate), 0.0
    while 1 - total > 1e-9:
        total += chance
        limits.append(total)
        chance *= rate / len(limits)
    return limits


def copies(key: str, tree: str, rate: float, seed: int = 1) -> str:
    """SQL for how often a tree's bootstrap takes a row; ``tree`` is SQL text too."""
    draw = f"CAST(conv(substring(md5(concat('bag{seed}:', {tree}, ':', CAST({key} AS STRING))), 1, 8), 16, 10) AS BIGINT) / 4294967296D"
    cases = " ".join(f"WHEN {draw} < {limit!r}D THEN {count}" for count, limit in enumerate(poisson_limits(rate)))
    return f"CASE {cases} ELSE {len(poisson_limits(rate))} END"


def bootstrap_weights(rows: DataFrame, key: str, trees: int, rate: float, seed: int = 1) -> DataFrame:
    """tree, significant, n, weight: rows each bootstrap takes of a class, repeats counted, and what balances them.

    The weight is the bootstrap's size over the number of its classes and over n. Rows are counted inside the tasks; trees times
    classes numbers come out. A class that a bootstrap missed has no row.
    """
    drawn = rows.where("significant IS NOT NULL").select("significant", F.col(key).alias("_key"), F.explode(
        F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("tree", "significant", F.expr(copies("_key", "tree", rate, seed)).alias("n"))
    counted = drawn.groupBy("tree", "significant").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")
    whole = counted.groupBy(F.col("tree").alias("_tree")).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("classes"))
    return counted.join(whole, F.col("tree") == F.col("_tree")).select(
        "tree", "significant", "n", (F.col("size") / (F.col("classes") * F.col("n"))).alias("weight"))


@dataclass
class BalancedForest:
    """Fitted features and one-tree models that vote with equal weight."""

    features: PipelineModel
    trees: list[RandomForestClassificationModel]

    def vote(self, vectors: DataFrame) -> DataFrame:
        """Add ``probability`` of class 1, the mean over trees, and ``prediction``, 1 above one half."""
        kept = [name for name in vectors.columns if name != "features"]
        scored = vectors
        for place, tree in enumerate(self.trees):
            named = tree.copy().setProbabilityCol(f"_votes_{place}").setRawPredictionCol("").setPredictionCol("")
            scored = named.transform(scored)
        mean = sum((vector_to_array(f"_votes_{place}")[1] for place in range(len(self.trees))), F.lit(0.0)) / len(self.trees)
        return scored.select(*kept, mean.alias("probability")).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``training.predict`` of this forest."""
        vectors = self.features.transform(training.scoring_features(rows)).select(*rows.columns, "features")
        return self.vote(vectors).select(*rows.columns, "prediction", "probability")

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        PipelineModel(self.trees).write().overwrite().save(f"{path}/trees")

    @staticmethod
    def load(path: str) -> BalancedForest:
        return BalancedForest(PipelineModel.load(f"{path}/features"), list(PipelineModel.load(f"{path}/trees").stages))


def fit_trees(vectors: DataFrame, key: str, parameters: dict, bound: int = 4, seed: int = 1) -> list[RandomForestClassificationModel]:
    """One tree for each bootstrap of ``vectors`` (key, significant, features), a written table; ``bound`` of them at a time."""
    parameters = dict(parameters)
    trees, rate = parameters.pop("numTrees"), parameters.pop("subsamplingRate", 1.0)
    weights: dict[int, dict[int, float]] = {}
    for row in bootstrap_weights(vectors, key, trees, rate, seed).collect():
        weights.setdefault(row.tree, {})[row.significant] = row.weight

    def grow(tree: int) -> RandomForestClassificationModel:
        own = " ".join(f"WHEN {label} THEN {weight!r}D" for label, weight in sorted(weights[tree].items()))
        sample = vectors.withColumn("_copies", F.expr(copies(key, f"'{tree}'", rate, seed))).where("_copies > 0").withColumn(
            "weight", F.expr(f"_copies * CASE significant {own} END")).select("significant", "weight", "features")
        return training.forest(**parameters, numTrees=1, bootstrap=False, subsamplingRate=1.0, seed=seed + tree).fit(sample)

    empty = [tree for tree in range(trees) if tree not in weights]
    if empty:
        raise ValueError(f"bootstraps {empty[:5]} took no row")
    return side_by_side(vectors.sparkSession, [lambda tree=tree: grow(tree) for tree in range(trees)], bound)


def fit_balanced(train: DataFrame, key: str = "id", bound: int = 4, seed: int = 1, **parameters) -> BalancedForest:
    """Fit features and trees on labelled rows; parameters default to the chosen ones.

    The feature vectors are written once for all trees. A bootstrap depends on the key and the seed alone, so a repeat gives the same trees.
    """
    rows = training.scoring_features(train)
    features = training.Pipeline(stages=training.feature_stages()).fit(rows)
    vectors = stage(features.transform(rows).select(key, "significant", "features"), "bagging-vectors")
    return BalancedForest(features, fit_trees(vectors, key, parameters or training.CHOSEN, bound, seed))
