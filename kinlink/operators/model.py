"""Gradient-boosted pair models in MLlib: training, cross-validation, scoring, importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings of the two stages; depth stands for leaves, which MLlib doesn't limit.
STAGE1 = {"stepSize": 0.05, "maxDepth": 6, "maxBins": 255, "minInstancesPerNode": 200, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7", "maxIter": 200}
STAGE2 = {"stepSize": 0.05, "maxDepth": 5, "maxBins": 255, "minInstancesPerNode": 100, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7", "maxIter": 120}


def train(rows: DataFrame, features: list[str], label: str = "y", seed: int = 3, **settings) -> PipelineModel:
    """A pipeline of assembler and trees; it keeps the list of its features."""
    assembler = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    return Pipeline(stages=[assembler, GBTClassifier(featuresCol="__x", labelCol=label, seed=seed, **settings)]).fit(rows)


def features_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    """rows with the probability of a match."""
    keep = rows.columns
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias(name))


def importance(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by falling gain."""
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features_of(model), map(float, gains), strict=True), key=lambda x: (-x[1], x[0]))


def out_of_fold(rows: DataFrame, features: list[str], n: int = 5, fold: str = "fold", train_on=None, learn: DataFrame | None = None, **settings) -> DataFrame:
    """rows with p, each predicted by a model that saw no row of its fold.

    Models learn from rows, or from `learn` (with the same folds) if given; train_on filters what may be learned from.
    """
    parts = []
    for k in range(n):
        seen = (rows if learn is None else learn).where(F.col(fold) != k)
        model = train(seen if train_on is None else seen.where(train_on), features, **settings)
        parts.append(predict(model, rows.where(F.col(fold) == k)))
    return reduce(DataFrame.unionByName, parts)


def copy_check(rows: DataFrame, crowded: DataFrame, features: list[str], n: int = 5, **settings) -> DataFrame:
    """(q_rid, e_rid, p_plain, p_crowded): what models say of rows that learned from rows, and from rows with copies.

    If copies had taught a model no more than to know copies, it would do worse on rows, which hold none.
    """
    key = ["q_rid", "e_rid"]
    plain = out_of_fold(rows, features, n, **settings).select(*key, F.col("p").alias("p_plain"))
    other = out_of_fold(rows, features, n, learn=crowded, **settings).select(*key, F.col("p").alias("p_crowded"))
    return plain.join(other, key)
