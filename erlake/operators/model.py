"""The pair classifier: training set, gradient-boosted trees, probabilities, threshold, result lists."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import metrics


def training_set(features: DataFrame, truth: DataFrame, negatives: DataFrame) -> DataFrame:
    """Features and label of the train fold's retrieved links and hard negatives; both classes must occur."""
    y = features.join(truth.withColumn("label", F.lit(1.0)), ["s1", "candidate"], "left").na.fill(0.0, ["label"])
    hard = negatives.select("s1", "candidate").withColumn("_hard", F.lit(True))
    df = y.join(hard, ["s1", "candidate"], "left").where("label = 1 OR _hard").drop("_hard").where(t.fold(F.col("s1")) == "train")
    if df.select("label").distinct().count() < 2:
        raise ValueError("training needs both classes")
    return df


def fit(train: DataFrame, trees: int = 160, seed: int = 2026) -> PipelineModel:
    names = [x for x in train.columns if x not in ("s1", "candidate", "label")]
    gbt = GBTClassifier(maxIter=trees, stepSize=0.05, maxDepth=4, minInstancesPerNode=40, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), gbt]).fit(train)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """(s1, candidate, p)."""
    return model.transform(features).select("s1", "candidate", vector_to_array("probability")[1].alias("p"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def best_threshold(anchors: DataFrame, truth: DataFrame, scored: DataFrame) -> float:
    """The threshold with the largest macro F0.5 on the calibration fold; ties to the larger."""
    own = lambda df: df.where(t.fold(F.col("s1")) == "calibration")
    sweep = metrics.threshold_sweep(own(anchors), own(truth), own(scored))
    return sweep.agg(F.max_by("threshold", F.struct("score", "threshold"))).first()[0]


def result_lists(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """One row an anchor: its matches, sorted and comma-joined; empty if there are none."""
    return anchors.select("s1").join(matches, "s1", "left").groupBy(F.col("s1").alias("source1_entity_id")).agg(F.array_join(F.array_sort(F.collect_set("candidate")), ",").alias("matched_entity_ids"))


def write_lists(lists: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """A headed TSV without quotes; anchors in ``done`` were written before and are left out (resumption)."""
    if done is not None:
        lists = lists.join(done, "source1_entity_id", "left_anti")
    lists.write.mode("append").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").csv(path)
