"""Fitted forests and boosted trees as tables of their nodes."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import new_folder

ENSEMBLES = (GBTClassificationModel, RandomForestClassificationModel)


def _saved(spark: SparkSession, model: Model) -> str:
    if not isinstance(model, ENSEMBLES):
        raise ValueError(f"{type(model).__name__} is no forest and no boosted model")
    path = new_folder(spark, "trees")
    model.save(path)
    return path


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """(tree, weight, node, feature, threshold, gain, rows, prediction, left, right): a row per node; in leaves ``feature``,
    ``threshold``, ``left`` and ``right`` are null. ``rows`` is the weighted number of training rows in the node."""
    path = _saved(spark, model)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    # Boosted trees keep (count, sum, sum of squares) in a node, classification trees a count per class.
    stats = F.col("impurityStats")
    rows = F.get(stats, F.lit(0)) if isinstance(model, GBTClassificationModel) else F.aggregate(
        stats, F.lit(0.0), lambda a, x: a + x)
    inner = F.col("leftChild") >= 0
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"), "weight", F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.col("gain"), rows.alias("rows"), "prediction",
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
    )


def node_importance(nodes: DataFrame, per_tree: bool) -> DataFrame:
    """(feature, importance) of the features that split: gain times rows, summed over nodes, in shares of the whole.

    ``per_tree`` gives every tree the same weight, as forests do; boosted trees count as their gains.
    """
    gains = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    if per_tree:
        whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
        gains = gains.join(whole, "tree").select("tree", "feature", F.try_divide("gain", "whole").alias("gain"))
    summed = gains.groupBy("feature").agg(F.sum("gain").alias("gain"))
    whole = summed.agg(F.sum("gain")).scalar()
    return summed.select("feature", F.try_divide(F.col("gain"), whole).alias("importance"))


def first_trees(spark: SparkSession, model: GBTClassificationModel, k: int) -> GBTClassificationModel:
    """The boosted model after its first ``k`` rounds: its saved nodes and weights, cut and loaded again. No tree is fitted."""
    if not 0 < k <= model.getNumTrees:
        raise ValueError(f"cannot keep {k} of {model.getNumTrees} trees")
    path, cut = _saved(spark, model), new_folder(spark, "trees")
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    about["numTrees"] = k
    about["paramMap"]["maxIter"] = k
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{cut}/metadata")
    for part, tree in (("data", "treeID"), ("treesMetadata", "_1")):
        spark.read.parquet(f"{path}/{part}").where(F.col(tree) < k).write.parquet(f"{cut}/{part}")
    return GBTClassificationModel.load(cut)
