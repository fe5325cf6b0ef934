"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links (a, b)``; the label is the least node that links reach.

    ``links`` are worked out once; those that come twice do no harm. They are first drawn together: each node stands for its least
    neighbour, and few links between different ones are left of a group whose members hang on the same centres. Labels spread
    along these and then jump to their label's label, so the number of rounds grows with the logarithm of the longest chain.
    Every round is written, which cuts the lineage. A node with many links is a skewed join key on one side, which adaptive
    execution splits, and its minimum is taken per task before it is shuffled.
    """
    edges = stored(_both_ways(links), "links")
    if not edges.take(1):
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    first = _least_neighbours(edges)
    further = joined(edges.where("a < b"), first)
    return first if further is None else stored(relabelled(first, "label", further), "labels")


def joined(links: DataFrame, labels: DataFrame) -> DataFrame | None:
    """``node, label`` of those labels that ``links (a, b)`` join with a lesser one; None if they join no different labels.

    A node that ``labels (node, label)`` does not hold is its own label.
    """
    end = lambda name: labels.select(F.col("node").alias(f"n{name}"), F.col("label").alias(f"l{name}"))
    ends = links.select("a", "b").join(end("a"), F.col("a") == F.col("na"), "left").join(
        end("b"), F.col("b") == F.col("nb"), "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b")
    fewer = stored(_both_ways(ends).distinct(), "links")
    return _spread(fewer) if fewer.take(1) else None


def relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of what ``column`` holds in its place, if ``labels (node, label)`` has one."""
    to = labels.select(F.col("node").alias("__t"), F.col("label").alias("__tl"))
    return rows.join(to, F.col(column) == F.col("__t"), "left").withColumn(column, F.coalesce("__tl", column)).drop("__t", "__tl")


def _both_ways(links: DataFrame) -> DataFrame:
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return links.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")


def _spread(edges: DataFrame) -> DataFrame:
    """``connected`` of links that stand in both directions."""
    labels = _least_neighbours(edges)
    while True:
        heard = edges.join(labels, F.col("b") == F.col("node")).select(
            F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        spread = labels.select("node", "label", F.col("label").alias("old")).unionByName(heard).groupBy("node").agg(
            F.min("label").alias("label"), F.min("old").alias("old"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("tl"))
        new = stored(spread.join(target, F.col("label") == F.col("t")).select(
            "node", F.least("label", "tl").alias("label"), F.col("old")), "labels")
        labels = new.select("node", "label")
        if not new.where("label != old").take(1):
            return labels
