"""ROC and precision-recall curves over all distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as fn
from holdfast.operators.metrics import score_totals


def _caught(
    df: DataFrame, y_true: str, y_prob: str, by: Sequence[str], lower: bool = False
) -> DataFrame:
    """Per distinct score: positives and negatives at or above it."""
    return score_totals(df, y_true, y_prob, by, lower).withColumns(
        {"tps": F.col("pos_total") - F.col("pos_before"),
         "fps": F.col("neg_total") - F.col("neg_before")}
    )


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def roc_curve(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", by: Sequence[str] = (),
    drop_intermediate: bool = True,
) -> DataFrame:
    """(fpr, tpr, threshold), thresholds descending from infinity.

    ``drop_intermediate`` leaves out points on a straight line: a score whose successor has the
    same counts does not bend the curve. A rate without its class is null.
    """
    points = _caught(df, y_true, y_prob, by, lower=drop_intermediate)
    if drop_intermediate:
        lowest = F.col("pos_lower").isNull()
        highest = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        bends = (F.col("pos_lower") != F.col("pos")) | (F.col("neg_lower") != F.col("neg"))
        points = points.where(lowest | highest | bends)
    # The curve starts at (0, 0); that point is emitted beside the highest score.
    first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    here = F.struct(
        _share(F.col("fps"), F.col("neg_total")).alias("fpr"),
        _share(F.col("tps"), F.col("pos_total")).alias("tpr"),
        F.col("y_prob").alias("threshold"),
    )
    zero = F.lit(0)
    start = F.struct(
        _share(zero, F.col("neg_total")).alias("fpr"), _share(zero, F.col("pos_total")).alias("tpr"),
        F.lit(float("inf")).alias("threshold"),
    )
    return points.select(*by, F.inline(F.when(first, F.array(start, here)).otherwise(F.array(here))))


def precision_recall_curve(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", by: Sequence[str] = ()
) -> DataFrame:
    """(precision, recall, threshold) per distinct score and a last point (1, 0) without one."""
    points = _caught(df, y_true, y_prob, by)
    here = F.struct(
        fn.ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        F.coalesce(_share(F.col("tps"), F.col("pos_total")), F.lit(1.0)).alias("recall"),
        F.col("y_prob").alias("threshold"),
    )
    end = F.struct(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                   F.lit(None).cast("double").alias("threshold"))
    highest = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    return points.select(*by, F.inline(F.when(highest, F.array(here, end)).otherwise(F.array(here))))
