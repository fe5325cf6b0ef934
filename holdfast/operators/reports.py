"""Report tables in display form: text with fixed decimals, ready to be written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as fn
from holdfast.operators import metrics as m


def threshold_report(df: DataFrame, thresholds: Sequence[float] = m.DEFAULT_THRESHOLDS) -> DataFrame:
    rows = m.threshold_sweep(df, thresholds)
    return rows.select(
        F.col("threshold").cast("string").alias("threshold"),
        *[fn.fixed(c, 2).alias(c) for c in ("precision", "recall", "f1")],
        "positives_caught", "false_alarms",
    )


def calibration_report(df: DataFrame, n_bins: int = 10) -> DataFrame:
    return m.calibration_bins(df, n_bins).select(
        "bin", fn.fixed("actual_rate", 2).alias("actual_rate"), "count",
        F.when(F.col("gap") >= 0, F.concat(F.lit("+"), fn.fixed("gap", 2)))
        .otherwise(fn.fixed("gap", 2)).alias("gap"),
    )


def error_report(df: DataFrame) -> DataFrame:
    rows = m.outcome_counts(df)
    return rows.select("outcome", "n", F.concat(fn.fixed("percent", 1), F.lit("%")).alias("percent"))


def profile_report(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """An error profile: means with one decimal, shares as whole percents."""

    def shown(c: str):
        return F.when(F.col("feature").startswith("mean "), fn.fixed(c, 1)).otherwise(fn.percent(c, 0))

    return profile.select(*by, "feature", *[shown(c).alias(c) for c in ("among_errors", "among_class")])
