"""Review of a saved model: thresholds, calibration and errors on the test rows.

The split is a function of id and seed, so the test rows are found again from the raw table.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as fn
from holdfast.operators import metrics as m
from holdfast.operators import reports
from holdfast.operators.clean import prepare
from holdfast.operators.models import score
from holdfast.operators.split import fit_splits
from holdfast.sources.artifacts import save_reports
from holdfast.spec import BASELINE, FeatureSpec


def review(
    model: PipelineModel, raw: DataFrame, out: str | None = None, spec: FeatureSpec = BASELINE,
    threshold: float = 0.5, seed: int = 42, profiles: bool = True,
) -> dict[str, DataFrame]:
    """Report tables by name; saved below ``out`` if given. ``profiles`` adds the error profiles of the account columns."""
    rows = prepare(raw, spec, "impute")
    rows = fit_splits(rows, "label", spec.id_cols[0], 0.70, 0.15, 0.15, seed).assign(rows)
    test = rows.where("split = 'test'").withColumn("y_true", F.col("label"))
    scored = score(model, test, ["y_true", *spec.features]).withColumn(
        "y_pred", fn.hard_label("y_prob", threshold)
    ).persist()
    tables = {
        "thresholds": reports.threshold_report(scored),
        "calibration": reports.calibration_report(scored),
        "brier": m.brier_score(scored),
        "errors": reports.error_report(scored),
    }
    if profiles:
        tables["false_negatives"] = reports.profile_report(m.false_negative_profile(scored))
        tables["false_positives"] = reports.profile_report(m.false_positive_profile(scored))
    if out:
        save_reports(tables, out)
    return tables
