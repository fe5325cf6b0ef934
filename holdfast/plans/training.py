"""Whole training runs, from a raw snapshot to saved artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import metrics as m
from holdfast.operators import models as md
from holdfast.operators.clean import prepare
from holdfast.operators.preprocess import fit_preprocessor, schema_table
from holdfast.operators.split import (
    SplitCuts, SplitTable, fit_splits, require_no_leakage, split_summary,
)
from holdfast.session import written
from holdfast.sources import artifacts as art
from holdfast.spec import BASELINE, GROUPED, FeatureSpec


@dataclass(frozen=True)
class BaselineRun:
    pipeline: md.FittedPipeline
    cuts: SplitCuts | SplitTable
    evaluation: DataFrame
    gaps: DataFrame


def train_baseline(
    raw: DataFrame, out: str | None = None, spec: FeatureSpec = BASELINE, seed: int = 42,
) -> BaselineRun:
    """Balanced logistic regression on a 70/15/15 split, judged on validation and test.

    With ``out`` the model, the metrics and the schema are saved below it.
    """
    rows = prepare(raw, spec, "impute")
    id_col = spec.id_cols[0]
    cuts = fit_splits(rows, "label", id_col, 0.70, 0.15, 0.15, seed)
    rows = cuts.assign(rows).persist()
    pipeline = md.fit_pipeline(rows.where("split = 'train'"), spec, balanced=True)
    # Scoring costs more than the two columns it leaves; metrics read them several times.
    keep = ["split", F.col("label").alias("y_true")]
    scored = pipeline.score(rows.where("split <> 'train'"), keep).persist()
    evaluation = m.evaluation_record(scored, y_pred="y_pred", by=("split",))
    if out:
        if pipeline.preprocessor.large:
            art.save_pipeline(pipeline, f"{out}/model")
        else:
            art.save_model(pipeline.model, f"{out}/model")
        config = {"solver": "lbfgs", "max_iter": 1000, "class_weight": "balanced", "C": 1.0, "seed": seed}
        art.save_metrics(art.metrics_record(evaluation, "LogisticRegression", config), f"{out}/metrics")
        art.save_schema(schema_table(pipeline.preprocessor, rows), f"{out}/schema")
    return BaselineRun(pipeline, cuts, evaluation, m.split_gap(scored, y_pred="y_pred"))


@dataclass(frozen=True)
class CandidateRun:
    trained: dict[str, md.Trained]
    summary: DataFrame
    comparison: DataFrame
    overfit: DataFrame
    best: str
    scored: DataFrame


def train_candidates(
    raw: DataFrame, out: str | None = None, spec: FeatureSpec = GROUPED, seed: int = 42,
    params: dict[str, dict] | None = None,
) -> CandidateRun:
    """Three models on a 60/20/20 split, compared on validation; the best one and the logistic
    regression are saved below ``out``."""
    rows = prepare(raw, spec, "zero")
    id_col = spec.id_cols[0]
    rows = fit_splits(rows, "label", id_col, 0.6, 0.2, 0.2, seed).assign(rows)
    rows = require_no_leakage(rows.persist(), id_col)
    train = rows.where("split = 'train'")
    prep = fit_preprocessor(train, spec).pipeline(train)
    # as in fit_pipeline: parts by bytes, since the models are fitted in very many steps
    ready = written(prep.transform(rows).select(id_col, "split", "label", "features"), "features").persist()
    summary = split_summary(ready, "label")
    trained = md.train_candidates(ready.where("split = 'train'"), id_col, params=params)
    rows.unpersist()
    scored = md.score_candidates(trained, ready.where("split <> 'test'"), ["split"]).persist()
    comparison = m.compare_models(scored.where("split = 'validation'"))
    best = comparison.first()["model"]
    if out:
        for name in {best, "logistic_regression"}:
            model = md.PipelineModel([*prep.stages, trained[name].model])
            art.save_model(model, f"{out}/{name}")
    return CandidateRun(trained, summary, comparison, m.overfit_report(scored), best, scored)
