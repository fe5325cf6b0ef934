"""Queries over whole runs: training, comparison of candidates, review of a saved model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

import fixtures as fx
from catalog import tables_sql as q
from catalog.base import query, rounded
from catalog.evaluation import _RECORD
from catalog.fitting import _GROUPED_WIDE, ID, prepared
from catalog.modelling import _SCALED_TWO, _SMALL, _TRAIN_TWO, _TWO, newton
from holdfast.operators import preprocess as pp
from holdfast.operators.split import fit_splits
from holdfast.plans.review import review
from holdfast.plans.training import train_baseline, train_candidates
from holdfast.session import new_folder
from holdfast.sources import artifacts as art
from holdfast.spec import GROUPED, NEGATIVE, NUMERIC, POSITIVE, TARGET_COL

#: Accounts described by two numbers, so that SQL can fit the same model.
_ROLES = replace(_TWO, target=TARGET_COL, positive=POSITIVE, negative=NEGATIVE)
_FITTED = newton(balanced=True, frame=_SCALED_TWO, counts=_TRAIN_TWO) + f""",
s AS (SELECT avg(t) AS mt, stddev_pop(t) AS st, avg(c) AS mc, stddev_pop(c) AS sc FROM ({_TRAIN_TWO})),
judged AS MATERIALIZED (SELECT split, label AS y_true, 1 / (1 + exp(-(b + b1 * (tenure - mt) / st + b2 * ("MonthlyCharges" - mc) / sc))) AS y_prob
           FROM ({q.SPLIT_ACCOUNTS}), beta, s WHERE split <> 'train')"""


@query("M06_baseline_run", _FITTED + f"""
SELECT * REPLACE (round(roc_auc, 4) AS roc_auc) FROM (
  SELECT split, {_RECORD} FROM ({q.evaluation("SELECT * FROM judged", "split", "CAST(y_prob > 0.5 AS INTEGER)")}))""")
def baseline_run(spark, sf):
    """From a raw snapshot to the evaluation of the saved model on validation and test rows."""
    run = train_baseline(fx.accounts(spark, sf), new_folder(spark, "run"), _ROLES)
    return rounded(run.evaluation, 4, "roc_auc")


@query("S06_run_record", _FITTED + f"""
SELECT 'LogisticRegression' AS model_type, split AS dataset, n_samples, tp AS true_positives, tn AS true_negatives
FROM (SELECT *, tn + fp + fn + tp AS n_samples FROM ({q.evaluation("SELECT * FROM judged", "split", "CAST(y_prob > 0.5 AS INTEGER)")}))""")
def run_record(spark, sf):
    """What a run leaves as its metrics record, read back from its folder."""
    out = new_folder(spark, "run")
    run = train_baseline(fx.accounts(spark, sf), out, _ROLES)
    like = art.metrics_record(run.evaluation, "LogisticRegression", {"seed": 42})
    found = art.load_metrics(spark, f"{out}/metrics", like)
    parts = found.select("model_type", F.inline(F.array("validation", "test")))
    return parts.select("model_type", "dataset", "n_samples", "confusion_matrix.true_positives", "confusion_matrix.true_negatives")


@query("S08_review_thresholds", _FITTED + f"""
SELECT CAST(threshold AS VARCHAR) AS threshold, CAST(tp AS VARCHAR) || '/' || CAST(tp + fn AS VARCHAR) AS positives_caught, fp AS false_alarms
FROM ({q.sweep("SELECT * FROM judged WHERE split = 'test'", [0.3, 0.4, 0.5, 0.6, 0.7])})""")
def review_thresholds(spark, sf):
    """A saved model, loaded and reviewed on the test rows that its seed gives again."""
    raw, out = fx.accounts(spark, sf), new_folder(spark, "run")
    train_baseline(raw, out, _ROLES)
    tables = review(art.load_model(f"{out}/model"), raw, spec=_ROLES, profiles=False)
    return tables["thresholds"].select("threshold", "positives_caught", "false_alarms")


@query("M07_candidate_run", f"""
SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, CAST(3 AS BIGINT) AS n_compared, true AS best_is_first
FROM ({q.SPLIT_ACCOUNTS_ZERO}) GROUP BY split""")
def candidate_run(spark, sf):
    """The run that compares models: grouped roles, blank charges as 0.0, 60/20/20."""
    run = train_candidates(fx.accounts(spark, sf), new_folder(spark, "run"), params=_SMALL)
    order = [r["model"] for r in run.comparison.collect()]  # a row per model
    return run.summary.select("split", "n", "n_positive", F.lit(len(order)).cast("long").alias("n_compared"),
                              F.lit(order[0] == run.best).alias("best_is_first"))


@query("F11_grouped_zero", f"""WITH base AS MATERIALIZED ({q.SPLIT_ACCOUNTS_ZERO}),
fit AS MATERIALIZED (SELECT * FROM base WHERE split = 'train') SELECT "customerID", split, {_GROUPED_WIDE} FROM base""")
def grouped_zero(spark, sf):
    """Fitted on the training rows of the run that compares models, applied to all."""
    rows = prepared(spark, sf, "zero", GROUPED).persist()
    cuts = fit_splits(rows, "label", ID, 0.6, 0.2, 0.2)
    model = pp.fit_preprocessor(cuts.assign(rows).where("split = 'train'"), GROUPED)
    return rounded(model.transform(cuts.assign(rows), [ID, "split"]), 6, *[f"numeric__{c}" for c in NUMERIC])
