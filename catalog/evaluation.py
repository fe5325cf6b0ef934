"""Queries over scored tables: metrics, curves, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

import fixtures as fx
from catalog import tables_sql as q
from catalog.base import query, rounded
from holdfast.functions import scalars as fn
from holdfast.operators import curves, metrics as m, reports
from holdfast.session import new_folder
from holdfast.sources import artifacts as art


def _labelled(spark, sf, threshold=0.5):
    return fx.scored_orders(spark, sf).withColumn("y_pred", fn.hard_label("y_prob", threshold))


def _labelled_accounts(spark, sf):
    return fx.scored_accounts(spark, sf).withColumn("y_pred", fn.hard_label("y_prob"))


_CELLS = "tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives"


@query("G01_confusion_matrix", f"SELECT {_CELLS} FROM ({q.counts(q.SCORED)})")
def confusion_matrix(spark, sf):
    return m.confusion_counts(_labelled(spark, sf))


@query("G01_confusion_by_segment", f"SELECT segment, {_CELLS} FROM ({q.counts(q.SCORED, 'segment')})")
def confusion_by_segment(spark, sf):
    return m.confusion_counts(_labelled(spark, sf), by=["segment"])


@query("G02_classification_metrics", f"SELECT model, {q.RATES} FROM ({q.counts(q.SCORED, 'model')})")
def classification_metrics(spark, sf):
    return m.classification_metrics(_labelled(spark, sf), by=["model"])


@query("G03_roc_auc", f"SELECT roc_auc, CAST(NULL AS VARCHAR) AS roc_auc_note FROM ({q.auc(q.SCORED)})")
def roc_auc(spark, sf):
    return m.roc_auc(fx.scored_orders(spark, sf))


@query("G03_roc_auc_by_segment", q.auc(q.SCORED, "segment"))
def roc_auc_by_segment(spark, sf):
    return m.roc_auc(fx.scored_orders(spark, sf), by=["segment"]).drop("roc_auc_note")


@query("G04_brier_score", f"""
SELECT segment, round(avg((y_prob - y_true) * (y_prob - y_true)), 8) AS brier_score FROM ({q.SCORED}) GROUP BY 1""")
def brier_score(spark, sf):
    return rounded(m.brier_score(fx.scored_orders(spark, sf), by=["segment"]), 8, "brier_score")


def _sweep_sql(thresholds):
    return f"""
SELECT threshold, precision, recall, f1, CAST(tp AS VARCHAR) || '/' || CAST(tp + fn AS VARCHAR) AS positives_caught,
       fp AS false_alarms FROM (SELECT *, {q.RATES} FROM ({q.sweep(q.SCORED, thresholds)}))"""


@query("G05_threshold_sweep", _sweep_sql([0.3, 0.4, 0.5, 0.6, 0.7]))
def threshold_sweep(spark, sf):
    return m.threshold_sweep(fx.scored_orders(spark, sf))


@query("G05_threshold_sweep_fine", _sweep_sql(m.grid_thresholds()))
def threshold_sweep_fine(spark, sf):
    return m.threshold_sweep(fx.scored_orders(spark, sf), m.grid_thresholds())


@query("G06_calibration_bins", q.calibration(q.SCORED))
def calibration_bins(spark, sf):
    return m.calibration_bins(fx.scored_orders(spark, sf))


@query("G07_calibration_curve", f"""
SELECT {q.bins('y_prob', True)} AS bin_index, CAST(sum(y_true) AS DOUBLE) / count(*) AS positive_share,
       round(avg(y_prob), 8) AS mean_score, count(*) AS "count" FROM ({q.SCORED}) GROUP BY 1""")
def calibration_curve(spark, sf):
    return rounded(m.calibration_curve(fx.scored_orders(spark, sf)), 8, "mean_score")


def _best_sql(metric):
    return f"""
SELECT '{metric}' AS metric, CASE WHEN {metric} > 0 THEN threshold ELSE 0.5e0 END AS threshold,
       CASE WHEN {metric} > 0 THEN {metric} ELSE 0e0 END AS score
FROM (SELECT threshold, {q.RATES} FROM ({q.sweep(q.SCORED, m.grid_thresholds())})) ORDER BY {metric} DESC, threshold LIMIT 1"""


@query("G08_best_threshold", " UNION ALL ".join(f"SELECT * FROM ({_best_sql(x)})" for x in ("f1", "recall", "precision")))
def best_threshold(spark, sf):
    return m.best_threshold(fx.scored_orders(spark, sf), ("f1", "recall", "precision"))


@query("G09_outcome_counts", f"""
SELECT outcome, n, total, CASE WHEN total = 0 THEN 0e0 ELSE n * 100e0 / CAST(total AS DOUBLE) END AS percent
FROM (SELECT unnest(['true_negatives', 'false_positives', 'false_negatives', 'true_positives']) AS outcome,
             unnest([tn, fp, fn, tp]) AS n, tn + fp + fn + tp AS total FROM ({q.counts(q.SCORED)}))""")
def outcome_counts(spark, sf):
    return m.outcome_counts(_labelled(spark, sf))


def _profile_sql(error, base, contract):
    parts = [
        ("mean tenure", "CAST(tenure AS DOUBLE)"),
        (f"share Contract = {contract}", f"""CASE WHEN "Contract" = '{contract}' THEN 1e0 ELSE 0e0 END"""),
        ("share InternetService = Fiber optic", """CASE WHEN "InternetService" = 'Fiber optic' THEN 1e0 ELSE 0e0 END"""),
    ]
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, avg({x}) FILTER (WHERE {error}) AS among_errors,
        avg({x}) FILTER (WHERE {base}) AS among_class, count(*) FILTER (WHERE {error}) AS k FROM src"""
        for name, x in parts
    )
    return f"""WITH src AS (SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS p FROM ({q.SCORED_ACCOUNTS}))
SELECT feature, round(among_errors, 8) AS among_errors, round(among_class, 8) AS among_class FROM ({rows}) WHERE k > 0"""


@query("G10_false_negative_profile", _profile_sql("y_true = 1 AND p = 0", "y_true = 1", "Two year"))
def false_negative_profile(spark, sf):
    return rounded(m.false_negative_profile(_labelled_accounts(spark, sf)), 8, "among_errors", "among_class")


@query("G11_false_positive_profile", _profile_sql("y_true = 0 AND p = 1", "y_true = 0", "Month-to-month"))
def false_positive_profile(spark, sf):
    return rounded(m.false_positive_profile(_labelled_accounts(spark, sf)), 8, "among_errors", "among_class")


_RECORD = ("0.5e0 AS threshold, tn + fp + fn + tp AS n_samples, tp + fn AS n_positive, tp + fp AS n_predicted_positive, "
           f"roc_auc, accuracy, precision, recall, f1, {_CELLS}")


@query("G12_evaluation_record", f"SELECT split, {_RECORD} FROM ({q.evaluation(q.SPLIT_SCORED, 'split')})")
def evaluation_record(spark, sf):
    return m.evaluation_record(fx.split_orders(spark, sf), by=["split"])


@query("G12_evaluation_given_labels", f"""
SELECT segment, {_RECORD} FROM ({q.evaluation(q.SCORED, 'segment', 'CAST(y_prob > 0.5 AS INTEGER)')})""")
def evaluation_given_labels(spark, sf):
    scored = fx.scored_orders(spark, sf).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))
    return m.evaluation_record(scored, y_pred="y_pred", by=["segment"])


@query("G13_compare_models", f"SELECT model, roc_auc, precision, recall, f1 FROM ({q.evaluation(q.SCORED, 'model')})")
def compare_models(spark, sf):
    return m.compare_models(fx.scored_orders(spark, sf))


_NAMES = ", ".join(f"'{x}'" for x in m.METRICS)
_VALUES = ", ".join(m.METRICS)


@query("G14_split_gap", f"""
SELECT metric, validation, test, validation - test AS gap, abs(validation - test) > 0.05 AS exceeds_limit FROM (
  SELECT metric, max(value) FILTER (WHERE split = 'validation') AS validation,
         max(value) FILTER (WHERE split = 'test') AS test
  FROM (SELECT split, unnest([{_NAMES}]) AS metric, unnest([{_VALUES}]) AS value
        FROM ({q.evaluation(q.SPLIT_SCORED, 'split')})) GROUP BY metric)""")
def split_gap(spark, sf):
    return m.split_gap(fx.split_orders(spark, sf))


_SPLIT_MODEL = f"SELECT *, model || '/' || split AS g FROM ({q.SPLIT_SCORED})"


@query("G15_overfit_report", f"""
SELECT model, train_auc, validation_auc, train_auc - validation_auc AS gap,
       CASE WHEN train_auc - validation_auc > 0.05 THEN 'potential overfitting'
            WHEN train_auc - validation_auc < 0.01 THEN 'good generalization' ELSE 'acceptable' END AS verdict
FROM (SELECT split_part(g, '/', 1) AS model, max(roc_auc) FILTER (WHERE g LIKE '%/train') AS train_auc,
             max(roc_auc) FILTER (WHERE g LIKE '%/validation') AS validation_auc
      FROM ({q.auc(_SPLIT_MODEL, 'g')}) GROUP BY 1)""")
def overfit_report(spark, sf):
    return m.overfit_report(fx.split_orders(spark, sf))


@query("G16_business_impact", f"""
SELECT segment, fp AS false_positives, {q.div('fp', 'tn + fp + fn + tp')} AS false_positive_share,
       fn AS false_negatives, {q.div('fn', 'tn + fp + fn + tp')} AS false_negative_share,
       fn * 500e0 + fp * 50e0 AS cost FROM ({q.counts(q.SCORED, 'segment')})""")
def business_impact(spark, sf):
    return m.business_impact(_labelled(spark, sf), by=["segment"])


@query("G17_risk_counts", f"""
SELECT segment, count(*) AS total, count(*) FILTER (WHERE r = 'high') AS high_risk,
       count(*) FILTER (WHERE r = 'medium') AS medium_risk, count(*) FILTER (WHERE r = 'low') AS low_risk
FROM (SELECT segment, {q.RISK.format(p='y_prob')} AS r FROM ({q.SCORED})) GROUP BY segment""")
def risk_counts(spark, sf):
    return m.risk_counts(fx.scored_orders(spark, sf), by=["segment"])


# --- curves ----------------------------------------------------------------------------------

_CAUGHT = f"""
SELECT y_prob, pos, neg, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
       lead(pos) OVER (ORDER BY y_prob DESC) AS next_pos, lead(neg) OVER (ORDER BY y_prob DESC) AS next_neg,
       lag(pos) OVER (ORDER BY y_prob DESC) AS prev_pos
FROM (SELECT y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM ({q.SCORED}) GROUP BY y_prob)
WINDOW w AS (ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING)"""


def _roc_sql(keep):
    return f"""
SELECT CAST(fps AS DOUBLE) / CAST(n AS DOUBLE) AS fpr, CAST(tps AS DOUBLE) / CAST(p AS DOUBLE) AS tpr,
       y_prob AS threshold FROM ({_CAUGHT}) WHERE {keep}
UNION ALL SELECT 0e0, 0e0, CAST('inf' AS DOUBLE) FROM ({q.SCORED}) HAVING count(*) > 0"""


@query("W01_roc_curve", _roc_sql("prev_pos IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"))
def roc_curve(spark, sf):
    return curves.roc_curve(fx.scored_orders(spark, sf))


@query("W01_roc_curve_all_points", _roc_sql("true"))
def roc_curve_all_points(spark, sf):
    return curves.roc_curve(fx.scored_orders(spark, sf), drop_intermediate=False)


@query("W02_precision_recall_curve", f"""
SELECT CAST(tps AS DOUBLE) / CAST(tps + fps AS DOUBLE) AS precision, CAST(tps AS DOUBLE) / CAST(p AS DOUBLE) AS recall,
       y_prob AS threshold FROM ({_CAUGHT})
UNION ALL SELECT 1e0, 0e0, CAST(NULL AS DOUBLE) FROM ({q.SCORED}) HAVING count(*) > 0""")
def precision_recall_curve(spark, sf):
    return curves.precision_recall_curve(fx.scored_orders(spark, sf))


# --- artifacts and reports -------------------------------------------------------------------


@query("S06_metrics_record", f"""
SELECT split AS dataset, tn + fp + fn + tp AS n_samples, roc_auc, accuracy, precision, recall, f1, {_CELLS}
FROM ({q.evaluation(q.SPLIT_SCORED, 'split')}) WHERE split <> 'train'""")
def metrics_record(spark, sf):
    record = art.metrics_record(
        m.evaluation_record(fx.split_orders(spark, sf), by=["split"]), "LogisticRegression", {"C": 1.0}
    )
    path = new_folder(spark, "metrics")
    art.save_metrics(record, path)
    saved = art.load_metrics(spark, path, record)
    parts = saved.select(F.explode(F.array("validation", "test")).alias("r"))
    return parts.select("r.dataset", "r.n_samples", "r.metrics.*", "r.confusion_matrix.*")


def _saved(spark, name, report):
    root = new_folder(spark, "reports")
    art.save_reports({name: report}, root)
    return spark.read.schema(report.schema).json(f"{root}/{name}")


@query("S08_threshold_report", f"""
SELECT CAST(threshold AS VARCHAR) AS threshold, printf('%.2f', precision) AS precision, printf('%.2f', recall) AS recall,
       printf('%.2f', f1) AS f1, positives_caught, false_alarms FROM ({_sweep_sql([0.3, 0.4, 0.5, 0.6, 0.7])})""")
def threshold_report(spark, sf):
    return _saved(spark, "thresholds", reports.threshold_report(fx.scored_orders(spark, sf)))


@query("S08_calibration_report", f"""
SELECT bin, printf('%.2f', actual_rate) AS actual_rate, "count",
       CASE WHEN gap >= 0 THEN '+' ELSE '' END || printf('%.2f', gap) AS gap FROM ({q.calibration(q.SCORED)})""")
def calibration_report(spark, sf):
    return _saved(spark, "calibration", reports.calibration_report(fx.scored_orders(spark, sf)))


@query("S08_error_report", f"""
SELECT outcome, n, printf('%.1f%%', n * 100e0 / CAST(total AS DOUBLE)) AS percent
FROM (SELECT unnest(['true_negatives', 'false_positives', 'false_negatives', 'true_positives']) AS outcome,
             unnest([tn, fp, fn, tp]) AS n, tn + fp + fn + tp AS total FROM ({q.counts(q.SCORED)}))""")
def error_report(spark, sf):
    return _saved(spark, "errors", reports.error_report(_labelled(spark, sf)))


def _shown(c):
    return (f"CASE WHEN feature LIKE 'mean %' THEN printf('%.1f', {c}) ELSE printf('%.0f%%', {c} * 100e0) END AS {c}")


@query("S08_profile_report", f"""
SELECT feature, {_shown('among_errors')}, {_shown('among_class')}
FROM ({_profile_sql("y_true = 1 AND p = 0", "y_true = 1", "Two year")})""")
def profile_report(spark, sf):
    return _saved(spark, "profile", reports.profile_report(m.false_negative_profile(_labelled_accounts(spark, sf))))
