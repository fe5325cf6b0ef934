import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

import fixtures as fx
from conftest import SF, plan, rows
from holdfast.operators import curves, metrics as m, ranking
from holdfast.functions import scalars as fn

SCHEMA = "y_true int, y_prob double"


def scored(spark, y_true, y_prob, y_pred=None):
    cols = [y_true, y_prob] + ([y_pred] if y_pred else [])
    return spark.createDataFrame(list(zip(*cols)), SCHEMA + (", y_pred int" if y_pred else ""))


def five(spark):
    return scored(spark, [0, 0, 1, 1, 1], [0.2, 0.6, 0.8, 0.9, 0.3], [0, 1, 1, 1, 0])


def brute_auc(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, t in zip(p, y) if t for b, u in zip(p, y) if not u]
    return sum(pairs) / len(pairs)


def test_metrics_of_five_rows(spark):
    got = m.classification_metrics(five(spark)).first()
    assert [got["precision"], got["recall"], got["f1"]] == pytest.approx([2 / 3] * 3)
    assert got["accuracy"] == 0.6
    assert m.roc_auc(five(spark)).first()["roc_auc"] == pytest.approx(5 / 6)


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0)], "y_true int, y_pred int")
    assert tuple(m.confusion_counts(df).first()) == (2, 1, 1, 1)
    assert tuple(m.confusion_counts(df.where("y_true = 1")).first()) == (0, 0, 1, 1)
    assert tuple(m.classification_metrics(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_one_class_has_no_auc(spark):
    got = m.roc_auc(scored(spark, [1, 1], [0.1, 0.2])).first()
    assert got["roc_auc"] is None and got["roc_auc_note"] == "only one class"


@pytest.mark.parametrize("prob", [None, float("nan")])
def test_missing_scores_raise(spark, prob):
    df = spark.createDataFrame([(1, prob), (0, 0.5)], SCHEMA)
    with pytest.raises(Exception, match="no score"):
        m.brier_score(df).collect()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12)), min_size=4, max_size=60), st.sampled_from([2, 5, 1000]))
def test_auc_matches_pairs_in_any_bucketing(spark, data, size):
    data = data + [(0, 3), (1, 3)]
    y, p = [t for t, _ in data], [v / 12 for _, v in data]
    old = ranking.ROWS_PER_BUCKET
    ranking.ROWS_PER_BUCKET = size
    try:
        got = m.roc_auc(scored(spark, y, p)).first()["roc_auc"]
    finally:
        ranking.ROWS_PER_BUCKET = old
    assert got == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_auc_matches_the_evaluator(spark):
    df = fx.scored_orders(spark, SF)
    check = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol="y_true", numBins=0)
    assert m.roc_auc(df).first()["roc_auc"] == pytest.approx(check.evaluate(df.withColumn("y_true", F.col("y_true").cast("double"))), abs=1e-12)


def test_results_do_not_depend_on_partitions_or_buckets(spark, monkeypatch):
    df = fx.scored_orders(spark, SF)
    first = None
    for parts, size in ((1, 10**6), (7, 50), (64, 200)):
        monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", size)
        part = df.repartition(parts)
        got = (rows(m.evaluation_record(part, by=["model"])), rows(curves.roc_curve(part, by=["model"])),
               rows(curves.roc_curve(part)), rows(curves.precision_recall_curve(part)), rows(m.best_threshold(part)))
        first = first or got
        assert got == first


def test_groups_with_null_keys_are_kept(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 10)
    df = fx.scored_orders(spark, SF).withColumn("g", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")))
    got = {r["g"]: r for r in m.evaluation_record(df, by=["g"]).collect()}
    assert set(got) == {None, "1", "2"} and sum(r["n_samples"] for r in got.values()) == df.count()
    alone = m.evaluation_record(df.where("g is null")).first()
    assert got[None]["roc_auc"] == alone["roc_auc"]


def test_a_hot_score_and_clustered_scores(spark, monkeypatch):
    """A third of the rows share one score, the rest lie within a millionth of each other."""
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 40)
    df = spark.range(900).select(
        (F.col("id") * 7 % 5 < 2).cast("int").alias("y_true"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.5 + (F.col("id") * 37 % 1000) * 1e-9).alias("y_prob"))
    data = df.collect()
    assert m.roc_auc(df).first()["roc_auc"] == pytest.approx(brute_auc([r[0] for r in data], [r[1] for r in data]), abs=1e-12)


def test_no_global_sort_and_no_python(spark, monkeypatch):
    df = fx.scored_orders(spark, SF)
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 100)
    for frame in (m.roc_auc(df), m.evaluation_record(df), curves.roc_curve(df), curves.precision_recall_curve(df)):
        text = plan(frame)
        assert "Python" not in text and "Pandas" not in text
        single = [i for i, line in enumerate(text.splitlines()) if "Exchange SinglePartition" in line]
        for i in single:
            below = "\n".join(text.splitlines()[i + 1:i + 4])
            assert "Aggregate" in below or "Join" in below, below
        assert "Window [" in text and "__bucket" in text


def test_sweep_and_counts(spark):
    got = {r["threshold"]: r for r in m.threshold_sweep(five(spark), [0.3, 0.85, 0.95]).collect()}
    assert (got[0.3]["positives_caught"], got[0.3]["false_alarms"]) == ("3/3", 1)
    assert (got[0.85]["positives_caught"], got[0.85]["precision"]) == ("1/3", 1.0)
    assert (got[0.95]["positives_caught"], got[0.95]["f1"], got[0.95]["precision"]) == ("0/3", 0.0, 0.0)
    both = m.threshold_sweep(five(spark), [0.5, 0.5])
    assert both.count() == 2


def test_sweep_agrees_with_direct_counts(spark):
    df = fx.scored_orders(spark, SF)
    for r in m.threshold_sweep(df, m.grid_thresholds()[::13]).collect():
        direct = m.classification_metrics(df.withColumn("y_pred", fn.hard_label("y_prob", r["threshold"]))).first()
        assert (r["precision"], r["recall"], r["f1"]) == (direct["precision"], direct["recall"], direct["f1"])


def test_best_threshold(spark):
    got = m.best_threshold(five(spark), "recall").first()
    assert (got["threshold"], got["score"]) == (0.1, 1.0)
    none = m.best_threshold(scored(spark, [0, 0], [0.2, 0.9])).first()
    assert (none["threshold"], none["score"]) == (0.5, 0.0)
    with pytest.raises(ValueError, match="unknown metric"):
        m.best_threshold(five(spark), "accuracy")
    assert len(m.grid_thresholds()) == 80 and m.grid_thresholds()[55] == 0.6499999999999997


def test_calibration_edges(spark):
    probs = [0.0, 0.1, 0.3, 0.30000000000000004, 0.5, 0.9999, 1.0]
    df = scored(spark, [1] * len(probs), probs)
    edges = np.linspace(0, 1, 11)
    wanted = np.clip(np.digitize(probs, edges) - 1, 0, 9)
    got = {r["bin_index"]: r["count"] for r in m.calibration_bins(df).collect()}
    assert got == {int(b): int((wanted == b).sum()) for b in set(wanted)}
    right = np.searchsorted(edges[1:-1], probs)
    got = {r["bin_index"]: r["count"] for r in m.calibration_curve(df).collect()}
    assert got == {int(b): int((right == b).sum()) for b in set(right)}
    outside = scored(spark, [1, 0], [-0.5, 1.5])
    assert rows(m.calibration_bins(outside), "bin_index") == [(0,), (9,)]
    with pytest.raises(Exception, match=r"\[0, 1\]"):
        m.calibration_curve(outside).collect()


def test_roc_curve_shape(spark):
    got = curves.roc_curve(five(spark), drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    assert [r["threshold"] for r in got] == [float("inf"), 0.9, 0.8, 0.6, 0.3, 0.2]
    assert [r["tpr"] for r in got] == pytest.approx([0, 1 / 3, 2 / 3, 2 / 3, 1, 1])
    assert [r["fpr"] for r in got] == pytest.approx([0, 0, 0, 0.5, 0.5, 1])
    short = curves.roc_curve(five(spark)).orderBy(F.desc("threshold")).collect()
    assert [r["threshold"] for r in short] == [float("inf"), 0.9, 0.8, 0.6, 0.3, 0.2][:1] + [0.9, 0.8, 0.6, 0.3, 0.2]


def test_precision_recall_curve_shape(spark):
    got = rows(curves.precision_recall_curve(five(spark)))
    assert (1.0, 0.0, None) in got and len(got) == 6
    assert (0.6, 1.0, 0.2) in got


def test_comparison_order(spark):
    data = [("worse", 1, 0.4), ("worse", 0, 0.6), ("better", 1, 0.9), ("better", 0, 0.1), ("also", 1, 0.9), ("also", 0, 0.1)]
    df = spark.createDataFrame(data, "model string, y_true int, y_prob double")
    assert [r["model"] for r in m.compare_models(df).collect()] == ["also", "better", "worse"]


def test_gaps_and_verdicts(spark):
    data = [("train", 1, 0.9), ("train", 0, 0.1), ("validation", 1, 0.2), ("validation", 0, 0.8), ("test", 1, 0.9), ("test", 0, 0.1)]
    df = spark.createDataFrame(data, "split string, y_true int, y_prob double").withColumn("model", F.lit("a"))
    gaps = {r["metric"]: r for r in m.split_gap(df).collect()}
    assert gaps["roc_auc"]["gap"] == -1.0 and gaps["roc_auc"]["exceeds_limit"]
    assert m.overfit_report(df).first()["verdict"] == "potential overfitting"
    same = df.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise(F.col("split"))).where(
        "not (split = 'validation' and y_prob in (0.2, 0.8))")
    assert m.overfit_report(same).first()["verdict"] == "good generalization"


def test_profiles(spark):
    data = [(1, 0, 10, "Two year"), (1, 1, 2, "One year"), (0, 1, 4, None), (0, 0, 6, "Month-to-month")]
    df = spark.createDataFrame(data, "y_true int, y_pred int, tenure int, Contract string")
    got = {r["feature"]: r for r in m.false_negative_profile(df).collect()}
    assert (got["mean tenure"]["among_errors"], got["mean tenure"]["among_class"]) == (10.0, 6.0)
    assert got["share Contract = Two year"]["among_class"] == 0.5
    assert got["share InternetService = Fiber optic"]["among_errors"] is None
    got = {r["feature"]: r for r in m.false_positive_profile(df).collect()}
    assert got["share Contract = Month-to-month"]["among_errors"] == 0.0
    assert m.false_negative_profile(df.where("y_true = 0")).count() == 0


def test_impact_and_risk(spark):
    got = m.business_impact(five(spark)).first()
    assert got["cost"] == 550.0 and got["false_positive_share"] == 0.2
    assert tuple(m.risk_counts(five(spark)).first()) == (5, 2, 1, 2)
    assert tuple(m.risk_counts(five(spark).limit(0)).first()) == (0, 0, 0, 0)
    assert {r["outcome"]: r["n"] for r in m.outcome_counts(five(spark)).collect()}["true_positives"] == 2
