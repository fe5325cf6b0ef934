"""Rows that have no place in a metric fail the job; names and categories of any kind."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from holdfast.operators import metrics as m
from holdfast.operators import preprocess as pp
from holdfast.operators.models import scoring_record
from holdfast.sources.accounts import read_csv
from holdfast.spec import FeatureSpec

BAD = [(None, 0.5, 1.0), (2.0, 0.5, 1.0), (0.5, 0.5, 1.0), (1.0, None, 1.0), (1.0, float("nan"), 1.0), (1.0, 0.5, None), (1.0, 0.5, 2.0)]
OPERATORS = {
    "confusion": (lambda d: m.confusion_counts(d), (0, 2)), "metrics": (lambda d: m.classification_metrics(d), (0, 2)),
    "outcomes": (lambda d: m.outcome_counts(d), (0, 2)), "impact": (lambda d: m.business_impact(d), (0, 2)),
    "misses": (lambda d: m.false_negative_profile(d), (0, 2)), "alarms": (lambda d: m.false_positive_profile(d), (0, 2)),
    "auc": (lambda d: m.roc_auc(d), (0, 1)), "brier": (lambda d: m.brier_score(d), (0, 1)),
    "record": (lambda d: m.evaluation_record(d, y_pred="y_pred"), (0, 1, 2)), "sweep": (lambda d: m.threshold_sweep(d), (0, 1)),
    "risk": (lambda d: m.risk_counts(d), (1,)), "response": (lambda d: scoring_record(d), (1,)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_bad_rows_fail(spark, name):
    run, reads = OPERATORS[name]
    good = [(1.0, 0.9, 1.0), (0.0, 0.2, 0.0), (1.0, 0.4, 0.0), (0.0, 0.6, 1.0)]
    schema = "y_true double, y_prob double, y_pred double"
    assert run(spark.createDataFrame(good, schema)).collect()
    for bad in BAD:
        wrong = [i for i, (x, y) in enumerate(zip(bad, (1.0, 0.5, 1.0))) if x != y]
        if wrong[0] in reads:
            with pytest.raises(PySparkException):
                run(spark.createDataFrame([*good, bad], schema)).collect()


@pytest.mark.parametrize("plain", [1, 50])
def test_vector_of_any_category_text(spark, monkeypatch, plain):
    monkeypatch.setattr(pp, "PLAIN_SLOTS", plain)
    texts = ["Dr. X", "a`b", "c'd", "", "1.0", "é"]
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(texts)], "c string, x double")
    fitted = pp.fit_preprocessor(df, FeatureSpec(numeric=("x",), binary=(), categorical=("c",)))
    out = fitted.pipeline(df).transform(df).select("features", "c").collect()
    names = fitted.feature_names()
    for r in out:
        assert [n for n, v in zip(names[1:], r["features"].toArray()[1:]) if v] == [f"{fitted.spec.categorical_prefix}__c_{r['c']}"]


def test_categories_are_complete_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(pp, "MAX_CATEGORIES", 10)
    df = spark.range(3000).select(
        F.format_string("Clerk#%09d", (F.col("id") * 7 % 2000).cast("int")).alias("t"), (F.col("id") % 900 - 450).alias("n"),
        F.lit("one").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") / 7).alias("d"))
    got = {}
    for r in pp.categories(df, ["t", "n", "k", "d"]).collect():
        got.setdefault(r["feature"], {})[r["position"]] = r["value"]
    assert [got["t"][i] for i in range(2000)] == [f"Clerk#{i:09d}" for i in range(2000)]
    assert [int(got["n"][i]) for i in range(900)] == list(range(-450, 450))
    assert got["k"] == {0: "one"}
    numbers = [float(got["d"][i]) for i in range(1500)]
    assert numbers == sorted(numbers) and len(got["d"]) == 1500


def test_files_with_other_headers_fail(spark, folder):
    path = folder("csv")
    spark.createDataFrame([("1", "Yes")], "customerID string, Churn string").coalesce(1).write.option("header", True).csv(path)
    spark.createDataFrame([("No", "2")], "Churn string, customerID string").coalesce(1).write.option("header", True).mode(
        "append").csv(path)
    with pytest.raises(Exception, match="header"):
        read_csv(spark, path).collect()
