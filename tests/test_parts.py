"""Models are fitted on rows in few parts: each step of a fit sends the driver a result per part."""

import pytest
from pyspark.sql import functions as F

from holdfast.operators import models as md
from holdfast.operators import preprocess as pp
from holdfast.plans import training
from holdfast.spec import ACCOUNT_COLUMNS, FeatureSpec


class Seen(Exception):
    pass


def see(df, *args, **kwargs):
    raise Seen(df.rdd.getNumPartitions(), df.schema["features"].metadata, df.select("features", "label").collect())


def test_pipeline_is_fitted_on_few_parts(spark, monkeypatch):
    train = spark.range(200).selectExpr(
        "concat('C', id) as k", "cast(id % 2 as double) as label", "cast(id as double) as x", "concat('v', id % 40) as c").repartition(40)
    spec = FeatureSpec(numeric=("x",), categorical=("c",), id_cols=("k",))
    monkeypatch.setitem(md.CANDIDATES, "logistic_regression", md.Candidate("", see))
    with pytest.raises(Seen) as got:
        md.fit_pipeline(train, spec)
    parts, metadata, rows = got.value.args
    want = pp.fit_preprocessor(train, spec).pipeline(train).transform(train)
    assert parts <= 10
    assert metadata == want.schema["features"].metadata and metadata  # trees read from it which features are flags
    assert sorted(rows, key=repr) == sorted(want.select("features", "label").collect(), key=repr)


def test_candidates_are_fitted_on_few_parts(spark, monkeypatch):
    numbers = {"SeniorCitizen": (F.col("id") % 2).cast("int"), "tenure": (F.col("id") % 60 + 1).cast("int"),
               "MonthlyCharges": F.col("id").cast("double"), "TotalCharges": F.col("id").cast("string"),
               "customerID": F.format_string("C%05d", "id"), "Churn": F.when(F.col("id") % 3 == 0, "Yes").otherwise("No")}
    text = F.when(F.col("id") % 2 == 0, "Yes").otherwise("No")
    raw = spark.range(300).repartition(40).select(*[numbers.get(c, text).alias(c) for c in ACCOUNT_COLUMNS])
    monkeypatch.setattr(md, "train_candidates", see)
    with pytest.raises(Seen) as got:
        training.train_candidates(raw)
    parts, _, rows = got.value.args
    assert parts <= 10 and len(rows) == 180
