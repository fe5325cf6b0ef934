import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan, rows
from holdfast.operators import split as sp


@pytest.fixture(scope="module")
def thousand(spark):
    df = spark.range(1000).withColumn("customerID", F.format_string("CUST%05d", "id"))
    return df.withColumn("Churn", (F.col("id") % 10 < 3).cast("int")).drop("id").persist()


def sizes(df):
    return dict(rows(df.groupBy("split").count()))


def test_sizes_and_rates(thousand):
    got = sp.stratified_split(thousand, "Churn", "customerID")
    assert sizes(got) == {"train": 600, "validation": 200, "test": 200}
    for _, rate in rows(got.groupBy("split").agg(F.avg("Churn"))):
        assert math.isclose(rate, 0.3, abs_tol=0.005)


def test_same_seed_same_rows_whatever_the_partitions(thousand):
    first = rows(sp.stratified_split(thousand.repartition(1), "Churn", "customerID"), "customerID", "split")
    for n in (7, 64):
        again = sp.stratified_split(thousand.repartition(n), "Churn", "customerID")
        assert rows(again, "customerID", "split") == first
    other = sp.stratified_split(thousand, "Churn", "customerID", seed=7)
    assert rows(other, "customerID", "split") != first


def test_levels_agree(thousand, monkeypatch):
    cuts = sp.fit_splits(thousand, "Churn", "customerID")
    monkeypatch.setattr(sp, "SMALL_BUCKET", 0)
    assert sp.fit_splits(thousand, "Churn", "customerID") == cuts


def test_ratios_must_sum_to_one(thousand):
    with pytest.raises(ValueError, match="sum to 1"):
        sp.fit_splits(thousand, "Churn", "customerID", 0.5, 0.2, 0.2)


def test_tiny_classes_and_nulls_raise(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "id string, y int")
    with pytest.raises(ValueError, match="fewer than 2"):
        sp.fit_splits(df, "y", "id")
    with pytest.raises(ValueError, match="null"):
        sp.fit_splits(df.withColumn("y", F.lit(None).cast("int")), "y", "id")
    with pytest.raises(ValueError, match="empty"):
        sp.fit_splits(df.limit(0), "y", "id")


def test_size_arithmetic():
    assert sp.split_sizes([799, 701], 0.70, 0.15, 0.15) and [
        sum(p) for p in zip(*sp.split_sizes([799, 701], 0.70, 0.15, 0.15))] == [1049, 226, 225]
    assert [sum(p) for p in zip(*sp.split_sizes([5174, 1869], 0.70, 0.15, 0.15))] == [4929, 1057, 1057]
    assert [sum(p) for p in zip(*sp.split_sizes([5174, 1869], 0.6, 0.2, 0.2))] == [4225, 1409, 1409]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(2, 10_000), min_size=1, max_size=6), st.sampled_from([(0.6, 0.2, 0.2), (0.7, 0.15, 0.15)]))
def test_sizes_add_up(counts, ratios):
    parts = sp.split_sizes(counts, *ratios)
    assert [sum(p) for p in parts] == counts
    assert all(x >= 0 for p in parts for x in p)
    assert sum(p[2] for p in parts) == math.ceil(sum(counts) * ratios[2])


def test_assigning_moves_no_row(thousand):
    text = plan(sp.stratified_split(thousand, "Churn", "customerID"))
    assert "Exchange" not in text and "Join" not in text and "Window" not in text


def test_copies_of_an_id_stay_together(spark):
    """A third of all rows carry one id."""
    df = spark.range(900).select(
        F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("id"),
        (F.col("id") % 2).cast("int").alias("y"), F.col("id").alias("row"))
    got = sp.stratified_split(df, "y", "id").persist()
    assert got.count() == 900 and got.where("split is null").count() == 0
    assert got.where("id = 'hot'").select("y", "split").distinct().count() == 2
    # Told apart by another column, the sizes are exact.
    exact = sp.stratified_split(df, "y", "id", tie_cols=["row"])
    assert sizes(exact) == {"train": 540, "validation": 180, "test": 180}


def test_leakage(spark):
    def table(**parts):
        data = [(i, s) for s, ids in parts.items() for i in ids]
        return spark.createDataFrame(data, "id string, split string")

    clean = table(train="AABC", validation="DE", test="FG")
    assert sp.require_no_leakage(clean, "id") is clean
    with pytest.raises(ValueError, match="train-validation overlap: 1"):
        sp.require_no_leakage(table(train="ABC", validation="CDCC", test="EF"), "id")
    with pytest.raises(ValueError, match="train-test overlap: 1"):
        sp.require_no_leakage(table(train="ABC", validation="DE", test="AF"), "id")
    both = table(train="AB", validation="AX", test="AX")
    assert tuple(sp.leakage_counts(both, "id").first()) == (1, 1, 2)


def test_summary(thousand):
    got = {r["split"]: r for r in sp.split_summary(sp.stratified_split(thousand, "Churn", "customerID"), "Churn").collect()}
    assert got["train"]["n"] == 600 and got["train"]["n_positive"] == 180
    assert got["train"]["positive_rate"] == 30.0 and got["test"]["share"] == 20.0 and got["test"]["n_total"] == 1000


def test_early_stopping_indicator(thousand):
    got = sp.early_stopping_indicator(thousand, "Churn", "customerID")
    assert rows(got.groupBy("is_valid", "Churn").count()) == [(False, 0, 630), (False, 1, 270), (True, 0, 70), (True, 1, 30)]


def many_classes(spark, classes=5000):
    """Classes of 2 to 9 rows, one with a third of all rows, ids that repeat."""
    small = spark.range(classes * 4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), (F.col("id") % classes).alias("y"))
    large = spark.range(classes * 2).select(F.concat(F.lit("h"), (F.col("id") % 9000).cast("string")).alias("id"), F.lit(7).cast("long").alias("y"))
    return small.union(large)


@pytest.mark.parametrize("small", [0, 2_000_000])
def test_tables_cut_as_the_driver_does(spark, monkeypatch, small):
    df = many_classes(spark, 40).where("id not like 'h%' or y = 7").persist()
    monkeypatch.setattr(sp, "LISTED_CLASSES", 100)
    want, cuts = rows(sp.stratified_split(df, "y", "id")), sp.fit_splits(df, "y", "id")
    monkeypatch.setattr(sp, "LISTED_CLASSES", 1)
    monkeypatch.setattr(sp, "SMALL_BUCKET", small)
    got = sp.fit_splits(df, "y", "id")
    assert isinstance(got, sp.SplitTable) and isinstance(cuts, sp.SplitCuts)
    assert rows(got.assign(df)) == want
    assert rows(got.cuts) == sorted(cuts.cuts, key=repr)
    assert rows(got.sizes, "cls", "n_train", "n_validation", "n_test") == sorted(cuts.sizes, key=repr)
    monkeypatch.setattr(sp, "BROADCAST_CLASSES", 0)
    assert rows(got.assign(df)) == want


def test_five_thousand_classes_have_exact_sizes(spark, monkeypatch):
    df = many_classes(spark).persist()
    collected, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(len(out := plain(self))) or out)
    monkeypatch.setattr(sp, "DIGITS", 1)  # else the first look at the counts holds as many rows as 16 classes may have
    cuts = sp.fit_splits(df, "y", "id", 0.7, 0.15, 0.15)
    monkeypatch.undo()
    assert max(collected) <= 16 * 16 + 1
    out = cuts.assign(df)
    counts = {y: n for y, n in rows(df.groupBy("y").count())}
    want = dict(zip(sorted(counts), sp.split_sizes([counts[y] for y in sorted(counts)], 0.7, 0.15, 0.15)))
    assert {r["cls"]: (r["n_train"], r["n_validation"], r["n_test"]) for r in cuts.sizes.collect()} == want
    got = {}
    for y, part, n in rows(out.where("y <> 7").groupBy("y", "split").count()):
        got.setdefault(y, {})[part] = n
    for y, (a, b, c) in want.items():
        if y != 7:  # ids of class 7 repeat and stay together
            assert got[y] == {k: v for k, v in (("train", a), ("validation", b), ("test", c)) if v}
    assert out.where("split is null").isEmpty()
    assert out.where("y = 7").groupBy("id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()


def test_many_classes_raise_as_few_do(spark):
    df = many_classes(spark, 50)
    one = spark.createDataFrame([("z", 999)], "id string, y long")
    with pytest.raises(ValueError, match="fewer than 2"):
        sp.fit_splits(df.union(one), "y", "id")
    for bad in ((None, 5), ("z", None)):
        with pytest.raises(ValueError, match="null"):
            sp.fit_splits(df.union(spark.createDataFrame([bad, bad], "id string, y long")), "y", "id")
