import math
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import fixtures as fx
from conftest import SF, plan, rows
from holdfast.functions import scalars as fn
from holdfast.operators import models as md, preprocess as pp, ranking
from holdfast.operators.clean import prepare
from holdfast.sources import artifacts as art
from holdfast.spec import BASELINE, GROUPED, FeatureSpec

SPEC = FeatureSpec(numeric=("x",), binary=("b",), categorical=("c",), id_cols=("id",))


def frame(spark, data):
    return spark.createDataFrame(data, "id int, x double, b string, c string")


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, [(1, 1.0, "Yes", "q"), (2, 2.0, "No", "p"), (3, None, None, "q"), (4, 4.0, "Yes", None), (5, 3.0, "odd", "r")])


def test_learned_values(small):
    got = {(r["feature"], r["param"], r["position"]): (r["number"], r["text"]) for r in pp.fit_params(small, SPEC).collect()}
    assert got["x", "median", 0] == (2.5, None) and got["x", "n_missing", 0] == (1.0, None)
    filled = [1.0, 2.0, 2.5, 4.0, 3.0]
    assert got["x", "mean", 0][0] == pytest.approx(statistics.fmean(filled))
    assert got["x", "std", 0][0] == pytest.approx(statistics.pstdev(filled))
    assert got["b", "mode", 0] == (2.0, "Yes") and got["b", "unmapped_count", 0] == (1.0, None)
    assert got["c", "mode", 0] == (2.0, "q")
    assert [got["c", "category", i][1] for i in range(3)] == ["p", "q", "r"]


def test_transform(small):
    model = pp.fit_preprocessor(small, SPEC)
    assert model.feature_names() == ["numeric__x", "binary__b", "categorical__c_p", "categorical__c_q", "categorical__c_r"]
    got = model.transform(small, ["id"]).orderBy("id").collect()
    assert [r["binary__b"] for r in got] == [1.0, 0.0, 1.0, 1.0, 0.0]
    assert [r["categorical__c_q"] for r in got] == [1.0, 0.0, 1.0, 1.0, 0.0]
    assert got[2]["numeric__x"] == pytest.approx(0.0)


def test_unseen_categories_are_zero(spark, small):
    model = pp.fit_preprocessor(small, SPEC)
    new = frame(spark, [(9, float("nan"), "Yes", "never")])
    assert list(model.transform(new).first())[2:] == [0.0, 0.0, 0.0]
    assert model.transform(new).first()["numeric__x"] == pytest.approx(0.0)


@pytest.mark.parametrize("plain", [0, 1, 32])
def test_vector_equals_columns(small, monkeypatch, plain):
    monkeypatch.setattr(pp, "PLAIN_SLOTS", plain)
    for drop in (False, True):
        spec = FeatureSpec(numeric=("x",), categorical=("c", "b"), id_cols=("id",), drop_if_binary=drop)
        train = small.where("b is null or b <> 'odd'")
        model = pp.fit_preprocessor(train, spec)
        wide = [tuple(r)[1:] for r in model.transform(small, ["id"]).orderBy("id").collect()]
        vector = model.pipeline(small).transform(small).orderBy("id").select(vector_to_array("features"))
        assert [tuple(r[0]) for r in vector.collect()] == wide
        assert len(model.feature_names()) == len(wide[0]) == (3 if drop else 5)


def test_two_values_keep_the_second(small):
    spec = FeatureSpec(categorical=("b",), id_cols=("id",), drop_if_binary=True)
    model = pp.fit_preprocessor(small.where("b <> 'odd'"), spec)
    assert model.feature_names() == ["categorical__b_Yes"]


def test_numbers_as_categories_sort_by_size(spark):
    df = spark.createDataFrame([(10,), (2,), (10,), (2,)], "n int")
    model = pp.fit_preprocessor(df, FeatureSpec(categorical=("n",)))
    assert model.levels["n"] == ("2", "10") and model.mode["n"] == "2"


def test_an_id_is_no_table_of_columns(spark, monkeypatch):
    monkeypatch.setattr(pp, "MAX_CATEGORIES", 50)
    df = spark.range(51).select(F.col("id").cast("string").alias("c"))
    model = pp.fit_preprocessor(df, FeatureSpec(categorical=("c",)))
    assert model.levels == {} and model.large["c"].size == 51
    for refuse in (model.transform, model.stages, lambda df: model.feature_names()):
        with pytest.raises(ValueError, match="51 categories"):
            refuse(df)
    assert len(pp.fit_preprocessor(df.where("id < 50"), FeatureSpec(categorical=("c",))).levels["c"]) == 50


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_joined_slots_equal_listed_ones(small, monkeypatch, most):
    monkeypatch.setattr(pp, "DICTIONARY_BYTES", most)
    for spec in (SPEC, FeatureSpec(categorical=("c",)), FeatureSpec(numeric=("x",), categorical=("b", "c"), id_cols=("id",))):
        train = small.where("id <> 5")
        plain, joined = pp.fit_preprocessor(train, spec), pp.fit_preprocessor(train, spec, listed=1)
        assert set(joined.large) == set(spec.categorical) and not plain.large
        want = plain.assemble(small).orderBy("id").select("id", vector_to_array("features")).collect()
        assert joined.assemble(small).orderBy("id").select("id", vector_to_array("features")).collect() == want
        assert rows(pp.schema_table(joined, small)) == rows(pp.schema_table(plain, small))
        assert joined.assemble(small).columns == [*small.columns, "features"]


def test_a_slot_between_others_keeps_its_place(spark):
    df = spark.createDataFrame([("a", "p", "x", 1.0), ("b", "q", "y", 2.0), ("c", "p", "z", 3.0), (None, "q", "x", 4.0)],
                               "a string, b string, c string, n double")
    spec = FeatureSpec(numeric=("n",), categorical=("a", "b", "c"))
    joined, plain = pp.fit_preprocessor(df, spec, listed=2), pp.fit_preprocessor(df, spec)
    assert set(joined.large) == {"a", "c"}
    assert rows(joined.assemble(df).select("n", vector_to_array("features"))) == rows(
        plain.assemble(df).select("n", vector_to_array("features")))


def test_many_categories_are_saved_loaded_and_scored(spark, folder):
    df = spark.range(2500).select(
        "id", F.format_string("https://h/%d", F.col("id") % 1200).alias("url"), (F.col("id") % 5).cast("double").alias("x"),
        (F.col("id") % 2).cast("double").alias("label"))
    spec = FeatureSpec(numeric=("x",), categorical=("url",), id_cols=("id",))
    listed, joined = (md.fit_pipeline(df, spec, listed=n, max_iter=5) for n in (2000, 100))
    loaded = art.load_pipeline(spark, art.save_pipeline(joined, folder("pipeline")))
    assert set(loaded.preprocessor.large) == {"url"} and not listed.preprocessor.large
    want = rows(listed.score(df, ["id"]))
    for got in (rows(joined.score(df, ["id"])), rows(loaded.score(df, ["id"]))):
        assert [(i, y) for i, _, y in got] == [(i, y) for i, _, y in want]
        assert [p for _, p, _ in got] == pytest.approx([p for _, p, _ in want], abs=1e-9)
    again = art.load_pipeline(spark, art.save_pipeline(listed, folder("listed")))
    assert rows(again.score(df, ["id"])) == want


def largest_task(monkeypatch, df, group):
    """Rows of the fullest bucket, and the positions."""
    found = []
    plain = ranking.W.partitionBy
    monkeypatch.setattr(ranking.W, "partitionBy", lambda *c: found.append(c) or plain(*c))
    out = ranking.positions(df, "feature", ["o", "value"])
    monkeypatch.undo()
    assert (group, "__bucket") in found
    return out


@pytest.mark.parametrize("values", [
    [f"https://h/{i}" for i in range(20000)] + ["A"], [float(i) for i in range(20000)] + [1e12], ["k" * 250 + f"{i:05}" for i in range(9000)]])
def test_no_task_orders_a_whole_column(spark, monkeypatch, values):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 1000)
    kind = "double" if isinstance(values[0], float) else "string"
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}").repartition(8)
    counts = pp._ordered_counts(df, ["c"])
    counts = counts.withColumn("feature", F.lit("c"))
    out = largest_task(monkeypatch, pp.written(counts, "counts"), "feature")
    ordered = [r["value"] for r in out.orderBy("position").collect()]
    key = float if kind == "double" else str
    assert [key(v) for v in ordered] == sorted(values)
    cuts = ranking._quantile_cuts(counts, "feature", ["o", "value"], {"c": len(values) // 1000}, {"c": len(values)}).first()["cuts"]
    sizes, at = [], [(k["o"] if kind == "double" else k["value"]) for k in cuts]
    for low, high in zip([None, *at], [*at, None]):
        sizes.append(sum((low is None or v >= low) and (high is None or v < high) for v in values))
    if len(values) > 9000:
        assert len(at) > 10 and max(sizes) < 4000


def test_params_read_their_input_once(spark, small):
    """One scan for the texts, whatever is learned from them; numbers are read for moments and medians."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = small.select("id", "b", "c").mapInArrow(count, "id int, b string, c string")
    pp.fit_preprocessor(texts, FeatureSpec(binary=("b",), categorical=("c",), id_cols=("id",)))
    assert seen.value == 5


def test_numbers_have_one_text_in_any_type(spark):
    fit = spark.createDataFrame([(0,), (1,), (2,), (10000000,)], "n int")
    model = pp.fit_preprocessor(fit, FeatureSpec(categorical=("n",)))
    stages = model.pipeline(fit)
    for kind in ("double", "float", "long", "decimal(20,4)", "decimal(10,0)", "string", "short"):
        got = fit.where("n < 30000" if kind == "short" else "true").select(F.col("n").cast(kind))
        for r in model.transform(got).collect():
            assert sum(r) == 1.0
        assert [sum(r["features"].toArray()) for r in stages.transform(got).collect()] == [1.0] * got.count()
    back = pp.fit_preprocessor(fit.select(F.col("n").cast("double")), FeatureSpec(categorical=("n",)))
    assert back.levels == model.levels == {"n": ("0", "1", "2", "10000000")}
    odd = spark.createDataFrame([(1.5,), (-0.0,), (float("inf"),), (1e300,), (None,)], "n double")
    assert [r[0] for r in odd.select(F.expr(fn.category_text("n"))).collect()] == ["1.5", "0", "Infinity", "1.0E300", None]
    exact = spark.createDataFrame([("1.50",), ("1.00",), ("100.00",), ("-0.10",)], "n string").select(F.col("n").cast("decimal(9,2)"))
    assert [r[0] for r in exact.select(F.expr(fn.category_text("n"))).collect()] == ["1.5", "1", "100", "-0.1"]
    words = spark.createDataFrame([("1.0",), ("x",)], "n string")
    assert [r[0] for r in words.select(F.expr(fn.category_text("n"))).collect()] == ["1.0", "x"]


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(0.1, None, None)] * 7, "a double, e double, t string")
    model = pp.fit_preprocessor(df, FeatureSpec(numeric=("a", "e"), categorical=("t",)))
    assert model.feature_names() == ["numeric__a"]
    assert model.numeric["a"][2] == 1.0
    assert abs(model.transform(df).first()[0]) < 1e-12


def test_awkward_names_and_values(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), ("x`y",)], "`odd name` string")
    model = pp.fit_preprocessor(df, FeatureSpec(categorical=("odd name",)))
    got = [tuple(r) for r in model.transform(df).collect()]
    assert sorted(map(sum, got)) == [1.0, 1.0, 1.0] and len(set(got)) == 3


def test_statistics_come_from_training_rows_only(spark, small):
    train = small.where("id <= 2")
    model = pp.fit_preprocessor(train, SPEC)
    assert model.numeric["x"][0] == 1.5 and model.levels["c"] == ("p", "q")
    assert model.transform(small).count() == 5
    assert model.transform(small).where(" or ".join(f"`{n}` is null" for n in model.feature_names())).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=60), st.booleans())
def test_medians(spark, values, bracket):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, one double")
    old = ranking.RANK_DIRECTLY, ranking.ROWS_PER_BUCKET
    ranking.RANK_DIRECTLY, ranking.ROWS_PER_BUCKET = (0, 2) if bracket else old
    try:
        got = dict(rows(ranking.exact_medians(df)))
    finally:
        ranking.RANK_DIRECTLY, ranking.ROWS_PER_BUCKET = old
    assert got == {"v": statistics.median(values), "one": 1.0}


@pytest.mark.parametrize("sample", [10**6, 500, 3])
def test_medians_of_a_real_table(spark, monkeypatch, sample):
    df = fx.table(spark, SF, "lineitem").select("l_extendedprice", "l_quantity")
    want = df.agg(*[F.percentile(c, 0.5) for c in df.columns]).first()
    monkeypatch.setattr(ranking, "RANK_DIRECTLY", 0)
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(ranking, "SKETCH_ROWS", sample)
    got = dict(rows(ranking.exact_medians(df)))
    assert [got[c] for c in df.columns] == pytest.approx(list(want), abs=1e-9)


def test_sketched_median_is_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert pp.numeric_params(df, ["x"], approx=True).first()["median"] == pytest.approx(500, abs=2)


def test_presets(spark):
    raw = fx.accounts(spark, "/root/testdata/sf0.01")
    for spec, width in ((BASELINE, 47), (GROUPED, 41)):
        df = prepare(raw, spec).persist()
        model = pp.fit_preprocessor(df, spec)
        assert len(model.feature_names()) == width
        text = plan(model.transform(df))
        assert "Python" not in text and "Exchange" not in text.split("InMemoryTableScan")[0]
        table = pp.schema_table(model, df)
        assert [r[0] for r in table.orderBy("position").select("transformed_feature").collect()] == model.feature_names()
        df.unpersist()
    assert math.isclose(model.numeric["tenure"][0], 19.0)
