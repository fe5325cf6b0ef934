import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from holdfast.functions import scalars as fn


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr).first()[0]


def test_whitespace_is_what_python_strips():
    import sys

    assert set(fn.WHITESPACE) == {c for c in map(chr, range(sys.maxunicode)) if c.isspace()}


@pytest.mark.parametrize("text", [" Yes", "Yes\t", "  Yes 　", "a b", "", " \n", "\x1cq\x1f"])
def test_strip(spark, text):
    assert one(spark, fn.strip("t"), t=text) == text.strip()


@pytest.mark.parametrize("text,value", [
    ("100.5", 100.5), (" 7 ", 7.0), ("1e3", 1000.0), ("-.5", -0.5), ("+2.", 2.0), ("", None), (" ", None),
    ("abc", None), ("1.5d", None), ("NaN", None), ("1,000", None), ("0x10", None),
])
def test_to_number(spark, text, value):
    assert one(spark, fn.to_number("t"), t=text) == value


@pytest.mark.parametrize("text,value", [
    ("Yes", 1.0), ("YES", 1.0), ("no", 0.0), ("Male", 1.0), ("Female", 0.0), ("1", 1.0), ("0", 0.0),
    ("1.0", 1.0), (" yes ", 1.0), ("True", 0.0), ("maybe", 0.0),
])
def test_binary_flag(spark, text, value):
    assert one(spark, fn.binary_flag("t"), t=text) == value


def test_binary_flag_of_numbers(spark):
    df = spark.createDataFrame([(1, 1.0, True), (0, 0.0, False)], "i int, d double, b boolean")
    got = df.select(*[fn.binary_flag(c) for c in df.columns]).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.0), (0.0, 0.0, 0.0)]


@pytest.mark.parametrize("value,digits", [
    (0.285, 2), (0.125, 2), (0.375, 2), (-0.001, 2), (0.005, 2), (1234567.891, 2), (0.45, 1), (2.5, 0), (3.5, 0),
])
def test_fixed_rounds_like_printf(spark, value, digits):
    assert one(spark, fn.fixed("v", digits), v=value) == f"{value:.{digits}f}"


def test_signed_and_percent(spark):
    got = one(spark, F.array(fn.signed(F.lit(0.056)), fn.signed(F.lit(-0.056)), fn.percent(F.lit(0.1234))))
    assert got == ["+0.06", "-0.06", "12.3%"]


def test_risk_levels(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.39999, 0.4, 0.69996, 0.7, 1.0)], "p double")
    got = [r[0] for r in df.select(fn.risk_level("p")).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high"]
    assert [r[0] for r in df.select(fn.risk_title("p")).collect()][::3] == ["Low Risk", "Medium Risk"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=30), st.integers(2, 40))
def test_bucket_index_is_digitize(spark, values, n):
    edges = np.linspace(0, 1, n).tolist()
    values = values + edges
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", fn.bucket_index("v", edges).alias("a"), fn.bucket_index("v", edges, True).alias("b"))
    for v, a, b in got.collect():
        assert a == np.digitize(v, edges) and b == np.searchsorted(edges, v, side="left")


def test_bucket_index_needs_order(spark):
    with pytest.raises(ValueError, match="ascend"):
        fn.bucket_index("v", [0.5, 0.1])


def test_ratio_of_zero(spark):
    assert one(spark, fn.ratio(F.lit(3), F.lit(0))) == 0.0


def test_text_literal_survives_quotes(spark):
    for value in ("it's", "a\\b", "\\'", "x\ny"):
        assert spark.range(1).select(F.expr(fn.text(value))).first()[0] == value
