"""Queries over fitted preprocessing: parameters, encodings, names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import fixtures as fx
from catalog import tables_sql as q
from catalog.base import query, rounded
from holdfast.functions import scalars as fn
from holdfast.operators import preprocess as pp
from holdfast.operators.clean import prepare
from holdfast.operators.split import fit_splits
from holdfast.session import new_folder
from holdfast.sources import artifacts as art
from holdfast.spec import BASELINE, BINARY, CATEGORICAL, CATEGORICAL_ALL, GROUPED, NUMERIC, FeatureSpec

ID = "customerID"


def prepared(spark, sf, mode="impute", spec=BASELINE) -> DataFrame:
    return prepare(fx.accounts(spark, sf), spec, mode)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Fitting reads its rows several times."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def split_accounts(spark, sf, spec=BASELINE) -> DataFrame:
    rows = prepared(spark, sf, spec=spec)
    with kept(rows.select(ID, "label")) as keys:
        cuts = fit_splits(keys, "label", ID, 0.70, 0.15, 0.15)
    return cuts.assign(rows)


def fitted(spark, sf, spec) -> tuple[pp.FittedPreprocessor, DataFrame]:
    """Preprocessor learned from the training rows, and all rows."""
    rows = prepared(spark, sf, spec=spec)
    with kept(rows) as cached:
        cuts = fit_splits(cached, "label", ID, 0.70, 0.15, 0.15)
        model = pp.fit_preprocessor(cuts.assign(cached).where("split = 'train'"), spec)
    return model, cuts.assign(rows)


_WITH = f"""WITH base AS MATERIALIZED ({q.SPLIT_ACCOUNTS}),
fit AS MATERIALIZED (SELECT * FROM base WHERE split = 'train') """
_FIT, _ALL = "SELECT * FROM fit", "SELECT * FROM base"


@query("F01_median", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(median({c}), 8) AS median FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def median(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(pp.numeric_params(items, cols).select("feature", "median"), 8, "median")


@query("F02_mode", q.modes(q.PREPARED, q.ALL_TEXT))
def mode(spark, sf):
    return pp.modes(prepared(spark, sf), CATEGORICAL_ALL).drop("unmapped_count")


@query("F03_scaling_statistics", f"""
SELECT feature, round(median, 6) AS median, round(mean, 6) AS mean, round(std, 6) AS std, n_missing
FROM ({q.numeric_stats(q.PREPARED, NUMERIC)})""")
def scaling_statistics(spark, sf):
    with kept(prepared(spark, sf).select(*NUMERIC)) as rows:
        return rounded(pp.numeric_params(rows, NUMERIC), 6, "median", "mean", "std")


@query("F03_fit_params", f"""{_WITH}, stats AS ({q.numeric_stats(_FIT, NUMERIC)})
SELECT 'num' AS feature_group, feature, unnest(['median', 'mean', 'std', 'n_missing']) AS param, CAST(0 AS INTEGER) AS position,
       round(unnest([median, mean, std, CAST(n_missing AS DOUBLE)]), 6) AS number, CAST(NULL AS VARCHAR) AS text FROM stats
UNION ALL SELECT 'cat', feature, 'mode', 0, CAST(n AS DOUBLE), mode FROM ({q.modes(_FIT, q.ALL_TEXT)})
UNION ALL SELECT 'cat', feature, 'category', position, NULL, value FROM ({q.categories(_FIT, q.ALL_TEXT)})""")
def fit_params(spark, sf):
    with kept(split_accounts(spark, sf).where("split = 'train'")) as train:
        return rounded(pp.fit_params(train, BASELINE), 6, "number")


_NUMERIC_ONLY = FeatureSpec(numeric=NUMERIC, id_cols=(ID,), numeric_prefix="num")


def _num_wide(digits=6, prefix="num"):
    return ", ".join(q.scaled(_FIT, c, prefix, digits) for c in NUMERIC)


@query("F04_impute_and_scale", f'{_WITH} SELECT "customerID", {_num_wide()} FROM base')
def impute_and_scale(spark, sf):
    model, rows = fitted(spark, sf, BASELINE)
    only = pp.FittedPreprocessor(_NUMERIC_ONLY, model.numeric)
    return rounded(only.transform(rows, [ID]), 6, *[f"num__{c}" for c in NUMERIC])


_FLAGGED = (*BINARY, "Contract")


@query("F05_binary_flag", "SELECT \"customerID\", " + ", ".join(
    f"""CASE WHEN lower(trim(CAST("{c}" AS VARCHAR))) IN ('yes', 'male', '1', '1.0') THEN 1e0 ELSE 0e0 END AS "{c}" """
    for c in _FLAGGED) + f" FROM ({q.ACCOUNTS})")
def binary_flag(spark, sf):
    return fx.accounts(spark, sf).select(ID, *[fn.binary_flag(c).alias(c) for c in _FLAGGED])


@query("F06_impute_and_flag", f'{_WITH} SELECT "customerID", {", ".join(q.flag(_FIT, c) for c in _FLAGGED)} FROM base')
def impute_and_flag(spark, sf):
    model, rows = fitted(spark, sf, FeatureSpec(
        binary=_FLAGGED, id_cols=(ID,), target="Churn", positive="Yes", negative="No"))
    return model.transform(rows, [ID])


_ONE = FeatureSpec(categorical=("PaymentMethod", "InternetService"), id_cols=(ID,), categorical_prefix="cat")


@query("F07_one_hot_unseen", f"""
SELECT "customerID", {', '.join(f'''CASE WHEN "{c}" = '{v}' THEN 1e0 ELSE 0e0 END AS "cat__{c}_{v}"'''
    for c in _ONE.categorical for v in q.LEVELS[c] if v != 'MACHINERY')} FROM ({q.ACCOUNTS})""")
def one_hot_unseen(spark, sf):
    """Learned without one payment method, applied to all: the unseen one is zero everywhere."""
    rows = fx.accounts(spark, sf)
    model = pp.fit_preprocessor(rows.where("PaymentMethod <> 'MACHINERY'"), _ONE)
    return model.transform(rows, [ID])


_DROP = FeatureSpec(categorical=("gender", "PaperlessBilling", "InternetService"), id_cols=(ID,), drop_if_binary=True)


@query("F08_one_hot_drop_if_binary", f"""
SELECT "customerID", {', '.join(f'''CASE WHEN "{c}" = '{v}' THEN 1e0 ELSE 0e0 END AS "categorical__{c}_{v}"'''
    for c in _DROP.categorical for v in (q.LEVELS[c][1:] if len(q.LEVELS[c]) == 2 else q.LEVELS[c]))} FROM ({q.ACCOUNTS})""")
def one_hot_drop_if_binary(spark, sf):
    rows = fx.accounts(spark, sf)
    return pp.fit_preprocessor(rows, _DROP).transform(rows, [ID])


@query("F09_impute_and_one_hot", f'{_WITH} SELECT "customerID", {", ".join(q.one_hot(_FIT, CATEGORICAL_ALL, "cat"))} FROM base')
def impute_and_one_hot(spark, sf):
    model, rows = fitted(spark, sf, BASELINE)
    only = pp.FittedPreprocessor(
        FeatureSpec(categorical=CATEGORICAL_ALL, categorical_prefix="cat"), {}, model.mode, model.levels)
    return only.transform(rows, [ID])


_GROUPED_WIDE = ", ".join(
    [q.scaled(_FIT, c, "numeric") for c in NUMERIC] + [q.flag(_FIT, c) for c in BINARY]
    + q.one_hot(_FIT, CATEGORICAL, "categorical")
)


@query("F10_feature_vector", f'{_WITH} SELECT "customerID", {_GROUPED_WIDE} FROM base')
def feature_vector(spark, sf):
    """The assembled vector, taken apart again under its feature names."""
    model, rows = fitted(spark, sf, GROUPED)
    values = model.pipeline(rows).transform(rows).select(ID, vector_to_array("features").alias("v"))
    names = model.feature_names()
    return values.select(ID, *[
        (F.round(F.col("v")[i], 6) if n.startswith("numeric__") else F.col("v")[i]).alias(n)
        for i, n in enumerate(names)
    ])


_MANY = FeatureSpec(numeric=("o_totalprice",), categorical=("o_custkey", "o_orderstatus"), id_cols=("o_orderkey",))


@query("F10_joined_dictionary", """WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS x FROM orders),
n AS (SELECT CAST(count(DISTINCT o_custkey) AS INTEGER) AS n FROM o)
SELECT id, 0 AS i, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x FROM o
UNION ALL SELECT id, CAST(dense_rank() OVER (ORDER BY o_custkey) AS INTEGER), 1e0 FROM o
UNION ALL SELECT id, CAST(n + dense_rank() OVER (ORDER BY o_orderstatus) AS INTEGER), 1e0 FROM o, n""")
def joined_dictionary(spark, sf):
    """Entries of the vectors of orders, with a slot for every customer, found by a join."""
    orders = fx.table(spark, sf, "orders")
    model = pp.fit_preprocessor(orders, _MANY, listed=50)
    entries = pp.vector_entries(F.col("features"))
    found = model.assemble(orders).select(F.col("o_orderkey").alias("id"), F.inline(entries))
    return rounded(found, 6, "x")


@query("F11_fit_train_transform_all", f"""{_WITH} SELECT "customerID", split, {_num_wide()},
{", ".join(q.one_hot(_FIT, CATEGORICAL_ALL, "cat"))} FROM base""")
def fit_train_transform_all(spark, sf):
    model, rows = fitted(spark, sf, BASELINE)
    return rounded(model.transform(rows, [ID, "split"]), 6, *[f"num__{c}" for c in NUMERIC])


_NAMES = f"""{_WITH}, named AS (
SELECT i, 'num' AS feature_group, c AS input_feature, 'num__' || c AS transformed_feature, 0 AS p
FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(NUMERIC))}) v(i, c)
UNION ALL SELECT i, 'cat', feature, 'cat__' || feature || '_' || value, position
FROM ({q.categories(_FIT, CATEGORICAL_ALL)})
JOIN (VALUES {', '.join(f"({i + 3}, '{c}')" for i, c in enumerate(CATEGORICAL_ALL))}) w(i, c) ON c = feature)"""
_POSITION = "CAST(row_number() OVER (ORDER BY i, p) - 1 AS INTEGER) AS position"


@query("F12_feature_names", f"{_NAMES} SELECT {_POSITION}, transformed_feature AS name FROM named")
def feature_names(spark, sf):
    model, rows = fitted(spark, sf, BASELINE)
    return pp.schema_table(model, rows).select("position", F.col("transformed_feature").alias("name"))


@query("S07_schema_of_many", """
SELECT CAST(0 AS INTEGER) AS position, 'numeric' AS feature_group, 'o_totalprice' AS input_feature, 'numeric__o_totalprice' AS transformed_feature
UNION ALL SELECT CAST(row_number() OVER (ORDER BY o_custkey) AS INTEGER), 'categorical', 'o_custkey', 'categorical__o_custkey_' || o_custkey
FROM (SELECT DISTINCT o_custkey FROM orders)
UNION ALL SELECT CAST(n + row_number() OVER (ORDER BY s) AS INTEGER), 'categorical', 'o_orderstatus', 'categorical__o_orderstatus_' || s
FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT count(DISTINCT o_custkey) AS n FROM orders)""")
def schema_of_many(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return pp.schema_table(pp.fit_preprocessor(orders, _MANY, listed=50), orders)


@query("S07_feature_schema", f"{_NAMES} SELECT {_POSITION}, feature_group, input_feature, transformed_feature FROM named")
def feature_schema(spark, sf):
    model, rows = fitted(spark, sf, BASELINE)
    table = pp.schema_table(model, rows)
    path = new_folder(spark, "schema")
    art.save_schema(table, path)
    return spark.read.schema(table.schema).json(path)
