"""Queries over raw snapshots: sources, profiling, cleaning, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

import fixtures as fx
from catalog import tables_sql as q
from catalog.base import query
from holdfast.functions import scalars as fn
from holdfast.operators import clean, profile, split
from holdfast.session import new_folder
from holdfast.sources import accounts as src
from holdfast.spec import ACCOUNT_COLUMNS, BASELINE, CATEGORICAL, GROUPED, REQUIRED_COLS

# --- sources ---------------------------------------------------------------------------------


def _landed(spark, sf):
    path = new_folder(spark, "accounts")
    src.write_csv(fx.accounts(spark, sf), path)
    return path


@query("S01_csv_scan", q.ACCOUNTS)
def csv_scan(spark, sf):
    return src.read_csv(spark, _landed(spark, sf))


def _broken(spark, sf):
    """CSV files of accounts, one per task and half; in those of the second half, rows lack their last field or have one more."""
    rows, path = fx.accounts(spark, sf), new_folder(spark, "broken")
    k = F.substring("customerID", 2, 8).cast("long")
    src.write_csv(rows.where(k % 2 == 0), path)
    line = F.to_csv(F.struct(*rows.columns), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    line = F.when(k % 10 == 3, F.regexp_replace(line, ",[^,]*$", "")).when(k % 10 == 7, F.concat(line, F.lit(",more"))).otherwise(line)
    odd = rows.where(k % 2 == 1).select(line.alias(",".join(rows.columns)))
    odd.write.mode("append").option("header", True).option("sep", "\x01").option("quote", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query("S01_good_rows", f"""SELECT * FROM ({q.ACCOUNTS}) WHERE CAST(substr("customerID", 2) AS BIGINT) % 10 NOT IN (3, 7)""")
def good_rows(spark, sf):
    return src.good_rows(src.read_csv_checked(spark, _broken(spark, sf)))


@query("S01_reject_counts", f"""
SELECT CASE CAST(substr("customerID", 2) AS BIGINT) % 10 WHEN 3 THEN 'too few fields' ELSE 'too many fields' END AS reject_reason,
       count(*) AS n FROM ({q.ACCOUNTS}) WHERE CAST(substr("customerID", 2) AS BIGINT) % 10 IN (3, 7) GROUP BY 1""")
def reject_counts(spark, sf):
    counts = src.reject_counts(src.read_csv_checked(spark, _broken(spark, sf)))
    return counts.groupBy("reject_reason").agg(F.sum("n").alias("n"))


@query("S02_nonempty_input", f'SELECT "customerID", "Churn" FROM ({q.ACCOUNTS})')
def nonempty_input(spark, sf):
    return src.require_rows(fx.accounts(spark, sf)).select("customerID", "Churn")


@query("S03_required_columns", f'SELECT "customerID", "Churn", "TotalCharges", tenure FROM ({q.ACCOUNTS})')
def required_columns(spark, sf):
    return src.require_columns(fx.accounts(spark, sf)).select(*REQUIRED_COLS)


# --- profiling -------------------------------------------------------------------------------

_TYPES = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}


@query("P01_column_profile", " UNION ALL ".join(
    f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{_TYPES.get(c, "string")}' AS data_type,
    count("{c}") AS non_null, count(*) AS n_rows FROM ({q.ACCOUNTS})""" for i, c in enumerate(ACCOUNT_COLUMNS, 1)))
def column_profile(spark, sf):
    return profile.column_profile(fx.accounts(spark, sf))


@query("P01_table_shape", f"SELECT count(*) AS n_rows, CAST(21 AS INTEGER) AS n_columns FROM ({q.ACCOUNTS})")
def table_shape(spark, sf):
    return profile.table_shape(fx.accounts(spark, sf))


@query("P02_first_rows", f'SELECT * FROM ({q.ACCOUNTS}) ORDER BY "customerID" LIMIT 5')
def first_rows(spark, sf):
    return profile.first_rows(fx.accounts(spark, sf), ["customerID"])


@query("P03_missing_counts", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS n_missing FROM ({q.ACCOUNTS})"""
    for c in ACCOUNT_COLUMNS) + ") WHERE n_missing > 0")
def missing_counts(spark, sf):
    return profile.missing_counts(fx.accounts(spark, sf))


@query("P04_blank_counts", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim("{c}") = '') AS n_blank FROM ({q.ACCOUNTS})"""
    for c in ACCOUNT_COLUMNS if c not in _TYPES))
def blank_counts(spark, sf):
    return profile.blank_counts(fx.accounts(spark, sf))


@query("P05_value_counts", f"""
SELECT "Contract" AS value, count(*) AS n,
       CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100e0 AS percent
FROM ({q.ACCOUNTS}) WHERE "Contract" IS NOT NULL GROUP BY 1""")
def value_counts(spark, sf):
    return profile.value_counts(fx.accounts(spark, sf), "Contract")


@query("P06_positive_rate", f"""
SELECT count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_positive,
       CAST(sum(y_true) AS DOUBLE) / count(*) AS positive_rate FROM ({q.SCORED})""")
def positive_rate(spark, sf):
    return profile.positive_rate(fx.scored_orders(spark, sf), "y_true")


# --- cleaning --------------------------------------------------------------------------------

_SPACES = "'" + "' || chr(39) || '".join(fn.WHITESPACE.split("'")) + "'"


@query("C01_strip_strings", f"""
SELECT doc_id, md5(trim(text, {_SPACES})) AS text_md5, CAST(length(trim(text, {_SPACES})) AS INTEGER) AS n,
       trim(lang, {_SPACES}) AS lang, trim(source, {_SPACES}) AS source FROM documents""")
def strip_strings(spark, sf):
    docs = clean.strip_strings(fx.table(spark, sf, "documents"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"), "lang", "source")


@query("C02_text_to_number", f"""
SELECT "customerID", {q.to_number('"TotalCharges"')} AS "TotalCharges" FROM ({q.ACCOUNTS})""")
def text_to_number(spark, sf):
    return clean.text_to_number(fx.accounts(spark, sf), "TotalCharges").select("customerID", "TotalCharges")


@query("C03_blank_charges_to_zero", f'SELECT "customerID", tenure, "TotalCharges" FROM ({q.PREPARED_ZERO})')
def blank_charges_to_zero(spark, sf):
    return clean.blank_charges_to_zero(fx.accounts(spark, sf)).select("customerID", "tenure", "TotalCharges")


@query("C04_drop_identifiers", f'SELECT * EXCLUDE ("customerID") FROM ({q.ACCOUNTS})')
def drop_identifiers(spark, sf):
    return clean.drop_columns(fx.accounts(spark, sf), ["customerID"])


@query("C05_encode_target_strict", f'SELECT "customerID", label FROM ({q.PREPARED})')
def encode_target_strict(spark, sf):
    return clean.encode_target_strict(fx.accounts(spark, sf), "Churn").select("customerID", "label")


@query("C06_encode_target_lenient", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent FROM orders""")
def encode_target_lenient(spark, sf):
    orders = fx.table(spark, sf, "orders")
    return clean.encode_target_lenient(orders, "o_orderpriority", "1-URGENT", "urgent").select("o_orderkey", "urgent")


@query("C07_select_features", f"SELECT {', '.join(chr(34) + c + chr(34) for c in GROUPED.features)} FROM ({q.ACCOUNTS})")
def select_features(spark, sf):
    return clean.select_features(fx.accounts(spark, sf), GROUPED)


_REASONS = ", ".join(
    [f"""CASE WHEN coalesce({q.to_number('"TotalCharges"')}, -1) < 0 THEN 'TotalCharges' END"""]
    + [f"""CASE WHEN "{c}" IS NULL THEN '{c}' END""" for c in CATEGORICAL]
)


@query("C08_validate_records", f"""
SELECT "customerID", reasons, reasons = '' AS valid FROM (
  SELECT "customerID", concat_ws(',', CASE WHEN tenure < 0 OR tenure > 100 THEN 'tenure' END, {_REASONS}) AS reasons
  FROM ({q.ACCOUNTS}))""")
def validate_records(spark, sf):
    checked = clean.validate_records(fx.accounts(spark, sf))
    return checked.select(
        "customerID", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("valid")
    )


@query("C09_threshold_label", f"SELECT id, CAST(y_prob >= 0.4 AS INTEGER) AS y_pred FROM ({q.SCORED})")
def threshold_label(spark, sf):
    return fx.scored_orders(spark, sf).select("id", fn.hard_label("y_prob", 0.4).alias("y_pred"))


_BASE = ", ".join(f'"{c}"' for c in ("customerID", *BASELINE.features, "label"))
_GROUPED = ", ".join(f'"{c}"' for c in ("customerID", *GROUPED.features, "label"))


@query("C10_prepare_impute", f"SELECT {_BASE} FROM ({q.PREPARED})")
def prepare_impute(spark, sf):
    return clean.prepare_written(fx.accounts(spark, sf), BASELINE, "impute")


@query("C10_prepare_zero", f"SELECT {_GROUPED} FROM ({q.PREPARED_ZERO})")
def prepare_zero(spark, sf):
    return clean.prepare_written(fx.accounts(spark, sf), GROUPED, "zero")


# --- splits ----------------------------------------------------------------------------------


@query("R01_split_60_20_20", f"SELECT id, y_true, split FROM ({q.SPLIT_SCORED})")
def split_60(spark, sf):
    return fx.split_orders(spark, sf).select("id", "y_true", "split")


@query("R01_split_70_15_15", f"SELECT id, y_true, split FROM ({q.SPLIT_SCORED_70})")
def split_70(spark, sf):
    return fx.split_orders(spark, sf, train=0.70, validation=0.15, test=0.15).select("id", "y_true", "split")


@query("R01_split_accounts", f'SELECT "customerID", label, split FROM ({q.SPLIT_ACCOUNTS})')
def split_accounts(spark, sf):
    rows = clean.prepare(fx.accounts(spark, sf), BASELINE).select("customerID", "label")
    return split.stratified_split(rows, "label", "customerID", 0.70, 0.15, 0.15)


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part FROM lineitem"
_LINES_SPLIT = f"""SELECT * FROM ({q.split(_LINES, "part", "id", 0.70, 0.15, 0.15)})"""


def _lines(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_partkey").alias("part"))


@query("R01_split_many_classes", f"SELECT id, part, split FROM ({_LINES_SPLIT})")
def split_many_classes(spark, sf):
    """A class for every part."""
    return split.stratified_split(_lines(spark, sf), "part", "id", 0.70, 0.15, 0.15).select("id", "part", "split")


@query("R04_early_stopping_many_classes", f"""
SELECT id, split = 'test' AS is_valid FROM ({q.split(_LINES, "part", "id", 0.9, 0.0, 0.1)})""")
def early_stopping_many_classes(spark, sf):
    return split.early_stopping_indicator(_lines(spark, sf), "part", "id").select("id", "is_valid")


@query("R02_leakage_counts", f"""
SELECT {', '.join(f"CAST(count(*) FILTER (WHERE has_{a} AND has_{b}) AS BIGINT) AS {a}_{b}"
                  for a, b in (("train", "validation"), ("train", "test"), ("validation", "test")))}
FROM (SELECT customer, {', '.join(f"bool_or(split = '{s}') AS has_{s}" for s in split.SPLITS)}
      FROM ({q.SPLIT_SCORED}) GROUP BY customer)""")
def leakage_counts(spark, sf):
    """Orders are split one by one, so customers with several orders do leak."""
    return split.leakage_counts(fx.split_orders(spark, sf), "customer")


@query("R03_split_summary", f"""
SELECT split, n, n_positive, CAST(n_positive AS DOUBLE) / n * 100e0 AS positive_rate,
       CAST(n AS DOUBLE) / CAST(n_total AS DOUBLE) * 100e0 AS share, n_total
FROM (SELECT split, count(*) AS n, CAST(sum(y_true) AS BIGINT) AS n_positive,
             CAST(sum(count(*)) OVER () AS BIGINT) AS n_total FROM ({q.SPLIT_SCORED}) GROUP BY split)""")
def split_summary(spark, sf):
    return split.split_summary(fx.split_orders(spark, sf), "y_true")


_TRAIN = f"SELECT * EXCLUDE (split) FROM ({q.SPLIT_SCORED}) WHERE split = 'train'"


@query("R04_early_stopping_indicator", f"""
SELECT id, split = 'test' AS is_valid FROM ({q.split(_TRAIN, "y_true", "id", 0.9, 0.0, 0.1)})""")
def early_stopping(spark, sf):
    train = fx.split_orders(spark, sf).where("split = 'train'")
    return split.early_stopping_indicator(train, "y_true", "id").select("id", "is_valid")


# --- scalar functions ------------------------------------------------------------------------


@query("L01_risk_level", f"""
SELECT id, {q.RISK.format(p='y_prob')} AS level,
       CASE WHEN y_prob >= 0.7 THEN 'High Risk' WHEN y_prob >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS title
FROM ({q.SCORED})""")
def risk_level(spark, sf):
    return fx.scored_orders(spark, sf).select(
        "id", fn.risk_level("y_prob").alias("level"), fn.risk_title("y_prob").alias("title")
    )


@query("L02_bin_label", f"""
SELECT id, printf('%.1f - %.1f', y_prob, y_prob + 0.1e0) AS label FROM ({q.SCORED})""")
def bin_label(spark, sf):
    p = F.col("y_prob")
    return fx.scored_orders(spark, sf).select("id", fn.bin_label(p, p + 0.1).alias("label"))


@query("L03_percent_and_sign", f"""
SELECT id, printf('%.1f%%', y_prob * 100e0) AS percent, printf('%+.2f', y_prob - 0.5e0) AS signed
FROM ({q.SCORED})""")
def percent_and_sign(spark, sf):
    p = F.col("y_prob")
    return fx.scored_orders(spark, sf).select(
        "id", fn.percent(p).alias("percent"), fn.signed(p - 0.5).alias("signed")
    )


