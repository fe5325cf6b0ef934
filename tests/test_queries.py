"""Registered queries against their SQL in another engine."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.modelling import vectors
from conftest import plan
from holdfast.operators import models as md
from tools.check import TABLES, compare

DIR = "/root/testdata/sf0.01"
#: Queries that fit large models are covered by test_models and by tools/check.py.
SLOW = ("M03", "M04", "M05", "M06", "M07", "M10", "S04", "S05", "F")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n, q in entry.REGISTRY.items() if q.sql and not n.startswith(SLOW)])
def test_query_equals_sql(spark, con, name):
    got = compare(entry.queries()[name](spark, DIR), con.sql(entry.oracle_sql()[name]))
    assert got.startswith("ok") and "nearly" not in got, got


@pytest.mark.parametrize("name,columns", [
    ("G12_evaluation_record", {"o_orderkey", "o_orderstatus"}), ("G05_threshold_sweep", {"o_orderkey", "o_orderstatus"}),
    ("W01_roc_curve", {"o_orderkey", "o_orderstatus"}), ("R01_split_60_20_20", {"o_orderkey", "o_orderstatus"}),
    ("F01_median", {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}), ("P05_value_counts", None),
])
def test_scans_read_only_the_needed_columns(spark, name, columns):
    text = plan(entry.queries()[name](spark, DIR))
    read = [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<(.*?)>", text)]
    assert read and all(r <= (columns or {"c_custkey", "c_acctbal", "o_custkey", "o_orderdate"}) for r in read)
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_date_filters_reach_the_scan(spark):
    text = plan(entry.queries()["C02_text_to_number"](spark, DIR))
    assert re.search(r"PushedFilters: \[[^]]*o_orderdate", text)


def test_one_scan_of_the_input(spark):
    assert plan(entry.queries()["R03_split_summary"](spark, DIR)).count("FileScan") == 1
    table = vectors(spark, DIR)
    trained = {k: md.Trained(md.fit_logistic(table, c=c), 0.0) for k, c in (("a", 1.0), ("b", 0.01))}
    scored = md.score_candidates(trained, table, ["id"])
    assert plan(scored).count("FileScan") == 1
    one = md.score(trained["b"].model, table, ["id"])
    assert scored.where("model = 'b'").select("id", "y_prob", "y_pred").exceptAll(one).isEmpty()
    assert scored.count() == 2 * table.count()


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in entry.REGISTRY}
    sizes = {"S": 8, "P": 6, "C": 10, "R": 4, "F": 12, "M": 10, "G": 17, "W": 4, "X": 6, "L": 3}
    assert names == {f"{k}{i:02d}" for k, n in sizes.items() for i in range(1, n + 1)}
