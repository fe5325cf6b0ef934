"""Queries that land their input as files write it with all tasks."""

import glob

import pytest

from catalog import data
from conftest import rows


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """400 customers in eight files, two of five with orders."""
    root = str(tmp_path_factory.mktemp("landed"))
    spark.range(1, 401).selectExpr(
        "id as c_custkey", "concat('n', id) as c_name", "cast(id % 25 as int) as c_nationkey", "cast(id * 20 as double) as c_acctbal",
        "'MACHINERY' as c_mktsegment").repartition(8).write.parquet(f"{root}/customer.parquet")
    spark.range(1, 401).where("id % 5 < 2").selectExpr(
        "id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "cast(id as double) as o_totalprice",
        "timestamp'1995-03-01 00:00:00' as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{root}/orders.parquet")
    return root


def test_broken_files_are_written_by_many_tasks(spark, made, monkeypatch):
    paths = []
    kept = data.new_folder
    monkeypatch.setattr(data, "new_folder", lambda *a: paths.append(kept(*a)) or paths[-1])
    got = data.good_rows(spark, made)
    assert rows(got, "customerID") == [(f"C{k:08d}",) for k in range(1, 401) if k % 10 not in (3, 7)]
    assert {(r["TotalCharges"], r["PaymentMethod"]) for r in got.where("customerID = 'C00000006'").collect()} == {("6.00", "MACHINERY")}
    assert got.where("TotalCharges = ' '").count() == 160
    assert len(glob.glob(f"{paths[0]}/part-*")) > 2


def test_rejects_of_many_files_are_one_row_a_reason(spark, made, monkeypatch):
    paths = []
    kept = data.new_folder
    monkeypatch.setattr(data, "new_folder", lambda *a: paths.append(kept(*a)) or paths[-1])
    assert rows(data.reject_counts(spark, made), "reject_reason", "n") == [("too few fields", 40), ("too many fields", 40)]
    lines = [set(spark.read.text(f).limit(1).collect()) for f in glob.glob(f"{paths[0]}/part-*")]
    assert len(lines) > 2 and len(set.union(*lines)) == 1  # every file begins with the header
