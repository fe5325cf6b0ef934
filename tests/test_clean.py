import os

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from conftest import SF, plan, rows
from holdfast.operators import clean, profile
from holdfast.sources import accounts as src
from holdfast.spec import BASELINE, GROUPED

CHARGES = "TotalCharges string, tenure int"


def test_blank_charges_become_zero(spark):
    df = spark.createDataFrame([("100.5", 10), (" ", 0), ("200.0", 20)], CHARGES)
    got = clean.blank_charges_to_zero(df)
    assert dict(got.dtypes)["TotalCharges"] == "double"
    assert rows(got, "TotalCharges") == [(0.0,), (100.5,), (200.0,)]


def test_valid_charges_stay(spark):
    df = spark.createDataFrame([("100.50", 10), ("200.75", 20), ("0.0", 0)], CHARGES)
    assert rows(clean.blank_charges_to_zero(df), "TotalCharges") == [(0.0,), (100.5,), (200.75,)]


def test_blank_charges_of_a_running_account_raise(spark):
    df = spark.createDataFrame([(" ", 5)], CHARGES)
    with pytest.raises(ValueError, match="tenure > 0"):
        clean.blank_charges_to_zero(df)


def test_the_guard_is_a_sum_unless_strict(spark):
    df = spark.createDataFrame([(" ", 5), (" ", -5)], CHARGES)
    assert clean.blank_charges_to_zero(df).count() == 2
    with pytest.raises(ValueError):
        clean.blank_charges_to_zero(df, strict=True)


def test_targets(spark):
    df = spark.createDataFrame([("Yes", "a"), ("No", "b"), ("Yes", "c")], "Churn string, other string")
    assert rows(clean.encode_target_strict(df, "Churn")) == [("a", 1), ("b", 0), ("c", 1)]
    assert rows(clean.encode_target_lenient(df, "Churn")) == [(0, "b"), (1, "a"), (1, "c")]


def test_unknown_targets(spark):
    df = spark.createDataFrame([("Yes",), ("Maybe",), (None,)], "Churn string")
    with pytest.raises(ValueError, match="Maybe"):
        clean.encode_target_strict(df, "Churn")
    with pytest.raises(ValueError, match="not found"):
        clean.encode_target_strict(df, "Gone")
    assert rows(clean.encode_target_lenient(df, "Churn")) == [(0,), (0,), (1,)]


RECORD = {
    "tenure": "12", "MonthlyCharges": "50.0", "TotalCharges": "600.0", "gender": "Male", "SeniorCitizen": "0",
    "Partner": "Yes", "Dependents": "No", "PhoneService": "Yes", "PaperlessBilling": "No", "MultipleLines": "No",
    "InternetService": "DSL", "OnlineSecurity": "Yes", "OnlineBackup": "Yes", "DeviceProtection": "Yes",
    "TechSupport": "Yes", "StreamingTV": "No", "StreamingMovies": "No", "Contract": "One year",
    "PaymentMethod": "Credit card (automatic)",
}


@pytest.mark.parametrize("change,reasons", [
    ({}, []),
    ({"tenure": "0", "TotalCharges": "0", "InternetService": "No"}, []),
    ({"tenure": "100"}, []), ({"tenure": "101"}, ["tenure"]), ({"tenure": "-1"}, ["tenure"]),
    ({"tenure": "invalid"}, ["tenure"]), ({"tenure": "1.5"}, ["tenure"]), ({"tenure": None}, ["tenure"]),
    ({"TotalCharges": " "}, ["TotalCharges"]), ({"MonthlyCharges": "NaN"}, ["MonthlyCharges"]),
    ({"gender": "Male\n"}, ["gender"]), ({"gender": "male"}, ["gender"]), ({"Partner": "yes"}, ["Partner"]),
    ({"SeniorCitizen": "2"}, ["SeniorCitizen"]), ({"Contract": "Five year"}, []), ({"Contract": None}, ["Contract"]),
    ({"tenure": "-1", "gender": "x", "PaymentMethod": None}, ["tenure", "gender", "PaymentMethod"]),
])
def test_validation(spark, change, reasons):
    record = RECORD | change
    df = spark.createDataFrame([tuple(record.values())], ", ".join(f"{c} string" for c in record))
    checked = clean.validate_records(df)
    assert checked.first()["reasons"] == reasons
    valid, rejected = clean.split_valid(checked)
    assert (valid.count(), rejected.count()) == ((0, 1) if reasons else (1, 0))


def test_validation_of_typed_columns(spark):
    inf, nan = float("inf"), float("nan")
    typed = {"tenure": "int", "SeniorCitizen": "int", "MonthlyCharges": "double", "TotalCharges": "double"}
    schema = ", ".join(f"{c} {typed.get(c, 'string')}" for c in RECORD)

    def reasons(**change):
        record = RECORD | {"tenure": 12, "SeniorCitizen": 0, "MonthlyCharges": 50.0, "TotalCharges": 600.0} | change
        df = spark.createDataFrame([tuple(record.values())], schema)
        return clean.validate_records(df).first()["reasons"]

    assert reasons() == [] and reasons(MonthlyCharges=inf) == []
    assert reasons(MonthlyCharges=nan, TotalCharges=-0.01) == ["MonthlyCharges", "TotalCharges"]
    assert reasons(tenure=101, SeniorCitizen=None) == ["tenure", "SeniorCitizen"]


def test_number_columns_pass_through(spark):
    df = spark.createDataFrame([(1.5, 3), (None, 0), (float("nan"), 0)], "TotalCharges double, tenure int")
    assert rows(clean.blank_charges_to_zero(df), "TotalCharges") == [(0.0,), (0.0,), (1.5,)]
    assert clean.text_to_number(df, "TotalCharges").where("TotalCharges = 1.5").count() == 1


def test_prepare_keeps_id_features_label(spark):
    raw = fx.accounts(spark, SF)
    for spec, mode in ((BASELINE, "impute"), (GROUPED, "zero")):
        got = clean.prepare(raw, spec, mode)
        assert got.columns == ["customerID", *spec.features, "label"]
        assert got.count() == raw.count()
    blanks = raw.where(F.trim("TotalCharges") == "").count()
    assert clean.prepare(raw, BASELINE).where("TotalCharges is null").count() == blanks > 0
    with pytest.raises(ValueError, match="mode"):
        clean.prepare(raw, BASELINE, "other")


def test_csv_round_trip_and_missing_tokens(spark, folder):
    raw = fx.accounts(spark, SF)
    src.write_csv(raw, folder("csv"))
    assert rows(src.load_accounts(spark, folder("csv"))) == rows(raw)
    with open(folder("one.csv"), "w") as f:
        f.write('tenure,extra,TotalCharges,Contract,customerID,Churn\n3,x,NA,"say ""hi""",A,Yes\n,NULL, ,n/a,B,No\n')
    got = src.load_accounts(spark, folder("one.csv"))
    assert [tuple(r) for r in got.orderBy("customerID").collect()] == [
        (3, "x", None, 'say "hi"', "A", "Yes"), (None, None, " ", None, "B", "No")]


def test_input_checks(spark, folder):
    with pytest.raises(FileNotFoundError):
        src.read_csv(spark, folder("nothing"))
    with pytest.raises(FileNotFoundError):
        src.read_table(spark, folder("nothing"))
    with pytest.raises(ValueError, match="empty"):
        src.require_rows(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError, match="Churn"):
        src.require_columns(spark.createDataFrame([("A", 1)], "customerID string, tenure int"))


def test_broken_whole_number_raises(spark, folder):
    with open(folder("one.csv"), "w") as f:
        f.write("customerID,tenure\nA,many\n")
    with pytest.raises(Exception, match="not a whole number"):
        src.read_csv(spark, folder("one.csv")).collect()


def test_nan_is_null_after_reading(spark, folder):
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(folder("t"))
    assert rows(src.read_table(spark, folder("t"))) == [(1.0,), (None,)]


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, " ", float("nan")), (3, "a", 1.0)], "id int, t string, x double")
    assert rows(profile.missing_counts(df)) == [("x", 2)]
    assert rows(profile.blank_counts(df)) == [("t", 1)]
    assert [tuple(r)[:2] for r in profile.value_counts(df, "t").collect()] == [("a", 2), (" ", 1)]
    assert rows(profile.first_rows(df, ["id"], 2), "id") == [(1,), (2,)]
    assert profile.column_profile(df).orderBy("position").first()["data_type"] == "int"


def scans(df):
    return plan(df).count("Scan ")


def test_malformed_csv_rows_are_kept_apart(spark, folder):
    path = folder("csv")
    os.makedirs(path)
    head = "customerID,tenure,Churn,TotalCharges\n"
    with open(f"{path}/a.csv", "w") as f:
        f.write(head + '1,5,Yes,"1,5"\n2,x\n3,6,No,7,more\n\n4,"un\n5,7,,\n')
    with open(f"{path}/b.csv", "w") as f:
        f.write(head + '6,8,"say ""x""", \n7,,,,,,,\n8\n')
    checked = src.read_csv_checked(spark, path)
    good = rows(src.good_rows(checked), "customerID", "tenure", "Churn")
    assert good == [("1", 5, "Yes"), ("5", 7, None), ("6", 8, 'say "x"')]
    assert src.good_rows(checked).dtypes == src.read_csv(spark, path).dtypes
    assert rows(src.reject_counts(checked)) == [
        ("a.csv", "too few fields", 2), ("a.csv", "too many fields", 1), ("b.csv", "too few fields", 1), ("b.csv", "too many fields", 1)]
    lines = rows(checked.where("reject_reason is not null"), "reject_line", "customerID", "tenure")
    assert lines == sorted([(x, None, None) for x in ("2,x", "3,6,No,7,more", '4,"un', "7,,,,,,,", "8")], key=repr)
    checked.write.partitionBy("reject_reason").parquet(folder("kept"))  # one pass for both
    assert spark.read.parquet(folder("kept")).count() == 8


def test_checks_need_no_scan_of_their_own(spark):
    raw = fx.accounts(spark, SF)
    for spec, mode in ((BASELINE, "impute"), (GROUPED, "zero")):
        out = clean.prepare_written(raw, spec, mode)
        want = clean.prepare(raw, spec, mode)
        assert out.columns == want.columns and rows(out) == rows(want)
        assert scans(out) == 1 and "prepared" in plan(out)


def test_a_source_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = fx.accounts(spark, SF)
    n = raw.count()
    for spec, mode in ((BASELINE, "impute"), (GROUPED, "zero")):
        before = seen.value
        clean.prepare_written(raw.mapInArrow(count, raw.schema), spec, mode)
        assert seen.value - before == n


@pytest.mark.parametrize("column,value,spec,mode", [
    ("Churn", "Maybe", BASELINE, "impute"), ("Churn", None, BASELINE, "impute"), ("TotalCharges", " ", GROUPED, "zero")])
def test_written_tables_raise_as_others_do(spark, column, value, spec, mode):
    raw = fx.accounts(spark, SF).withColumn(column, F.when(F.col("tenure") > 20, F.lit(value)).otherwise(F.col(column)))
    errors = []
    for prepare in (clean.prepare, clean.prepare_written):
        with pytest.raises(ValueError) as error:
            prepare(raw, spec, mode)
        errors.append(str(error.value))
    assert errors[0] == errors[1]
