"""Modelling tables derived from the given star-schema tables, for queries, tests and bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.split import stratified_split
from holdfast.spec import ACCOUNT_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCORE = "cast(350 * y_true + (id * 7919 % 10007) * 650 div 10007 as double) / 1000D"


def score_column():
    """The score as an expression over id and y_true."""
    return F.expr(_SCORE)


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: id, y_true, y_prob, and model, segment, customer to group by."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("model"),
        F.col("o_orderpriority").alias("segment"),
        F.col("o_custkey").alias("customer"),
    ).withColumn("y_prob", score_column())


def split_orders(spark: SparkSession, sf_dir: str, **ratios) -> DataFrame:
    return stratified_split(scored_orders(spark, sf_dir), "y_true", "id", **ratios)


def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored orders plus two numeric features (one with signal) and a category."""
    return scored_orders(spark, sf_dir).select(
        "id", "y_true", F.col("y_true").cast("double").alias("label"),
        F.expr("y_prob + cast(id * 104729 % 1009 as double) / 1009D").alias("x1"),
        F.expr("cast(id * 7907 % 1013 as double) / 1013D").alias("x2"),
        F.expr("element_at(array('A', 'B', 'C', 'D'), cast(id % 4 as int) + 1)").alias("c"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account snapshots with the full 21-column input schema.

    Features use orders before 1997, the target orders of the first half of 1997. Orders are
    aggregated per customer before the join, so a customer with many orders is one row there.
    """
    cutoff, until = F.lit("1997-01-01").cast("date"), F.lit("1997-07-01").cast("date")
    day = F.col("o_orderdate")
    history = table(spark, sf_dir, "orders").where(day < until).groupBy(F.col("o_custkey").alias("k")).agg(
        F.min(F.when(day < cutoff, day)).alias("first_day"),
        F.sum(F.when(day < cutoff, F.col("o_totalprice").cast("decimal(18,2)"))).alias("spent"),
        F.bool_or(day >= cutoff).alias("active"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    df = customers.join(history, "k", "left")
    k = F.col("k")

    def yes(cond):
        return F.when(cond, "Yes").otherwise("No")

    no_net = k % 6 == 5
    addons = {"OnlineSecurity": 3, "OnlineBackup": 4, "DeviceProtection": 5, "TechSupport": 7,
              "StreamingTV": 11, "StreamingMovies": 13}
    cols = {
        "customerID": F.concat(F.lit("C"), F.lpad(k.cast("string"), 8, "0")),
        "tenure": F.coalesce(
            (F.lit(1997) - F.year("first_day")) * 12 - F.month("first_day") + 1, F.lit(0)
        ).cast("int"),
        "MonthlyCharges": (2000 + (k * 37) % 10000).cast("double") / 100.0,
        "TotalCharges": F.coalesce(F.col("spent").cast("string"), F.lit(" ")),
        "gender": F.when(k % 2 == 0, "Male").otherwise("Female"),
        "SeniorCitizen": (F.col("c_nationkey") < 4).cast("int"),
        "Partner": yes(F.col("c_acctbal") >= 4500),
        "Dependents": yes(k % 3 == 0),
        "PhoneService": F.when(k % 10 == 0, "No").otherwise("Yes"),
        "PaperlessBilling": yes(k % 5 < 3),
        "MultipleLines": F.when(k % 10 == 0, "No phone service").otherwise(yes(k % 4 == 0)),
        "InternetService": F.when(k % 6 < 2, "DSL").when(no_net, "No").otherwise("Fiber optic"),
        **{c: F.when(no_net, "No internet service").otherwise(yes(k % p == 0)) for c, p in addons.items()},
        "Contract": F.when(k % 7 == 0, None).when(F.col("c_acctbal") < 0, "Two year")
        .when(F.col("c_acctbal") < 5000, "Month-to-month").otherwise("One year"),
        "PaymentMethod": F.col("c_mktsegment"),
        "Churn": yes(~F.coalesce(F.col("active"), F.lit(False))),
    }
    return df.select(*[cols[c].alias(c) for c in ACCOUNT_COLUMNS])


def scored_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a true label and a score made by the rule of the scored orders."""
    df = accounts(spark, sf_dir).withColumn("y_true", (F.col("Churn") == "Yes").cast("int"))
    df = df.withColumn("id", F.substring("customerID", 2, 8).cast("long"))
    return df.withColumn("y_prob", score_column())
