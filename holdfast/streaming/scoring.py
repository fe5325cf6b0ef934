"""Scoring of arriving records. The same function serves tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from holdfast.functions import scalars as fn
from holdfast.operators.clean import strip_strings, text_to_number, validate_records

SCORED, REJECTED = "scored", "rejected"
#: Column with the text of a record that could not be read, and its reason.
RECORD, UNREADABLE = "unreadable_record", "unreadable"


def score_records(df: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """Every record with its route: scored ones with the response, rejected ones with reasons.

    A record that could not be read (``unreadable_record`` holds its text) is rejected for that alone. Row by row and without
    state, so it runs on a stream as it does on a table.
    """
    checked = validate_records(df)
    if RECORD in df.columns:
        bad = F.col(RECORD).isNotNull()
        checked = checked.withColumn("reasons", F.when(bad, F.array(F.lit(UNREADABLE))).otherwise(F.col("reasons")))
        keep = [*keep, RECORD]
    checked = strip_strings(checked, [c for c, kind in checked.dtypes if kind == "string" and c != RECORD])
    scored = model.transform(text_to_number(checked, "TotalCharges"))
    valid = F.size("reasons") == 0
    p = F.when(valid, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(
        *keep, F.when(valid, SCORED).otherwise(REJECTED).alias("route"), "reasons",
        F.round(p, 4).alias("churn_probability"), (p >= 0.5).alias("churn_prediction"),
        F.when(valid, fn.risk_level(p)).alias("risk_level"),
        F.round(F.greatest(p, F.lit(1.0) - p), 4).alias("confidence"),
    )


def read_record_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Records from files as they land in a folder. JSON that is malformed or has a value of another type keeps its text in
    ``unreadable_record`` and is null elsewhere or in part."""
    if fmt == "json":
        schema = T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())])
    reader = spark.readStream.schema(schema).format(fmt).option("columnNameOfCorruptRecord", RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_scores(
    stream: DataFrame, model: Model, out: str, checkpoint: str, keep: Sequence[str],
    interval: str | None = None,
) -> StreamingQuery:
    """Start scoring into parquet, one folder per route.

    The file sink and the checkpoint together write each record exactly once, also after a
    restart. Without ``interval`` the query takes what is there and stops.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        score_records(stream, model, keep).writeStream.format("parquet").partitionBy("route")
        .option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**trigger).start()
    )
