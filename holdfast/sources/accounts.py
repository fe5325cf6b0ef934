"""Reading raw snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import scalars as fn
from holdfast.spec import ACCOUNT_SCHEMA, REQUIRED_COLS


def _typed(field: T.StructField):
    """A text column in the type of the schema; missing texts become null, and so does NaN."""
    text = F.when(~fn.is_missing_token(field.name), F.col(field.name))
    if isinstance(field.dataType, T.StringType):
        return text.alias(field.name)
    number = fn.to_number(text)
    if isinstance(field.dataType, T.IntegralType):
        whole = F.when(
            (number != F.floor(number)) | (text.isNotNull() & number.isNull()),
            F.raise_error(F.concat(F.lit(f"{field.name} is not a whole number: "), text)),
        )
        number = F.coalesce(whole.cast("double"), number)
    return number.cast(field.dataType).alias(field.name)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = ACCOUNT_SCHEMA,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header, columns cast to ``schema``; others stay text. Files whose headers differ fail when read.

    Nothing is inferred, so the files are read once. ``multi_line`` allows line breaks inside
    quotes but then a file cannot be split over tasks.
    """
    # Without enforceSchema the header of every file is compared with the columns when it is read.
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).option(
        "enforceSchema", False)
    try:
        raw = reader.csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no data at {path}") from error
        raise
    types = {f.name: f for f in schema.fields}
    return raw.select(*[_typed(types.get(c, T.StructField(c, T.StringType()))) for c in raw.columns])


#: Reasons of a quarantined row.
TOO_FEW, TOO_MANY = "too few fields", "too many fields"
QUARANTINE = ("reject_reason", "reject_line", "source_file")


def read_csv_checked(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = ACCOUNT_SCHEMA,
) -> DataFrame:
    """``read_csv`` that keeps rows whose number of fields is not that of the header, in the same pass.

    Such a row has a ``reject_reason``, its text in ``reject_line`` and null in all columns of the data; every row names its
    ``source_file``. ``good_rows`` and ``reject_counts`` take it apart; written by ``reject_reason``, it is read once for both.
    """
    names, line = read_csv(spark, path, schema).columns, "__line"
    # rows are cut into all their fields: the number of those that a query needs would tell nothing
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in (*names, line)])).option(
        "header", True).option("escape", '"').option("enforceSchema", False).option("columnPruning", False).option(
        "columnNameOfCorruptRecord", line).csv(path)
    types = {f.name: f for f in schema.fields}
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")  # commas inside quotes part no fields
    many = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) >= len(names)
    # Spark refuses to read the text of malformed rows alone, so another column takes part; and a test for null would be pushed
    # into the parser, which settles it before it knows that a row is malformed
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    bad = (size(line) > 0) & (size(fn.quoted(names[0])) >= 0)
    # a rejected row has its fields in the wrong places: none is typed
    kept = raw.withColumns({n: F.when(~bad, F.col(fn.quoted(n))) for n in names})
    return kept.select(
        *[_typed(types.get(n, T.StructField(n, T.StringType()))) for n in names],
        F.when(bad, F.when(many, TOO_MANY).otherwise(TOO_FEW)).alias(QUARANTINE[0]),
        F.col(line).alias(QUARANTINE[1]), F.col("_metadata.file_name").alias(QUARANTINE[2]),
    )


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where("reject_reason is null").drop(*QUARANTINE)


def reject_counts(checked: DataFrame) -> DataFrame:
    """(source_file, reject_reason, n): a row per file and reason."""
    bad = checked.where("reject_reason is not null")
    return bad.groupBy("source_file", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet snapshot; NaN in a floating column becomes null."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no data at {path}") from error
        raise
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


def require_rows(df: DataFrame) -> DataFrame:
    """The same table, or an error if it holds no row."""
    if df.isEmpty():
        raise ValueError("the data is empty")
    return df


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLS) -> DataFrame:
    """The same table, or an error naming the missing columns. Looks at the schema only."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def load_accounts(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED_COLS) -> DataFrame:
    """CSV snapshot that is known to have rows and the required columns."""
    return require_columns(require_rows(read_csv(spark, path)), required)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header that keeps blanks at both ends of a text."""
    df.write.mode(mode).option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
