"""Cleaning, target encoding, record validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import scalars as fn
from holdfast.session import written
from holdfast.spec import BINARY, CATEGORICAL, GROUPED, FeatureSpec


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _number(df: DataFrame, col: str) -> Column:
    """The column as double; only text needs parsing."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return fn.to_number(col)
    return F.col(col).cast("double")


def strip_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """White space removed at both ends of every string column (or of ``cols``)."""
    return df.withColumns({c: fn.strip(c) for c in (cols or _string_columns(df))})


def text_to_number(df: DataFrame, col: str) -> DataFrame:
    """Text column as double, unreadable text as null."""
    return df.withColumn(col, _number(df, col))


def blank_charges_to_zero(
    df: DataFrame, col: str = "TotalCharges", tenure: str = "tenure", strict: bool = False
) -> DataFrame:
    """Charges as double with 0.0 for blank or unreadable text.

    That is only right for accounts that have not started yet, so the tenure over those rows
    must not sum to more than zero (``strict``: no single row may be above zero). The check is
    one aggregate over two columns and runs here, before anything reads the result.
    """
    _refuse_blank(col, tenure, *df.agg(*_blank_tenure(df, col, tenure)).first(), strict)
    return _zeroed(df, col)


def _charges(df: DataFrame, col: str) -> Column:
    return F.nanvl(_number(df, col), F.lit(None))


def _blank_tenure(df: DataFrame, col: str, tenure: str) -> list[Column]:
    suspect = F.when(_charges(df, col).isNull(), F.col(tenure))
    return [F.sum(suspect).alias("blank_total"), F.max(suspect).alias("blank_worst")]


def _refuse_blank(col: str, tenure: str, total, worst, strict: bool = False) -> None:
    if ((worst if strict else total) or 0) > 0:
        raise ValueError(f"{col} is blank for rows with {tenure} > 0")


def _zeroed(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(_charges(df, col), F.lit(0.0)))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Without identifier columns; names that are absent are ignored."""
    return df.drop(*cols)


def encode_target_strict(
    df: DataFrame, target: str, positive: str = "Yes", negative: str = "No", label: str = "label",
    show: int = 20,
) -> DataFrame:
    """Target text as 1/0 in ``label``; raises when any other value occurs, naming ``show`` and counting the rest."""
    code = _target_code(df, target, positive, negative)
    _refuse_targets(df, target, code, show)
    return df.withColumn(label, code).drop(*([target] if target != label else []))


def _target_code(df: DataFrame, target: str, positive: str, negative: str) -> Column:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return F.when(F.col(target) == positive, 1).when(F.col(target) == negative, 0)


def _refuse_targets(df: DataFrame, target: str, code: Column, show: int = 20) -> None:
    value = F.col(target)
    others = df.where(code.isNull()).select(value).distinct()
    bad = others.orderBy(value).limit(show).collect()
    if bad:
        more = others.count() - len(bad)
        raise ValueError(f"unexpected values in {target}: {[r[0] for r in bad]}" + (f" and {more} more" if more else ""))


def encode_target_lenient(
    df: DataFrame, target: str, positive: str = "Yes", label: str | None = None
) -> DataFrame:
    """1 where the text is the positive one, 0 for everything else including null."""
    code = F.coalesce(F.col(target) == positive, F.lit(False)).cast("int")
    return df.withColumn(label or target, code)


def select_features(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns in the order of the spec, ``keep`` before them, the rest dropped."""
    return df.select(*keep, *spec.features)


def account_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """(reason, condition that makes a record invalid) for an account record.

    A plain-text feature only has to be present: a value never seen in training is valid.
    """
    tenure, monthly, total, senior = (
        _number(df, c) for c in ("tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen")
    )

    def bad(valid: Column) -> Column:
        return ~F.coalesce(valid, F.lit(False))

    # The ranges and choices a record may hold.
    rules = [
        ("tenure", bad(tenure.between(0, 100) & (tenure == F.floor(tenure)))),
        ("MonthlyCharges", bad((monthly >= 0) & ~F.isnan(monthly))),
        ("TotalCharges", bad((total >= 0) & ~F.isnan(total))),
        ("SeniorCitizen", bad(senior.isin(0.0, 1.0))),
    ]
    choices = {"gender": ("Male", "Female")}
    rules += [
        (c, bad(F.col(c).isin(*choices.get(c, ("Yes", "No")))))
        for c in BINARY
        if c != "SeniorCitizen"
    ]
    rules += [(c, F.col(c).isNull()) for c in CATEGORICAL]
    order = {c: i for i, c in enumerate(GROUPED.features)}
    return sorted(rules, key=lambda rule: order[rule[0]])


def validate_records(
    df: DataFrame, rules: Sequence[tuple[str, Column]] | None = None, reasons: str = "reasons"
) -> DataFrame:
    """Every record with the list of fields that are not acceptable; empty means valid."""
    rules = account_rules(df) if rules is None else rules
    found = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])
    return df.withColumn(reasons, F.array_compact(found))


def split_valid(df: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) views of a validated table."""
    return df.where(F.size(reasons) == 0).drop(reasons), df.where(F.size(reasons) > 0)


def prepare(df: DataFrame, spec: FeatureSpec, mode: str = "impute", label: str = "label") -> DataFrame:
    """Raw snapshot to modelling table: ids, features in order, integer label.

    ``impute`` strips all text, leaves blank charges null for the imputer and refuses unknown
    targets; ``zero`` turns blank charges into 0.0 (guarded) and takes other targets as negative.
    The id stays beside the features, since splitting and leakage checks need it.
    """
    if mode == "impute":
        df = text_to_number(strip_strings(df), "TotalCharges")
        df = encode_target_strict(df, spec.target, spec.positive, spec.negative, label)
    elif mode == "zero":
        df = blank_charges_to_zero(df)
        df = encode_target_lenient(df, spec.target, spec.positive, label)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.select(*spec.id_cols, *spec.features, label)


def prepare_written(df: DataFrame, spec: FeatureSpec, mode: str = "impute", label: str = "label") -> DataFrame:
    """What ``prepare`` gives, as a table written in one pass over ``df``.

    The checks read what was written, one narrow column of it; if one fails, the same error is raised and the table is not
    returned. (An ``Observation`` would save even that, but once a session has made one, models that were trained in it can no
    longer be sent to tasks.)
    """
    suspect = F.lit(None).cast("double")
    if mode == "impute":
        df = text_to_number(strip_strings(df), "TotalCharges")
        code = _target_code(df, spec.target, spec.positive, spec.negative)
        ready = df.withColumn(label, code)
    elif mode == "zero":
        suspect = F.when(_charges(df, "TotalCharges").isNull(), F.col("tenure"))
        ready = _zeroed(df.withColumn("__suspect", suspect), "TotalCharges")
        ready, suspect = encode_target_lenient(ready, spec.target, spec.positive, label), F.col("__suspect")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = written(ready.select(*spec.id_cols, *spec.features, label, suspect.alias("__suspect")), "prepared")
    unknown, total, worst = out.agg(F.count_if(F.col(label).isNull()), F.sum("__suspect"), F.max("__suspect")).first()
    if unknown:
        _refuse_targets(df, spec.target, code)  # read again only to name the values
    _refuse_blank("TotalCharges", "tenure", total, worst)
    return out.drop("__suspect")
