"""Column expressions. All of them stay in the JVM; none is a user function."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# Field texts a CSV reader takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Texts (stripped, lower case) that a two-valued feature knows.
TRUE_TEXTS = ("yes", "male", "1", "1.0")
FALSE_TEXTS = ("no", "female", "0", "0.0")
# Lower bounds of the two upper risk classes.
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without white space at both ends (every Unicode space, not only blanks)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def blank(c: Column | str) -> Column:
    """True for text made of white space only; false for null."""
    return F.coalesce(strip(c) == "", F.lit(False))


def is_missing_token(c: Column | str) -> Column:
    return _col(c).isin(*MISSING_TOKENS)


def to_number(c: Column | str) -> Column:
    """Decimal text as double; anything else becomes null instead of failing the job."""
    text = strip(_col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def binary_flag(c: Column | str) -> Column:
    """1.0 for yes/male/1/1.0 in any case, 0.0 for everything else."""
    return F.when(F.lower(strip(_col(c).cast("string"))).isin(*TRUE_TEXTS), 1.0).otherwise(0.0)


def unmapped_flag(c: Column | str) -> Column:
    """True where :func:`binary_flag` says 0 only because it does not know the text."""
    known = F.lower(strip(_col(c).cast("string"))).isin(*TRUE_TEXTS, *FALSE_TEXTS)
    return _col(c).isNotNull() & ~known


def hard_label(prob: Column | str, threshold: float = 0.5) -> Column:
    """1 where the probability reaches the threshold (a tie is positive)."""
    return (_col(prob) >= F.lit(float(threshold))).cast("int")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, 0 where b is 0."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def checked_score(prob: Column | str) -> Column:
    """The score as double; a null or NaN one fails the job."""
    p = _col(prob).cast("double")
    return F.when(p.isNotNull() & ~F.isnan(p), p).otherwise(F.raise_error(F.lit("a row has no score")).cast("double"))


def checked_label(label: Column | str, what: str = "label") -> Column:
    """The label as int; anything but 0 and 1 fails the job."""
    c = _col(label)
    shown = F.concat(F.lit(f"the {what} is neither 0 nor 1: "), F.coalesce(c.cast("string"), F.lit("null")))
    good = c.cast("double").isin(0.0, 1.0)
    return F.when(good, c.cast("int")).otherwise(F.raise_error(shown).cast("int"))


def risk_level(prob: Column | str) -> Column:
    """high / medium / low, decided on the unrounded probability; a null or NaN one fails the job."""
    p = checked_score(prob)
    return F.when(p >= HIGH_RISK, "high").when(p >= MEDIUM_RISK, "medium").otherwise("low")


def risk_title(prob: Column | str) -> Column:
    """The same classes in the wording of explanations."""
    return F.concat(F.initcap(risk_level(prob)), F.lit(" Risk"))


def fixed(c: Column | str, digits: int, sign: bool = False) -> Column:
    """Number text with a fixed count of decimals.

    ``format_number`` with a pattern rounds the exact binary value, ties to even, as C and
    Python do; ``format_string`` rounds the shortest decimal text half up (0.285 -> 0.29).
    """
    body = "0." + "0" * digits if digits else "0"
    pattern = f"+{body};-{body}" if sign else body
    return F.call_function("format_number", _col(c).cast("double"), F.lit(pattern))


def signed(c: Column | str, digits: int = 2) -> Column:
    """Fixed decimals with a sign; zero is positive."""
    return fixed(c, digits, sign=True)


def percent(c: Column | str, digits: int = 1) -> Column:
    """A share as percent text."""
    return F.concat(fixed(_col(c) * F.lit(100.0), digits), F.lit("%"))


def bin_label(low: Column, high: Column) -> Column:
    """``0.1 - 0.2``."""
    return F.concat(fixed(low, 1), F.lit(" - "), fixed(high, 1))


def bucket_index(col: str, edges: Sequence[float], right_closed: bool = False) -> Column:
    """How many of the ascending ``edges`` lie at or below the value.

    ``right_closed`` counts only edges strictly below it. A balanced CASE tree, so a sweep over
    80 thresholds costs seven comparisons a row inside generated code. Null stays null.
    """
    edges = [float(e) for e in edges]
    if edges != sorted(edges):
        raise ValueError("edges must ascend")
    name, op = quoted(col), ">" if right_closed else ">="

    def build(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"case when {name} {op} {double(edges[mid])} then {build(mid + 1, hi)} else {build(lo, mid)} end"

    return F.expr(f"case when {name} is not null then {build(0, len(edges))} end")


def quoted(name: str) -> str:
    """Column name for a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def double(value: float) -> str:
    """Exact double literal for a SQL expression."""
    return f"{float(value)!r}D" if math.isfinite(value) else f"double('{value}')"


def text(value: str) -> str:
    """String literal for a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def category_text(name: str) -> str:
    """SQL of a column's category text. A number has one text whatever type holds it: whole ones without a fraction, decimals
    without closing zeros. ``typeof`` is settled when the expression meets a table, so that a saved stage follows the type."""
    col = quoted(name)
    plain = f"cast({col} as string)"
    number = f"try_cast({plain} as double)"
    return (
        f"case when typeof({col}) in ('double', 'float') and abs({number}) < 1e15 and {number} = floor({number})"
        f" then cast(cast({number} as bigint) as string)"
        f" when typeof({col}) like 'decimal%' then regexp_replace({plain}, '[.]0*$|([.][0-9]*[1-9])0+$', '$1')"
        f" else {plain} end"
    )
