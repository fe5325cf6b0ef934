"""The fixture tables of ``fixtures.py`` as SQL, and pieces the checks share."""

from __future__ import annotations

import numpy as np

from holdfast.spec import CATEGORICAL, CATEGORICAL_ALL

SCORE = "CAST((350 * {y} + (({id} * 7919 % 10007) * 650) // 10007) AS DOUBLE) / 1000e0"

Y = "(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)"
SCORED = f"""
SELECT o_orderkey AS id, {Y} AS y_true, 'm' || CAST(o_orderkey % 3 AS VARCHAR) AS model,
       o_orderpriority AS segment, o_custkey AS customer,
       {SCORE.format(y=Y, id='o_orderkey')} AS y_prob
FROM orders"""

MODEL_FRAME = f"""
SELECT id, y_true, CAST(y_true AS DOUBLE) AS label,
       y_prob + CAST(id * 104729 % 1009 AS DOUBLE) / 1009e0 AS x1,
       CAST(id * 7907 % 1013 AS DOUBLE) / 1013e0 AS x2,
       (CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END) AS c
FROM ({SCORED})"""

_ADDONS = {"OnlineSecurity": 3, "OnlineBackup": 4, "DeviceProtection": 5, "TechSupport": 7,
           "StreamingTV": 11, "StreamingMovies": 13}


def _yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"


ACCOUNTS = f"""
SELECT 'C' || lpad(CAST(k AS VARCHAR), 8, '0') AS "customerID",
       CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CASE WHEN c_nationkey < 4 THEN 1 ELSE 0 END AS "SeniorCitizen",
       {_yes('c_acctbal >= 4500')} AS "Partner",
       {_yes('k % 3 = 0')} AS "Dependents",
       CAST(coalesce((1997 - year(first_day)) * 12 - month(first_day) + 1, 0) AS INTEGER) AS tenure,
       CASE WHEN k % 10 = 0 THEN 'No' ELSE 'Yes' END AS "PhoneService",
       CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END AS "MultipleLines",
       CASE WHEN k % 6 < 2 THEN 'DSL' WHEN k % 6 = 5 THEN 'No' ELSE 'Fiber optic' END AS "InternetService",
       {', '.join(f"CASE WHEN k % 6 = 5 THEN 'No internet service' WHEN k % {p} = 0 THEN 'Yes' ELSE 'No' END AS " + '"' + c + '"' for c, p in _ADDONS.items())},
       CASE WHEN k % 7 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'Two year'
            WHEN c_acctbal < 5000 THEN 'Month-to-month' ELSE 'One year' END AS "Contract",
       {_yes('k % 5 < 3')} AS "PaperlessBilling", c_mktsegment AS "PaymentMethod",
       CAST(2000 + (k * 37) % 10000 AS DOUBLE) / 100e0 AS "MonthlyCharges",
       coalesce(CAST(spent AS VARCHAR), ' ') AS "TotalCharges",
       {_yes('NOT coalesce(active, false)')} AS "Churn"
FROM (SELECT c_custkey AS k, * FROM customer) LEFT JOIN (
  SELECT o_custkey,
         min(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS first_day,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS spent,
         bool_or(o_orderdate >= TIMESTAMP '1997-01-01') AS active
  FROM orders WHERE o_orderdate < TIMESTAMP '1997-07-01' GROUP BY o_custkey
) ON k = o_custkey"""

NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def to_number(col: str) -> str:
    return f"CASE WHEN regexp_matches(trim({col}), {NUMBER}) THEN TRY_CAST(trim({col}) AS DOUBLE) END"


#: Prepared accounts, blank charges left null / set to 0.
PREPARED = f"""
SELECT * REPLACE ({to_number('"TotalCharges"')} AS "TotalCharges") RENAME ("Churn" AS churn_text),
       CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS label FROM ({ACCOUNTS})"""
PREPARED_ZERO = f"""
SELECT * REPLACE (coalesce("TotalCharges", 0e0) AS "TotalCharges") FROM ({PREPARED})"""

SCORED_ACCOUNTS = f"""
SELECT *, CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS y_true,
       {SCORE.format(y='''(CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END)''', id='CAST(substr("customerID", 2) AS BIGINT)')} AS y_prob
FROM ({ACCOUNTS})"""


def split(src: str, label: str, id_col: str, train: float, validation: float, test: float,
          seed: int = 42) -> str:
    """``src`` with a split column: exact stratified sizes over the md5 order of the ids."""
    share = validation / (train + validation)
    return f"""
SELECT b.* EXCLUDE (rn), CASE WHEN rn <= test_n THEN 'test' WHEN rn <= test_n + val_n THEN 'validation'
       ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({id_col} AS VARCHAR) || '-{seed}'), {id_col}) AS rn
      FROM ({src})) b
JOIN (
  SELECT cls, c - rest AS test_n, rest - (f2 + CASE WHEN pos2 <= d2 - sf2 THEN 1 ELSE 0 END) AS val_n
  FROM (
    SELECT *, sum(f2) OVER () AS sf2, row_number() OVER (ORDER BY e2 - f2 DESC, cls) AS pos2
    FROM (
      SELECT *, CAST(floor(e2) AS BIGINT) AS f2 FROM (
        SELECT *, CAST(rest AS DOUBLE) / d1 * d2 AS e2 FROM (
          SELECT *, d1 - CAST(ceil(d1 * {share!r}::DOUBLE) AS BIGINT) AS d2 FROM (
            SELECT cls, c, d1, f1 + CASE WHEN pos1 <= d1 - sf1 THEN 1 ELSE 0 END AS rest FROM (
              SELECT *, sum(f1) OVER () AS sf1, row_number() OVER (ORDER BY e1 - f1 DESC, cls) AS pos1 FROM (
                SELECT *, CAST(floor(e1) AS BIGINT) AS f1 FROM (
                  SELECT *, CAST(c AS DOUBLE) / n * d1 AS e1 FROM (
                    SELECT *, n - CAST(ceil(n * {test!r}::DOUBLE) AS BIGINT) AS d1 FROM (
                      SELECT {label} AS cls, count(*) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS n
                      FROM ({src}) GROUP BY {label}))))))))))
) s ON b.{label} = s.cls"""


SPLIT_SCORED = split(SCORED, "y_true", "id", 0.6, 0.2, 0.2)
SPLIT_SCORED_70 = split(SCORED, "y_true", "id", 0.70, 0.15, 0.15)
SPLIT_ACCOUNTS = split(PREPARED, "label", '"customerID"', 0.70, 0.15, 0.15)
SPLIT_ACCOUNTS_ZERO = split(PREPARED_ZERO, "label", '"customerID"', 0.6, 0.2, 0.2)


def counts(src: str, by: str = "", pred: str = "CAST(y_prob >= 0.5 AS INTEGER)") -> str:
    """Confusion counts per group, as BIGINT."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}CAST(count(*) FILTER (WHERE y_true = 0 AND p = 0) AS BIGINT) AS tn,
       CAST(count(*) FILTER (WHERE y_true = 0 AND p = 1) AS BIGINT) AS fp,
       CAST(count(*) FILTER (WHERE y_true = 1 AND p = 0) AS BIGINT) AS fn,
       CAST(count(*) FILTER (WHERE y_true = 1 AND p = 1) AS BIGINT) AS tp
FROM (SELECT *, {pred} AS p FROM ({src})) {group}"""


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


RATES = (
    f"{div('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {div('tp', 'tp + fp')} AS precision, "
    f"{div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1"
)


def auc(src: str, by: str = "") -> str:
    """Rank-sum AUC per group; ties count half."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {keys}CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL ELSE
       CAST(sum(CAST(pos AS HUGEINT) * (2 * coalesce(below, 0) + neg)) AS DOUBLE)
       / CAST(2 * CAST(sum(pos) AS HUGEINT) * CAST(sum(neg) AS HUGEINT) AS DOUBLE) END AS roc_auc
FROM (SELECT *, sum(neg) OVER ({part} ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
      FROM (SELECT {keys}y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM ({src})
            GROUP BY {keys}y_prob)) {group}"""


def evaluation(src: str, by: str, pred: str = "CAST(y_prob >= 0.5 AS INTEGER)") -> str:
    return f"SELECT c.*, a.roc_auc, {RATES} FROM ({counts(src, by, pred)}) c JOIN ({auc(src, by)}) a USING ({by})"


def sweep(src: str, thresholds: list[float]) -> str:
    values = ", ".join(f"({t!r}::DOUBLE)" for t in thresholds)
    return f"""
SELECT t AS threshold, CAST(sum(CASE WHEN y_prob >= t THEN y_true ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN y_prob >= t THEN 1 - y_true ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN y_prob < t THEN y_true ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN y_prob < t THEN 1 - y_true ELSE 0 END) AS BIGINT) AS tn
FROM (VALUES {values}) v(t), ({src}) GROUP BY t"""


EDGES = np.linspace(0, 1, 11).tolist()


def bins(value: str, right_closed: bool = False) -> str:
    op = ">" if right_closed else ">="
    return "(" + " + ".join(f"CAST({value} {op} {e!r}::DOUBLE AS INTEGER)" for e in EDGES[1:-1]) + ")"


def calibration(src: str) -> str:
    mids = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))
    return f"""
SELECT bin_index, printf('%.1f - %.1f', lo, hi) AS bin, CAST(pos AS DOUBLE) / n AS actual_rate, n AS "count",
       CAST(pos AS DOUBLE) / n - (lo + hi) / 2e0 AS gap
FROM (SELECT {bins('y_prob')} AS bin_index, count(*) AS n, sum(y_true) AS pos FROM ({src}) GROUP BY 1)
JOIN (VALUES {mids}) e(i, lo, hi) ON i = bin_index"""


RISK = "CASE WHEN {p} >= 0.7 THEN 'high' WHEN {p} >= 0.4 THEN 'medium' ELSE 'low' END"


def mode(src: str, col: str) -> str:
    """Most frequent text, the smallest on ties."""
    return (f"(SELECT CAST({col} AS VARCHAR) FROM ({src}) WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


def long_texts(src: str, cols: tuple[str, ...]) -> str:
    """(feature, value, n) of several columns."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, CAST("{c}" AS VARCHAR) AS value, count(*) AS n FROM ({src}) """
        f"""WHERE "{c}" IS NOT NULL GROUP BY 2""" for c in cols
    )


def modes(src: str, cols: tuple[str, ...]) -> str:
    return f"""
SELECT feature, value AS mode, n FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r FROM ({long_texts(src, cols)})
) WHERE r = 1"""


def categories(src: str, cols: tuple[str, ...]) -> str:
    return f"""
SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS position, value
FROM ({long_texts(src, cols)})"""


# Values of the fixture's categorical columns in text order.
_INTERNET = ("No", "No internet service", "Yes")
LEVELS = {
    "gender": ("Female", "Male"), "SeniorCitizen": ("0", "1"),
    **{c: ("No", "Yes") for c in ("Partner", "Dependents", "PhoneService", "PaperlessBilling")},
    "MultipleLines": ("No", "No phone service", "Yes"), "InternetService": ("DSL", "Fiber optic", "No"),
    **{c: _INTERNET for c in _ADDONS},
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaymentMethod": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
}


def numeric_stats(fit: str, cols: tuple[str, ...]) -> str:
    """feature, median, mean, std over the imputed column."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, max(md) AS median, avg(coalesce(x, md)) AS mean,
        CASE WHEN stddev_pop(coalesce(x, md)) = 0 THEN 1e0 ELSE stddev_pop(coalesce(x, md)) END AS std,
        CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS n_missing
        FROM (SELECT CAST("{c}" AS DOUBLE) AS x, (SELECT median(CAST("{c}" AS DOUBLE)) FROM ({fit})) AS md FROM ({fit}))"""
        for c in cols
    )


def scaled(fit: str, col: str, prefix: str, digits: int = 6) -> str:
    stat = f"(SELECT {{}} FROM (SELECT * FROM ({numeric_stats(fit, (col,))})))"
    x = f'coalesce(CAST("{col}" AS DOUBLE), {stat.format("median")})'
    return f'round(({x} - {stat.format("mean")}) / {stat.format("std")}, {digits}) AS "{prefix}__{col}"'


def flag(fit: str, col: str, prefix: str = "binary") -> str:
    text = f'lower(trim(coalesce(CAST("{col}" AS VARCHAR), {mode(fit, chr(34) + col + chr(34))})))'
    return f"CASE WHEN {text} IN ('yes', 'male', '1', '1.0') THEN 1e0 ELSE 0e0 END AS \"{prefix}__{col}\""


def one_hot(fit: str, cols: tuple[str, ...], prefix: str) -> list[str]:
    out = []
    for c in cols:
        text = f'coalesce(CAST("{c}" AS VARCHAR), {mode(fit, chr(34) + c + chr(34))})'
        out += [f"CASE WHEN {text} = '{v}' THEN 1e0 ELSE 0e0 END AS \"{prefix}__{c}_{v}\"" for v in LEVELS[c]]
    return out


NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges")
ALL_TEXT = CATEGORICAL_ALL
GROUPED_TEXT = CATEGORICAL
