"""Queries over importances and explanations."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import fixtures as fx
from catalog import tables_sql as q
from catalog.base import query, rounded
from catalog.fitting import kept
from catalog.modelling import FEATURES, newton, vectors
from holdfast.operators import explain as ex, models as md, trees as tr

_COEF = newton() + """, coef AS (SELECT 'x1' AS feature, b1 AS coefficient FROM beta UNION ALL SELECT 'x2', b2 FROM beta),
imp AS (SELECT *, abs(coefficient) / sum(abs(coefficient)) OVER () AS importance,
        CASE WHEN coefficient > 0 THEN 'Increases Churn' ELSE 'Decreases Churn' END AS direction FROM coef)"""


def _fitted(spark, sf):
    with kept(vectors(spark, sf)) as rows:
        return md.fit_logistic(rows)


@query("X01_coefficients", f"""{_COEF}
SELECT feature, round(coefficient, 4) AS coefficient, round(abs(coefficient), 4) AS abs_coefficient, direction FROM imp""")
def coefficients(spark, sf):
    return rounded(ex.coefficients(spark, _fitted(spark, sf), FEATURES), 4, "coefficient", "abs_coefficient")


# One tree of depth 2 on two indicators: the root splits on the one with the larger Gini gain, its sides on the other.
# Leaves that predict alike are merged, and then their split counts nothing.
_GINI = "CASE WHEN {n} > 0 THEN 2e0 * ({p}) * ({n} - ({p})) / ({n}) ELSE 0e0 END"


def _gain(n0: str, p0: str, n1: str, p1: str) -> str:
    whole = _GINI.format(n=f"({n0} + {n1})", p=f"({p0} + {p1})")
    return f"({whole} - {_GINI.format(n=n0, p=p0)} - {_GINI.format(n=n1, p=p1)})"


_TREE = f"""WITH marked AS (SELECT CAST(x1 >= 0.7e0 AS INTEGER) AS u, CAST(x1 >= 1e0 AS INTEGER) AS v, y_true FROM ({q.MODEL_FRAME})),
sums AS MATERIALIZED (SELECT {", ".join(
    f"CAST(count(*) FILTER (u = {u} AND v = {v}) AS DOUBLE) AS n{u}{v}, "
    f"CAST(coalesce(sum(y_true) FILTER (u = {u} AND v = {v}), 0) AS DOUBLE) AS p{u}{v}" for u in (0, 1) for v in (0, 1))} FROM marked),
turned AS (SELECT 'u' AS root, 'v' AS inner_, * FROM sums UNION ALL
           SELECT 'v', 'u', n00, p00, n10, p10, n01, p01, n11, p11 FROM sums),
gains AS (SELECT *, {_gain("(n00 + n01)", "(p00 + p01)", "(n10 + n11)", "(p10 + p11)")} AS g,
  n00 >= 5 AND n01 >= 5 AND (2 * p00 > n00) <> (2 * p01 > n01) AS k0, n10 >= 5 AND n11 >= 5 AND (2 * p10 > n10) <> (2 * p11 > n11) AS k1,
  (2 * (p00 + p01) > n00 + n01) <> (2 * (p10 + p11) > n10 + n11) AS apart,
  {_gain("n00", "p00", "n01", "p01")} AS g0, {_gain("n10", "p10", "n11", "p11")} AS g1 FROM turned),
best AS (SELECT * FROM gains ORDER BY g DESC LIMIT 1),
raw AS (SELECT root AS feature, CASE WHEN k0 OR k1 OR apart THEN g ELSE 0 END AS i FROM best UNION ALL
        SELECT inner_, CASE WHEN k0 THEN g0 ELSE 0 END + CASE WHEN k1 THEN g1 ELSE 0 END FROM best),
imp AS (SELECT feature, CASE WHEN sum(i) OVER () > 0 THEN i / sum(i) OVER () ELSE 0 END AS importance FROM raw)"""


@query("X02_tree_importance", f"""{_TREE}
SELECT feature, round(importance, 6) AS importance, CAST(row_number() OVER w AS INTEGER) AS rank,
       round(sum(importance) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative_importance
FROM imp WINDOW w AS (ORDER BY importance DESC, feature)""")
def tree_importance(spark, sf):
    """Importances of one tree on two indicators; a single tree draws no rows and, of two features, takes both."""
    frame = fx.model_frame(spark, sf).withColumns({
        "u": (F.col("x1") >= 0.7).cast("double"), "v": (F.col("x1") >= 1.0).cast("double")})
    with kept(VectorAssembler(inputCols=["u", "v"], outputCol="features").transform(frame)) as rows:
        model = md.fit_forest(rows, trees=1, depth=2)
    return rounded(ex.tree_importance(spark, model, ["u", "v"]), 6, "importance", "cumulative_importance")


_FOREST = (*FEATURES, "c_A", "c_B", "c_C", "c_D")


@query("X02_forest_importance", f"""SELECT feature, true AS agrees FROM (VALUES {", ".join(f"('{n}')" for n in _FOREST)}) v(feature)""")
def forest_importance(spark, sf):
    """Importances of a forest on the numeric features and the category indicators, against those worked out from its nodes."""
    frame = fx.model_frame(spark, sf)
    frame = frame.withColumns({n: (F.col("c") == n[-1]).cast("double") for n in _FOREST[2:]})
    with kept(VectorAssembler(inputCols=list(_FOREST), outputCol="features").transform(frame)) as rows:
        model = md.fit_forest(rows, trees=20, depth=5)
    own = ex.tree_importance(spark, model, _FOREST).select("feature", "importance")
    names = spark.createDataFrame(list(enumerate(_FOREST)), "i int, feature string")
    nodes = tr.node_importance(tr.node_table(spark, model), per_tree=True).select(
        F.col("feature").alias("i"), F.col("importance").alias("of_nodes"))
    agrees = F.abs(F.col("importance") - F.coalesce("of_nodes", F.lit(0.0))) <= 1e-9
    found = own.join(names, "feature").join(nodes, "i", "left")
    return found.select("feature", agrees.alias("agrees"))


@query("X03_feature_importance", f"""{_COEF}
SELECT feature, round(importance, 4) AS importance, round(coefficient, 4) AS coefficient, direction FROM imp""")
def feature_importance(spark, sf):
    return rounded(ex.feature_importance(spark, _fitted(spark, sf), FEATURES), 4, "importance", "coefficient")


@query("W03_cumulative_importance", f"""{_COEF}
SELECT feature, round(importance, 4) AS importance,
       round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 4) AS cumulative_importance
FROM imp""")
def cumulative_importance(spark, sf):
    table = ex.importance_table(ex.feature_importance(spark, _fitted(spark, sf), FEATURES))
    return rounded(table.select("feature", "importance", "cumulative_importance"), 4, "importance", "cumulative_importance")


@query("W04_importance_rank", f"""{_COEF}
SELECT feature, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp""")
def importance_rank(spark, sf):
    table = ex.importance_table(ex.feature_importance(spark, _fitted(spark, sf), FEATURES))
    return table.select("feature", "rank")


@query("X06_importance_listing", f"""{_COEF}
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, '[NUM] ' || feature AS name,
       printf('%.1f%%', importance * 100e0) AS share, round(sum(importance) OVER (), 4) AS explained FROM imp""")
def importance_listing(spark, sf):
    table = ex.feature_importance(spark, _fitted(spark, sf), [f"numeric__{n}" for n in FEATURES])
    return rounded(ex.importance_listing(table).drop("importance"), 4, "explained")


# A given linear model over three columns; weights that doubles hold exactly, so both engines
# get the same products.
_NAMES = ("numeric__x1", "numeric__x2", "binary__y")
_WEIGHTS = (0.5, -1.25, 0.75)


def _explained(spark, sf, top_n):
    frame = fx.model_frame(spark, sf).withColumn("y_prob", fx.score_column())
    values = F.array("x1", "x2", F.col("y_true").cast("double"))
    top = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(abs(w) / 2.5).alias("importance"))
                    for n, w in zip(_NAMES, _WEIGHTS)])
    return ex.explain_rows(frame, ["id"], "y_prob", top, ex.top_contributions(values, _NAMES, _WEIGHTS, top_n))


_SCORED_FRAME = f"SELECT m.*, s.y_prob FROM ({q.MODEL_FRAME}) m JOIN ({q.SCORED}) s USING (id)"
_CONTRIBUTIONS = f"""
SELECT id, y_prob, feature, contribution, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS r
FROM (SELECT id, y_prob, unnest(['numeric__x1', 'numeric__x2', 'binary__y']) AS feature,
             unnest([x1 * 0.5e0, x2 * -1.25e0, CAST(y_true AS DOUBLE) * 0.75e0]) AS contribution FROM ({_SCORED_FRAME}))"""


@query("X04_explain_rows", f"""
SELECT id, CAST(r AS INTEGER) AS rank, feature, contribution, y_prob AS churn_probability,
       CASE WHEN y_prob >= 0.5 THEN 'Will Churn' ELSE 'Will Stay' END AS prediction,
       greatest(y_prob, 1 - y_prob) AS confidence,
       CASE WHEN y_prob >= 0.7 THEN 'High Risk' WHEN y_prob >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level,
       CAST(3 AS INTEGER) AS n_top_features
FROM ({_CONTRIBUTIONS}) WHERE r <= 2""")
def explain_rows(spark, sf):
    rows = _explained(spark, sf, 2)
    long = rows.select("*", F.posexplode("top_contributors").alias("i", "c"))
    return long.select("id", (F.col("i") + 1).alias("rank"), "c.*", "churn_probability", "prediction",
                       "confidence", "risk_level", F.size("top_features").alias("n_top_features"))


@query("X04_explain_fitted", newton() + f""", c AS (SELECT id, b + b1 * x1 + b2 * x2 AS z, unnest(['x1', 'x2']) AS feature,
  unnest([x1 * b1, x2 * b2]) AS contribution FROM ({q.MODEL_FRAME}), beta),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rank FROM c)
SELECT id, rank, feature, round(contribution, 2) AS contribution, round(1 / (1 + exp(-z)), 2) AS churn_probability,
       CASE WHEN z >= 0 THEN 'Will Churn' ELSE 'Will Stay' END AS prediction,
       (SELECT string_agg(f, ',' ORDER BY w DESC) FROM (SELECT unnest(['x1', 'x2']) AS f, unnest([abs(b1), abs(b2)]) AS w FROM beta)) AS top
FROM r""")
def explain_fitted(spark, sf):
    """Contributions, verdict and most important features of a fitted logistic model, for every row."""
    rows = ex.explain_predictions(_fitted(spark, sf), vectors(spark, sf), FEATURES, ["id"], top_n=2)
    top = F.array_join(F.transform("top_features", lambda x: x["feature"]), ",").alias("top")
    long = rows.select("*", top, F.posexplode("top_contributors").alias("i", "c"))
    return rounded(long.select("id", (F.col("i") + 1).alias("rank"), "c.*", "churn_probability", "prediction", "top"), 2,
                   "contribution", "churn_probability")


@query("X05_explanation_text", f"""
SELECT id, concat_ws(chr(10), 'Prediction: ' || CASE WHEN y_prob >= 0.5 THEN 'Will Churn' ELSE 'Will Stay' END,
  'Churn probability: ' || printf('%.1f%%', y_prob * 100e0), 'Risk level: ' || risk,
  'Confidence: ' || printf('%.1f%%', greatest(y_prob, 1 - y_prob) * 100e0), 'Main factors:', factors,
  CASE risk WHEN 'High Risk' THEN 'Next step: call' WHEN 'Medium Risk' THEN 'Next step: write' END) AS explanation
FROM (SELECT id, y_prob,
        CASE WHEN y_prob >= 0.7 THEN 'High Risk' WHEN y_prob >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk,
        string_agg(CAST(r AS VARCHAR) || '. ' || regexp_replace(feature, '^(numeric|binary)__', '') ||
          CASE WHEN contribution > 0 THEN ': raises churn risk' ELSE ': lowers churn risk' END, chr(10) ORDER BY r) AS factors
      FROM ({_CONTRIBUTIONS}) GROUP BY id, y_prob)""")
def explanation_text(spark, sf):
    return ex.explanation_text(_explained(spark, sf, 5), ["id"], actions={"High Risk": "call", "Medium Risk": "write"})
