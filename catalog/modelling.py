"""Queries that train, save, load and score models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import fixtures as fx
from catalog import tables_sql as q
from catalog.base import query, rounded
from catalog.data import _REASONS
from catalog.fitting import ID, kept, split_accounts
from holdfast.operators import metrics as m, models as md, trees as tr
from holdfast.operators.split import fit_splits
from holdfast.session import new_folder
from holdfast.sources import artifacts as art
from holdfast.spec import BASELINE, FeatureSpec
from holdfast.streaming import scoring

FEATURES = ("x1", "x2")


def vectors(spark, sf) -> DataFrame:
    """Model frame with its two numeric features as a vector."""
    frame = fx.model_frame(spark, sf)
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame)


@query("M01_class_weights", f"""
SELECT y_true, count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE)
       / (CAST(count(*) OVER () AS DOUBLE) * CAST(count(*) AS DOUBLE)) AS class_weight
FROM ({q.SCORED}) GROUP BY y_true""")
def class_weights(spark, sf):
    return md.class_weights(fx.scored_orders(spark, sf), "y_true")


def newton(c: float = 1.0, balanced: bool = False, steps: int = 10, frame: str = q.MODEL_FRAME, counts: str = q.SCORED) -> str:
    """CTEs b0 … b{steps}: Newton steps of the L2-penalised logistic objective on (x1, x2) of ``frame``; ``counts`` has its rows
    per class."""
    weight = ("CASE WHEN y_true = 1 THEN n / (2e0 * np) ELSE n / (2e0 * (n - np)) END" if balanced else "1e0")
    ctes = [f"""m AS MATERIALIZED (SELECT x1, x2, CAST(y_true AS DOUBLE) AS y, {weight} AS w
FROM ({frame}), (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y_true) AS DOUBLE) AS np FROM ({counts})))""",
            "b0 AS (SELECT 0e0 AS b, 0e0 AS b1, 0e0 AS b2)"]
    ridge = f"{1.0 / c!r}::DOUBLE"
    for i in range(steps):
        ctes.append(f"""b{i + 1} AS MATERIALIZED (
SELECT b - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS b,
       b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS b1,
       b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS b2
FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d
FROM (SELECT any_value(b) AS b, any_value(b1) AS b1, any_value(b2) AS b2,
  sum(v) AS h00, sum(v * x1) AS h01, sum(v * x2) AS h02,
  sum(v * x1 * x1) + {ridge} AS h11, sum(v * x1 * x2) AS h12, sum(v * x2 * x2) + {ridge} AS h22,
  sum(r) AS g0, sum(r * x1) + any_value(b1) * {ridge} AS g1, sum(r * x2) + any_value(b2) * {ridge} AS g2
FROM (SELECT *, w * p * (1 - p) AS v, w * (p - y) AS r
  FROM (SELECT *, 1 / (1 + exp(-(b + b1 * x1 + b2 * x2))) AS p FROM m, b{i})))))""")
    ctes.append(f"beta AS (SELECT * FROM b{steps})")
    return "WITH " + ",\n".join(ctes)


_COEFFICIENTS = """
SELECT 'intercept' AS feature, round(b, 4) AS coefficient FROM beta
UNION ALL SELECT 'x1', round(b1, 4) FROM beta UNION ALL SELECT 'x2', round(b2, 4) FROM beta"""


def _coefficients(spark, model) -> DataFrame:
    values = zip(("intercept", *FEATURES), (model.intercept, *map(float, model.coefficients)))
    return rounded(spark.createDataFrame(list(values), "feature string, coefficient double"), 4, "coefficient")


@query("M02_logistic_regression", newton() + _COEFFICIENTS)
def logistic_regression(spark, sf):
    with kept(vectors(spark, sf)) as rows:
        return _coefficients(spark, md.fit_logistic(rows))


@query("M02_logistic_balanced_strong", newton(0.01, True) + _COEFFICIENTS)
def logistic_balanced(spark, sf):
    with kept(vectors(spark, sf)) as rows:
        return _coefficients(spark, md.fit_logistic(rows, balanced=True, c=0.01))


#: The models are random in their details; sizes are exact and the quality has a floor.
AUC_FLOOR = 0.7


def _quality_sql(models: str) -> str:
    return f"""
SELECT model, split, count(*) AS n_samples, CAST(sum(y_true) AS BIGINT) AS n_positive, true AS above_floor
FROM ({q.SPLIT_SCORED.replace('EXCLUDE (rn)', 'EXCLUDE (rn, model)')}), (VALUES {models}) v(model)
WHERE split <> 'test' GROUP BY ALL"""


def _split_vectors(spark, sf) -> DataFrame:
    rows = vectors(spark, sf)
    cuts = fit_splits(fx.scored_orders(spark, sf), "y_true", "id")
    return cuts.assign(rows)


def _quality(trained, rows) -> DataFrame:
    scored = md.score_candidates(trained, rows.where("split <> 'test'"), ["split"]).persist()
    record = m.evaluation_record(scored, by=["model", "split"])
    return record.select("model", "split", "n_samples", "n_positive",
                         (F.col("roc_auc") > AUC_FLOOR).alias("above_floor"))


def _train(spark, sf, *names, **params):
    rows = _split_vectors(spark, sf)
    with kept(rows.where("split = 'train'")) as train:
        trained = md.train_candidates(train, "id", names or None, params=params)
    return trained, rows


@query("M03_random_forest", _quality_sql("('random_forest')"))
def random_forest(spark, sf):
    return _quality(*_train(spark, sf, "random_forest"))


@query("M04_gradient_boosting", _quality_sql("('gradient_boosting')"))
def gradient_boosting(spark, sf):
    return _quality(*_train(spark, sf, "gradient_boosting"))


@query("M04_first_rounds", f"SELECT count(*) AS n_rows, 4 AS n_trees, CAST(4 AS BIGINT) AS n_equal FROM ({q.MODEL_FRAME})")
def first_rounds(spark, sf):
    """Losses of a boosted model cut to four trees that equal those of the long fit, bit for bit."""
    with kept(vectors(spark, sf).select("label", "features")) as rows:
        model = md.gradient_boosting(8).fit(rows)
        cut = tr.first_trees(spark, model, 4)
        equal = sum(a == b for a, b in zip(cut.evaluateEachIteration(rows), model.evaluateEachIteration(rows)))
        return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            "n_rows", F.lit(cut.getNumTrees).alias("n_trees"), F.lit(equal).cast("long").alias("n_equal"))


_SMALL = {"random_forest": {"trees": 10, "depth": 5}, "gradient_boosting": {"rounds": 15}}


@query("M05_model_catalog", f"""
SELECT name, title, count(*) AS n_scored FROM ({q.SCORED}), (VALUES ('logistic_regression', 'Logistic Regression'),
('random_forest', 'Random Forest'), ('gradient_boosting', 'Gradient Boosting')) v(name, title) GROUP BY ALL""")
def model_catalog(spark, sf):
    trained, rows = _train(spark, sf, **_SMALL)
    titles = F.create_map(*[F.lit(x) for k, c in md.CANDIDATES.items() for x in (k, c.title)])
    scored = md.score_candidates(trained, rows).groupBy(F.col("model").alias("name"))
    return scored.agg(F.count("y_prob").alias("n_scored")).withColumn("title", titles[F.col("name")])


def _baseline(spark, sf) -> tuple[PipelineModel, DataFrame]:
    rows = split_accounts(spark, sf).persist()
    return md.fit_pipeline(rows.where("split = 'train'"), BASELINE, balanced=True).model, rows


@query("M06_fit_with_preprocessing", f"""
SELECT split, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_positive, count(*) AS n_scored
FROM ({q.SPLIT_ACCOUNTS}) GROUP BY split""")
def fit_with_preprocessing(spark, sf):
    model, rows = _baseline(spark, sf)
    return md.score(model, rows, ["split", "label"]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("label").cast("long")).alias("n_positive"),
        F.count_if(F.col("y_prob").between(0, 1)).alias("n_scored"),
    )


_GAPS = FeatureSpec(numeric=FEATURES, id_cols=("id",))
_GAPS_FRAME = f"""SELECT id, y_true, (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS x1, (x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER () AS x2
FROM (SELECT id, y_true, x1, coalesce(x2, median(x2) OVER ()) AS x2
      FROM (SELECT id, y_true, x1, CASE WHEN id % 11 <> 0 THEN x2 END AS x2 FROM ({q.MODEL_FRAME})))"""
_GAPS_SQL = newton(frame=_GAPS_FRAME) + f"""
SELECT id, round(1 / (1 + exp(-(b + b1 * x1 + b2 * x2))), 2) AS y_prob, CAST(b + b1 * x1 + b2 * x2 > 0 AS INTEGER) AS y_pred
FROM ({_GAPS_FRAME}), beta"""


def _gaps(spark, sf) -> tuple[PipelineModel, DataFrame]:
    """A pipeline that imputes and scales, fitted on a column with gaps."""
    rows = fx.model_frame(spark, sf).withColumn("x2", F.when(F.col("id") % 11 != 0, F.col("x2")))
    with kept(rows.select("id", "label", *FEATURES)) as train:
        return md.fit_pipeline(train, _GAPS).model, rows


@query("M06_pipeline_probabilities", _GAPS_SQL)
def pipeline_probabilities(spark, sf):
    return rounded(md.score(*_gaps(spark, sf), ["id"]), 2, "y_prob")


@query("S05_loaded_probabilities", _GAPS_SQL)
def loaded_probabilities(spark, sf):
    model, rows = _gaps(spark, sf)
    path = art.save_model(model, new_folder(spark, "model"))
    return rounded(md.score(art.load_model(path), rows, ["id"]), 2, "y_prob")


@query("M07_train_candidates", _quality_sql("('logistic_regression'), ('random_forest'), ('gradient_boosting')"))
def train_candidates(spark, sf):
    return _quality(*_train(spark, sf, **_SMALL))


@query("M08_score_table", newton() + f"""
SELECT id, CAST(b + b1 * x1 + b2 * x2 > 0 AS INTEGER) AS y_pred, round(1 / (1 + exp(-(b + b1 * x1 + b2 * x2))), 2) AS y_prob
FROM ({q.MODEL_FRAME}), beta""")
def score_table(spark, sf):
    with kept(vectors(spark, sf)) as rows:
        model = md.fit_logistic(rows)
    return rounded(md.score(model, vectors(spark, sf), ["id"]), 2, "y_prob")


@query("M09_scoring_record", f"""
SELECT id, round(y_prob, 4) AS churn_probability, y_prob >= 0.5 AS churn_prediction,
       {q.RISK.format(p='y_prob')} AS risk_level, round(greatest(y_prob, 1 - y_prob), 4) AS confidence FROM ({q.SCORED})""")
def scoring_record(spark, sf):
    return md.scoring_record(fx.scored_orders(spark, sf), keep=["id"])


@query("S04_save_model", f"SELECT count(*) AS n_rows, count(*) AS n_equal FROM ({q.PREPARED})")
def save_model(spark, sf):
    """Scores before saving and after loading, row by row."""
    model, rows = _baseline(spark, sf)
    path = art.save_model(model, new_folder(spark, "model"))
    before = md.score(model, rows, [ID]).withColumnRenamed("y_prob", "p")
    after = md.score(art.load_model(path), rows, [ID])
    return before.select(ID, "p").join(after, ID).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p") == F.col("y_prob")).alias("n_equal")
    )


@query("S05_load_model", f'SELECT "customerID", true AS scored FROM ({q.PREPARED})')
def load_model(spark, sf):
    model, rows = _baseline(spark, sf)
    loaded = art.load_model(art.save_model(model, new_folder(spark, "model")))
    return md.score(loaded, rows, [ID]).select(ID, F.col("y_prob").between(0, 1).alias("scored"))


_TWO = FeatureSpec(numeric=("tenure", "MonthlyCharges"), id_cols=(ID,))
_TRAIN_TWO = f"""SELECT "customerID" AS id, label AS y_true, CAST(tenure AS DOUBLE) AS t, "MonthlyCharges" AS c
FROM ({q.SPLIT_ACCOUNTS}) WHERE split = 'train'"""
_SCALED_TWO = f"""SELECT id, y_true, (t - avg(t) OVER ()) / stddev_pop(t) OVER () AS x1, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS x2
FROM ({_TRAIN_TWO})"""


@query("M10_streaming_scores", newton(frame=_SCALED_TWO) + f""",
s AS (SELECT avg(t) AS mt, stddev_pop(t) AS st, avg(c) AS mc, stddev_pop(c) AS sc FROM ({_TRAIN_TWO})),
r AS (SELECT *, 1 / (1 + exp(-(b + b1 * (tenure - mt) / st + b2 * ("MonthlyCharges" - mc) / sc))) AS p,
        concat_ws(',', CASE WHEN tenure < 0 OR tenure > 100 THEN 'tenure' END, {_REASONS}) AS reasons
      FROM ({q.ACCOUNTS}), beta, s)
SELECT "customerID", CASE WHEN reasons = '' THEN 'scored' ELSE 'rejected' END AS route, reasons,
       CASE WHEN reasons = '' THEN round(round(p, 4), 2) END AS churn_probability, CASE WHEN reasons = '' THEN p >= 0.5 END AS churn_prediction,
       CASE WHEN reasons = '' THEN {q.RISK.format(p='p')} END AS risk_level FROM r
UNION ALL SELECT NULL, 'rejected', 'unreadable', NULL, NULL, NULL FROM r WHERE CAST(substr("customerID", 2) AS BIGINT) % 50 = 1""")
def streaming_scores(spark, sf):
    """Records land as files, some cut off in the middle; a stream validates and scores them into one folder per route."""
    rows = split_accounts(spark, sf)
    model = md.fit_pipeline(rows.where("split = 'train'"), _TWO).model
    records = fx.accounts(spark, sf).drop("Churn")
    landing, out = new_folder(spark, "records"), new_folder(spark, "scores")
    records.write.json(landing)
    text = F.to_json(F.struct(*records.columns))
    half = records.where(F.substring("customerID", 2, 8).cast("long") % 50 == 1).select(
        F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
    half.write.mode("append").text(landing)
    stream = scoring.read_record_stream(spark, landing, records.schema)
    scoring.write_scores(stream, model, out, new_folder(spark, "stream"), [ID]).awaitTermination()
    found = spark.read.parquet(out).select(
        ID, "route", F.array_join("reasons", ",").alias("reasons"), "churn_probability", "churn_prediction", "risk_level")
    return rounded(found, 2, "churn_probability")
