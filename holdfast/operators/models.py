"""Training and scoring with Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as fn
from holdfast.operators.metrics import compare_models
from holdfast.operators.preprocess import FittedPreprocessor, fit_preprocessor
from holdfast.operators.split import early_stopping_indicator
from holdfast.operators.trees import first_trees
from holdfast.session import ensure_checkpoint_dir, written
from holdfast.spec import FeatureSpec

WEIGHT = "class_weight"


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class): one row a class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double")).scalar()
    classes = counts.agg(F.count(F.lit(1)).cast("double")).scalar()
    return counts.withColumn(WEIGHT, total / (classes * F.col("n").cast("double")))


def _class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """Rows of class 0 and class 1; anything else in the label is an error."""
    value = F.col(label)
    negative, positive, rows = df.agg(
        F.count_if(value == 0), F.count_if(value == 1), F.count(F.lit(1))
    ).first()
    if negative + positive != rows:
        raise ValueError(f"{label} must be 0 or 1")
    if not negative or not positive:
        raise ValueError(f"{label} needs rows of both classes")
    return negative, positive


def _balanced(df: DataFrame, label: str, negative: int, positive: int) -> DataFrame:
    rows = negative + positive
    weight = F.when(F.col(label) == 1, rows / (2 * positive)).otherwise(rows / (2 * negative))
    return df.withColumn(WEIGHT, weight)


def with_balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """The table with the weight of each row's class: two numbers, found once, as literals."""
    return _balanced(df, label, *_class_counts(df, label))


def logistic_regression(
    total_weight: float, c: float = 1.0, max_iter: int = 1000, features: str = "features",
    label: str = "label", weight: str | None = None,
) -> LogisticRegression:
    """L2 logistic regression with inverse strength ``c``.

    The penalty of that convention is not averaged over the rows, Spark's is; dividing by the
    total weight makes both the same objective. Standardizing inside would penalise scaled
    coefficients instead, so it is off.
    """
    model = LogisticRegression(
        featuresCol=features, labelCol=label, regParam=1.0 / (c * total_weight),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10, family="binomial",
    )
    return model.setWeightCol(weight) if weight else model


def random_forest(
    trees: int = 100, depth: int = 10, leaf: int = 5, seed: int = 42, features: str = "features",
    label: str = "label",
) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024,
    )


def gradient_boosting(
    rounds: int = 100, depth: int = 3, rate: float = 0.1, leaf: int = 5, seed: int = 42,
    features: str = "features", label: str = "label",
) -> GBTClassifier:
    return GBTClassifier(
        featuresCol=features, labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate,
        minInstancesPerNode=leaf, seed=seed, maxMemoryInMB=1024,
    )


def rounds_to_keep(losses: Sequence[float], patience: int = 10, tol: float = 1e-4) -> int:
    """Rounds until the loss no longer beats, by ``tol``, any of the last ``patience`` improvements."""
    recent = [float("inf")] * patience
    for i, loss in enumerate(losses):
        if not any(loss + tol < old for old in recent):
            return i + 1
        recent[i % patience] = loss
    return len(losses)


def fit_logistic(
    train: DataFrame, balanced: bool = False, label: str = "label", features: str = "features",
    **params,
) -> Model:
    counts = _class_counts(train, label)
    if balanced:
        train = _balanced(train, label, *counts)
    total = float(sum(counts))  # balanced weights sum to the number of rows
    return logistic_regression(
        total, label=label, features=features, weight=WEIGHT if balanced else None, **params
    ).fit(train)


def fit_forest(train: DataFrame, label: str = "label", features: str = "features", **params) -> Model:
    return random_forest(label=label, features=features, **params).fit(train)


def fit_boosting(
    train: DataFrame, id_col: str, label: str = "label", features: str = "features",
    rounds: int = 100, held_out: float = 0.1, patience: int = 10, tol: float = 1e-4,
    seed: int = 42, **params,
) -> Model:
    """Boosted trees, stopped early on a stratified held-out part.

    Spark stops at the first round without progress; patience needs the loss of every round, so
    the model is fitted once, its rounds are judged on the held-out rows in one pass, and if
    fewer are enough its first trees are kept.
    """
    ensure_checkpoint_dir(train.sparkSession)
    flagged = early_stopping_indicator(train, label, id_col, held_out, seed)
    fit_on = flagged.where(~F.col("is_valid")).select(features, label)
    judge = flagged.where("is_valid").select(features, label)
    model = gradient_boosting(rounds, label=label, features=features, seed=seed, **params).fit(fit_on)
    keep = rounds_to_keep(model.evaluateEachIteration(judge), patience, tol)
    return model if keep == model.getNumTrees else first_trees(train.sparkSession, model, keep)


@dataclass(frozen=True)
class Candidate:
    title: str
    fit: Callable[..., Model]


#: Models by name. ``fit(train, id_col=…)`` returns a fitted Spark ML model.
CANDIDATES: dict[str, Candidate] = {
    "logistic_regression": Candidate("Logistic Regression", lambda df, id_col, **p: fit_logistic(df, **p)),
    "random_forest": Candidate("Random Forest", lambda df, id_col, **p: fit_forest(df, **p)),
    "gradient_boosting": Candidate("Gradient Boosting", lambda df, id_col, **p: fit_boosting(df, id_col, **p)),
}


@dataclass(frozen=True)
class FittedPipeline:
    """Preprocessing and classifier. ``model`` is one artifact of built-in stages; where a column has very many categories it
    holds the classifier alone, and rows meet their slots in ``ready``."""

    model: PipelineModel
    preprocessor: FittedPreprocessor

    def ready(self, df: DataFrame) -> DataFrame:
        """What ``model`` takes."""
        return self.preprocessor.assemble(df) if self.preprocessor.large else df

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return score(self.model, self.ready(df), keep)


def fit_pipeline(
    train: DataFrame, spec: FeatureSpec, name: str = "logistic_regression", label: str = "label",
    listed: int | None = None, **params,
) -> FittedPipeline:
    """Learn preprocessing and classifier from the same training rows."""
    fitted = fit_preprocessor(train, spec, listed=listed)
    stages = [] if fitted.large else fitted.stages(train)
    ready = fitted.assemble(train) if fitted.large else PipelineModel(stages).transform(train)
    id_col = spec.id_cols[0]
    # read again, rows lie in as many parts as their bytes ask for, not in one per shuffle partition: every step of a fit sends
    # the driver a result per part
    ready = written(ready.select(id_col, label, "features"), "features").persist()
    try:
        model = CANDIDATES[name].fit(ready, id_col=id_col, label=label, **params)
    finally:
        ready.unpersist()
    return FittedPipeline(PipelineModel([*stages, model]), fitted)


def score(
    model: Model, df: DataFrame, keep: Sequence[str] = (), y_prob: str = "y_prob",
    y_pred: str = "y_pred",
) -> DataFrame:
    """Probability of the positive class and the model's own hard label (strictly above 0.5)."""
    prob = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(df).select(
        *keep, prob.alias(y_prob), F.col("prediction").cast("int").alias(y_pred)
    )


def scoring_record(df: DataFrame, y_prob: str = "y_prob", keep: Sequence[str] = ()) -> DataFrame:
    """Scores as the response of a batch request.

    Label and risk are decided on the unrounded probability: 0.69996 shows as 0.7 and is medium.
    """
    p = F.col(y_prob)
    return df.select(
        *keep,
        F.round(p, 4).alias("churn_probability"),
        (p >= 0.5).alias("churn_prediction"),
        fn.risk_level(p).alias("risk_level"),
        F.round(F.greatest(p, F.lit(1.0) - p), 4).alias("confidence"),
    )


@dataclass(frozen=True)
class Trained:
    model: Model
    seconds: float


def train_candidates(
    train: DataFrame, id_col: str, names: Sequence[str] | None = None, label: str = "label",
    params: dict[str, dict] | None = None,
) -> dict[str, Trained]:
    """Fit several models on one transformed training table (persist it first)."""
    done = {}
    for name in names or CANDIDATES:
        start = time.perf_counter()
        model = CANDIDATES[name].fit(train, id_col=id_col, label=label, **(params or {}).get(name, {}))
        done[name] = Trained(model, time.perf_counter() - start)
    return done


def score_candidates(
    trained: dict[str, Trained], df: DataFrame, keep: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """(keep…, y_true, y_prob, y_pred, model) of every model over the same rows, which are read once."""
    scores = []
    for i, (name, t) in enumerate(trained.items()):
        model = t.model.copy().setRawPredictionCol("").setProbabilityCol(f"__p{i}").setPredictionCol(f"__l{i}")
        df = model.transform(df)
        scores.append(F.struct(
            F.get(vector_to_array(f"__p{i}"), F.lit(1)).alias("y_prob"), F.col(f"__l{i}").cast("int").alias("y_pred"),
            F.lit(name).alias("model"),
        ))
    return df.select(*keep, F.col(label).cast("int").alias("y_true"), F.inline(F.array(*scores)))


def best_model(scored: DataFrame) -> str:
    """Name of the model with the highest ROC-AUC."""
    return compare_models(scored).first()["model"]
