"""Evaluation of scored tables: one row per account with the true label and the score.

Every operator takes grouping columns (``by``: split, model, segment), so comparing many models
or segments is one job. Counts stay integers until the last division, which keeps results
identical whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import scalars as fn
from holdfast.operators.ranking import running_totals

# Thresholds of the default sweep, the fine grid, flags and costs.
DEFAULT_THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
GRID = (0.1, 0.9, 0.01)
GAP_LIMIT = 0.05
GOOD_GAP = 0.01
COST_FALSE_NEGATIVE = 500.0
COST_FALSE_POSITIVE = 50.0

COUNTS = ("true_negatives", "false_positives", "false_negatives", "true_positives")
METRICS = ("roc_auc", "accuracy", "precision", "recall", "f1")


def scored_frame(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep…, y_true, y_prob), failing on a score that is missing or NaN and a label other than 0 and 1."""
    return df.select(*keep, fn.checked_label(y_true).alias("y_true"), fn.checked_score(y_prob).alias("y_prob"))


def grid_thresholds() -> list[float]:
    """The 80 doubles of the fine grid; most are not the rounded decimals."""
    return np.arange(*GRID).tolist()


def _rates(tn: Column, fp: Column, fn_: Column, tp: Column) -> dict[str, Column]:
    return {
        "accuracy": fn.ratio(tp + tn, tp + tn + fp + fn_),
        "precision": fn.ratio(tp, tp + fp),
        "recall": fn.ratio(tp, tp + fn_),
        "f1": fn.ratio(tp * 2, tp * 2 + fp + fn_),
    }


def confusion_counts(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """TN, FP, FN, TP; zeros for a class that does not occur. Labels other than 0 and 1 fail the job."""
    t, p = fn.checked_label(y_true), fn.checked_label(y_pred, "prediction")
    cells = {"true_negatives": (0, 0), "false_positives": (0, 1),
             "false_negatives": (1, 0), "true_positives": (1, 1)}
    return df.groupBy(*by).agg(
        *[
            F.count_if((t == true) & (p == pred)).alias(name)
            for name, (true, pred) in cells.items()
        ]
    )


def classification_metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall, F1; 0 where undefined."""
    counts = confusion_counts(df, y_true, y_pred, by)
    rates = _rates(*[F.col(c) for c in COUNTS])
    return counts.select(*by, *[c.alias(name) for name, c in rates.items()])


def _labelled(df: DataFrame) -> DataFrame:
    """Scored rows with the label as two counters."""
    return df.withColumns(
        {"pos": F.col("y_true").cast("long"), "neg": (1 - F.col("y_true")).cast("long")}
    ).drop("y_true")


def score_totals(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", by: Sequence[str] = (),
    lower: bool = False,
) -> DataFrame:
    """One row per (by, score): positives and negatives at it (``pos``, ``neg``), below it
    (``…_before``) and in the group (``…_total``)."""
    rows = _labelled(scored_frame(df, y_true, y_prob, by))
    return running_totals(rows, "y_prob", ("pos", "neg"), by, lower=lower)


def _auc(pairs: Column, pos: Column, neg: Column) -> Column:
    """Doubled count of won pairs over doubled count of pairs; null for one class."""
    return F.try_divide(pairs.cast("double"), (_wide(pos) * _wide(neg) * 2).cast("double"))


def _wide(c: Column) -> Column:
    # Pair counts pass 2**63 at a few billion rows.
    return c.cast("decimal(19,0)")


def _won_pairs() -> Column:
    twice = _wide(F.col("neg_before")) * 2 + _wide(F.col("neg"))
    return F.sum((_wide(F.col("pos")) * twice).cast("decimal(38,0)"))


def roc_auc(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", by: Sequence[str] = ()
) -> DataFrame:
    """Area under the ROC curve, tied scores counting half; null when only one class occurs."""
    sums = score_totals(df, y_true, y_prob, by).groupBy(*by).agg(
        _won_pairs().alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    auc = _auc(F.col("pairs"), F.col("pos"), F.col("neg"))
    return sums.select(
        *by, auc.alias("roc_auc"),
        F.when(auc.isNull(), "only one class").alias("roc_auc_note"),
    )


def brier_score(
    df: DataFrame, y_true: str = "y_true", y_prob: str = "y_prob", by: Sequence[str] = ()
) -> DataFrame:
    """Mean squared distance of score and label."""
    gap = F.col("y_prob") - F.col("y_true")
    return scored_frame(df, y_true, y_prob, by).groupBy(*by).agg(
        F.avg(gap * gap).alias("brier_score")
    )


def _sweep(
    df: DataFrame, thresholds: Sequence[float], y_true: str, y_prob: str, by: Sequence[str]
) -> DataFrame:
    """threshold, TN, FP, FN, TP per group and threshold, from one pass.

    Rows are counted by the interval their score falls in; what a threshold catches is the sum
    of the intervals above it, taken over an array of at most one entry per threshold.
    """
    thresholds = [float(t) for t in thresholds]
    edges = sorted(set(thresholds))
    scored = scored_frame(df, y_true, y_prob, by).withColumn(
        "bucket", fn.bucket_index("y_prob", edges)
    )
    counted = scored.groupBy(*by, "bucket").agg(
        F.sum(F.col("y_true").cast("long")).alias("pos"),
        F.sum((1 - F.col("y_true")).cast("long")).alias("neg"),
    )
    group = counted.groupBy(*by).agg(
        F.collect_list(F.struct("bucket", "pos", "neg")).alias("h"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
    )
    steps = ", ".join(
        f"named_struct('threshold', {fn.double(t)}, 'reach', {edges.index(t) + 1})" for t in thresholds
    )
    rows = group.withColumn("s", F.expr(f"explode(array({steps}))"))

    def above(name: str) -> Column:
        caught = F.filter("h", lambda x: x["bucket"] >= F.col("s.reach"))
        return F.aggregate(caught, F.lit(0).cast("long"), lambda acc, x: acc + x[name])

    tp, fp = above("pos"), above("neg")
    return rows.select(*by, F.col("s.threshold").alias("threshold"), "n_pos", "n_neg",
                       tp.alias("true_positives"), fp.alias("false_positives")).withColumns(
        {"false_negatives": F.col("n_pos") - F.col("true_positives"),
         "true_negatives": F.col("n_neg") - F.col("false_positives")}
    )


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float] = DEFAULT_THRESHOLDS, y_true: str = "y_true",
    y_prob: str = "y_prob", by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1, positives caught (as ``caught/all``) and false alarms."""
    rows = _sweep(df, thresholds, y_true, y_prob, by)
    rates = _rates(*[F.col(c) for c in COUNTS])
    caught = F.concat_ws("/", F.col("true_positives").cast("string"), F.col("n_pos").cast("string"))
    return rows.select(
        *by, "threshold", *[rates[m].alias(m) for m in ("precision", "recall", "f1")],
        caught.alias("positives_caught"), F.col("false_positives").alias("false_alarms"),
    )


def best_threshold(
    df: DataFrame, metric: str | Sequence[str] = "f1", thresholds: Sequence[float] | None = None,
    y_true: str = "y_true", y_prob: str = "y_prob", by: Sequence[str] = (),
) -> DataFrame:
    """The threshold with the highest metric, the lowest one on ties; (0.5, 0.0) if all are 0.

    Several metrics share one sweep and give one row each.
    """
    metrics = [metric] if isinstance(metric, str) else list(metric)
    for name in metrics:
        if name not in ("f1", "recall", "precision"):
            raise ValueError(f"unknown metric {name!r}")
    rates = _rates(*[F.col(c) for c in COUNTS])
    entries = F.array(*[F.struct(F.lit(x).alias("metric"), rates[x].alias("score")) for x in metrics])
    rows = _sweep(df, thresholds or grid_thresholds(), y_true, y_prob, by)
    best = rows.select(*by, "threshold", F.inline(entries)).groupBy(*by, "metric").agg(
        F.max(F.struct("score", (-F.col("threshold")).alias("neg"))).alias("best")
    )
    found = F.col("best.score") > 0
    return best.select(
        *by, "metric", F.when(found, -F.col("best.neg")).otherwise(0.5).alias("threshold"),
        F.when(found, F.col("best.score")).otherwise(0.0).alias("score"),
    )


def _bin_edges(n_bins: int) -> list[float]:
    return np.linspace(0, 1, n_bins + 1).tolist()


def calibration_bins(
    df: DataFrame, n_bins: int = 10, y_true: str = "y_true", y_prob: str = "y_prob",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per filled bin its label, actual rate, count, and rate minus the middle of the bin.

    Bins hold their lower edge; scores outside [0, 1] go to the outer bins.
    """
    edges = _bin_edges(n_bins)
    scored = scored_frame(df, y_true, y_prob, by).withColumn(
        "bin_index", fn.bucket_index("y_prob", edges[1:-1])
    )
    counted = scored.groupBy(*by, "bin_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("long")).alias("n_pos")
    )
    bounds = F.array(*[F.lit(e) for e in edges])
    low, high = F.get(bounds, F.col("bin_index")), F.get(bounds, F.col("bin_index") + 1)
    rate = fn.ratio("n_pos", "n")
    return counted.select(
        *by, "bin_index", fn.bin_label(low, high).alias("bin"), rate.alias("actual_rate"),
        F.col("n").alias("count"), (rate - (low + high) / 2).alias("gap"),
    )


def calibration_curve(
    df: DataFrame, n_bins: int = 10, y_true: str = "y_true", y_prob: str = "y_prob",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per filled bin the positive share and the mean score; bins hold their upper edge."""
    prob = F.col("y_prob")
    inside = F.when(prob.between(0, 1), prob).otherwise(
        F.raise_error(F.lit("scores must lie in [0, 1]"))
    )
    scored = scored_frame(df, y_true, y_prob, by).withColumn("y_prob", inside)
    index = fn.bucket_index("y_prob", _bin_edges(n_bins)[1:-1], right_closed=True)
    return scored.groupBy(*by, index.alias("bin_index")).agg(
        F.avg("y_true").alias("positive_share"), F.avg("y_prob").alias("mean_score"),
        F.count(F.lit(1)).alias("count"),
    )


def evaluation_record(
    df: DataFrame, threshold: float = 0.5, y_true: str = "y_true", y_prob: str = "y_prob",
    y_pred: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Sizes, metrics and confusion counts of each group in one query.

    The hard label is ``y_prob >= threshold`` unless ``y_pred`` names a column to take.
    """
    keep = [*by, *([y_pred] if y_pred else [])]
    rows = _labelled(scored_frame(df, y_true, y_prob, keep))
    pred = fn.checked_label(y_pred, "prediction").cast("long") if y_pred else fn.hard_label("y_prob", threshold).cast("long")
    rows = rows.withColumns({"tp": F.col("pos") * pred, "fp": F.col("neg") * pred})
    ranked = running_totals(rows, "y_prob", ("pos", "neg"), by, carry=("tp", "fp"))
    sums = ranked.groupBy(*by).agg(
        _won_pairs().alias("pairs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pos", "neg", "tp", "fp")],
    )
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    rates = _rates(neg - fp, fp, pos - tp, tp)
    return sums.select(
        *by, F.lit(float(threshold)).alias("threshold"), (pos + neg).alias("n_samples"),
        pos.alias("n_positive"), (tp + fp).alias("n_predicted_positive"),
        _auc(F.col("pairs"), pos, neg).alias("roc_auc"),
        *[c.alias(name) for name, c in rates.items()],
        (neg - fp).alias("true_negatives"), fp.alias("false_positives"),
        (pos - tp).alias("false_negatives"), tp.alias("true_positives"),
    )


def compare_models(
    df: DataFrame, model: str = "model", threshold: float = 0.5, y_true: str = "y_true",
    y_prob: str = "y_prob",
) -> DataFrame:
    """Metrics per model, best ROC-AUC first, equal ones by name."""
    record = evaluation_record(df, threshold, y_true, y_prob, by=(model,))
    return record.select(model, "roc_auc", "precision", "recall", "f1").orderBy(
        F.desc_nulls_last("roc_auc"), model
    )


def _long_metrics(record: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return record.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")


def split_gap(
    df: DataFrame, split: str = "split", first: str = "validation", second: str = "test",
    threshold: float = 0.5, limit: float = GAP_LIMIT, y_pred: str | None = None,
) -> DataFrame:
    """Per metric its value on two splits, the difference, and whether it exceeds the limit."""
    rows = df.where(F.col(split).isin(first, second))
    record = evaluation_record(rows, threshold, y_pred=y_pred, by=(split,))
    long = _long_metrics(record, (split,), METRICS)
    wide = long.groupBy("metric").pivot(split, [first, second]).agg(F.max("value"))
    gap = F.col(first) - F.col(second)
    return wide.select("metric", first, second, gap.alias("gap"),
                       (F.abs(gap) > limit).alias("exceeds_limit"))


def overfit_report(
    df: DataFrame, split: str = "split", model: str = "model", first: str = "train",
    second: str = "validation",
) -> DataFrame:
    """Train against validation ROC-AUC per model, with a verdict on the gap."""
    aucs = roc_auc(df.where(F.col(split).isin(first, second)), by=(model, split))
    wide = aucs.groupBy(model).pivot(split, [first, second]).agg(F.max("roc_auc"))
    gap = F.col(first) - F.col(second)
    # The three verdicts.
    verdict = (
        F.when(gap > GAP_LIMIT, "potential overfitting")
        .when(gap < GOOD_GAP, "good generalization")
        .otherwise("acceptable")
    )
    return wide.select(model, F.col(first).alias("train_auc"), F.col(second).alias("validation_auc"),
                       gap.alias("gap"), verdict.alias("verdict"))


def outcome(y_true: str = "y_true", y_pred: str = "y_pred") -> Column:
    """Name of the confusion cell a row falls in."""
    t, p = fn.checked_label(y_true), fn.checked_label(y_pred, "prediction")
    return (
        F.when((t == 1) & (p == 1), "true_positives").when((t == 0) & (p == 0), "true_negatives")
        .when((t == 0) & (p == 1), "false_positives").when((t == 1) & (p == 0), "false_negatives")
    )


def outcome_counts(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Count and percent of all four outcomes, zeros included."""
    counts = confusion_counts(df, y_true, y_pred, by)
    total = sum((F.col(c) for c in COUNTS), F.lit(0)).alias("total")
    long = counts.select(*by, total, *COUNTS).unpivot([*by, "total"], list(COUNTS), "outcome", "n")
    return long.withColumn("percent", fn.ratio(F.col("n") * F.lit(100.0), "total"))


def _cell(y_true: str, y_pred: str) -> Column:
    """2 * label + prediction, so that both are always looked at."""
    return fn.checked_label(y_true) * 2 + fn.checked_label(y_pred, "prediction")


def segment_profile(
    df: DataFrame, error: Column, base: Column, means: Sequence[str] = (),
    shares: Sequence[tuple[str, str]] = (), by: Sequence[str] = (),
) -> DataFrame:
    """How a group of errors differs from the class it came from.

    One row per feature: mean of a numeric column, or share of one value, among the ``error``
    rows and among the ``base`` rows. A column the table lacks gives nulls; without any error
    row there is no profile.
    """
    parts = {}
    for c in means:
        parts[f"mean {c}"] = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    for c, value in shares:
        hit = F.coalesce(F.col(c) == value, F.lit(False)).cast("double") if c in df.columns else (
            F.lit(None).cast("double"))
        parts[f"share {c} = {value}"] = hit
    aggs = [F.count_if(error).alias("n_error")]
    for i, value in enumerate(parts.values()):
        aggs.append(F.avg(F.when(error, value)).alias(f"e{i}"))
        aggs.append(F.avg(F.when(base, value)).alias(f"b{i}"))
    row = df.groupBy(*by).agg(*aggs).where("n_error > 0")
    items = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"e{i}").alias("among_errors"),
                 F.col(f"b{i}").alias("among_class"))
        for i, name in enumerate(parts)
    ])
    return row.select(*by, F.inline(items))


def false_negative_profile(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Missed positives against all positives."""
    cell = _cell(y_true, y_pred)
    return segment_profile(
        df, cell == 2, cell >= 2, means=("tenure",),
        shares=(("Contract", "Two year"), ("InternetService", "Fiber optic")), by=by,
    )


def false_positive_profile(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """False alarms against all negatives."""
    cell = _cell(y_true, y_pred)
    return segment_profile(
        df, cell == 1, cell <= 1, means=("tenure",),
        shares=(("Contract", "Month-to-month"), ("InternetService", "Fiber optic")), by=by,
    )


def business_impact(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = (),
    cost_false_negative: float = COST_FALSE_NEGATIVE,
    cost_false_positive: float = COST_FALSE_POSITIVE,
) -> DataFrame:
    """Errors as counts, shares of all rows, and money."""
    counts = confusion_counts(df, y_true, y_pred, by)
    total = sum((F.col(c) for c in COUNTS), F.lit(0))
    fp, fneg = F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        *by, "false_positives", fn.ratio(fp, total).alias("false_positive_share"),
        "false_negatives", fn.ratio(fneg, total).alias("false_negative_share"),
        (fneg * F.lit(float(cost_false_negative)) + fp * F.lit(float(cost_false_positive))).alias("cost"),
    )


def risk_counts(df: DataFrame, y_prob: str = "y_prob", by: Sequence[str] = ()) -> DataFrame:
    """Size of the batch and how many accounts fall in each risk class."""
    level = fn.risk_level(y_prob)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(level == name).alias(f"{name}_risk") for name in ("high", "medium", "low")],
    )
