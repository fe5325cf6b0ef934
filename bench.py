"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is planned and run to the end; its rows are written to a sink that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import REGISTRY  # noqa: E402

HEADLINE = (
    "P03_missing_counts", "P05_value_counts", "C01_strip_strings", "C08_validate_records", "C10_prepare_impute",
    "R01_split_60_20_20", "R02_leakage_counts", "R03_split_summary", "F01_median", "F02_mode",
    "F03_scaling_statistics", "F03_fit_params", "F11_fit_train_transform_all", "F10_feature_vector",
    "M01_class_weights", "M02_logistic_regression", "M08_score_table", "M09_scoring_record",
    "G02_classification_metrics", "G03_roc_auc", "G04_brier_score", "G05_threshold_sweep",
    "G06_calibration_bins", "G07_calibration_curve", "G08_best_threshold", "G10_false_negative_profile",
    "G12_evaluation_record", "G13_compare_models", "G15_overfit_report", "G17_risk_counts",
    "W01_roc_curve", "W02_precision_recall_curve", "X04_explain_rows", "X05_explanation_text",
    "M06_pipeline_probabilities", "S05_loaded_probabilities", "X02_tree_importance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
