"""Saving and loading what a training run leaves behind."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import metrics as m
from holdfast.operators.models import FittedPipeline
from holdfast.operators.preprocess import FittedPreprocessor
from holdfast.spec import FeatureSpec


def save_model(model: PipelineModel, path: str) -> str:
    """Preprocessing and classifier as one directory of built-in stages."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_pipeline(fitted: FittedPipeline, path: str) -> str:
    """Model, column roles and learned values below ``path``; categories of any number stay a table."""
    spark = fitted.preprocessor.params.sparkSession
    fitted.model.write().overwrite().save(f"{path}/model")
    fitted.preprocessor.params.write.mode("overwrite").parquet(f"{path}/params")
    listed = max((len(v) for v in fitted.preprocessor.levels.values()), default=0)
    spec = [(json.dumps(asdict(fitted.preprocessor.spec)), listed)]
    spark.createDataFrame(spec, "spec string, listed int").write.mode("overwrite").json(f"{path}/spec")
    return path


def load_pipeline(spark: SparkSession, path: str) -> FittedPipeline:
    row = spark.read.schema("spec string, listed int").json(f"{path}/spec").first()
    roles = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(row["spec"]).items()}
    prep = FittedPreprocessor.from_params(spark.read.parquet(f"{path}/params"), FeatureSpec(**roles), row["listed"])
    return FittedPipeline(PipelineModel.load(f"{path}/model"), prep)


def metrics_record(
    evaluation: DataFrame, model_type: str, config: dict[str, object], split: str = "split"
) -> DataFrame:
    """One nested row: time, model, configuration, and metrics and matrix of both splits."""

    def part(name: str):
        here = F.col(split) == name
        nested = F.struct(
            F.lit(name).alias("dataset"), F.col("n_samples"),
            F.struct(*m.METRICS).alias("metrics"), F.struct(*m.COUNTS).alias("confusion_matrix"),
        )
        return F.max(F.when(here, nested)).alias(name)

    pairs = [F.lit(str(x)) for item in config.items() for x in item]
    return evaluation.groupBy().agg(part("validation"), part("test")).select(
        F.current_timestamp().alias("training_date"), F.lit(model_type).alias("model_type"),
        F.create_map(*pairs).alias("model_config"), "validation", "test",
    )


def save_metrics(record: DataFrame, path: str, mode: str = "append") -> None:
    """JSON. Appending keeps one row per run."""
    record.write.mode(mode).json(path)


def load_metrics(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def save_schema(schema: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table of input and transformed features, as JSON."""
    schema.write.mode(mode).json(path)


def save_reports(reports: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Each report table below ``root`` under its name, as JSON."""
    for name, report in reports.items():
        report.write.mode(mode).json(f"{root}/{name}")
