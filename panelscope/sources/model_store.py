"""Persistence of fitted model packages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.models import ModelPackage


def save_model(spark: SparkSession, package: ModelPackage, path: str) -> None:
    """Pipeline directory plus one metadata row."""
    package.pipeline.write().overwrite().save(f"{path}/pipeline")
    row = [(float(package.threshold), list(package.features), package.method, package.version, package.target)]
    meta = spark.createDataFrame(
        row, "threshold double, features array<string>, method string, version string, target string"
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> ModelPackage:
    row = spark.read.parquet(f"{path}/metadata").first()
    return ModelPackage(
        PipelineModel.load(f"{path}/pipeline"), row["threshold"], tuple(row["features"]), row["method"],
        row["version"], row["target"],
    )
