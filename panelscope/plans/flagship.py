"""Flagship query: from line items to the ten riskiest units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators.aggregates import top_k
from . import views


def riskiest_units(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """Read, densify, index, engineer, aggregate per unit, take the top k."""
    featured = views.featured(spark, folder)
    per_unit = featured.groupBy("District", "Region").agg(
        F.avg("Disaster_Risk_Score").alias("mean_risk"),
        F.sum("Disaster_Occurred").alias("n_events"),
        F.max("Rolling_12_Month_Disaster_Count").alias("worst_year"),
        F.avg("Disaster_Next_Month").alias("next_month_rate"),
    )
    top = top_k(per_unit, k, "mean_risk", "District")
    return top.select(
        "District", "Region", "n_events", "worst_year",
        rounded(F.col("mean_risk")).alias("mean_risk"), rounded(F.col("next_month_rate")).alias("next_month_rate"),
    )
