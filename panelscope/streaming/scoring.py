"""Scoring of a stream of panel rows.

``score_batch`` holds no state, so the same projections run on a streaming
DataFrame; the sink writes exactly once through the query checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import ModelPackage, score_batch


def read_panel_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_scores(
    rows: DataFrame, package: ModelPackage, output: str, checkpoint: str, threshold: float | None = None
) -> StreamingQuery:
    """Score every available row once, then stop."""
    scored = score_batch(rows, package, threshold)
    return (
        scored.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(output)
    )
