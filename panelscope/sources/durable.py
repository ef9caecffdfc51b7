"""Durable intermediate tables.

Multi-pass operators write their small aggregated input once to the shared
folder named by ``spark.checkpoint.dir`` and read it back, which cuts lineage
and survives the loss of executors.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows that one task makes where a step multiplies rows.
MADE_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; one process on one machine may have its own, removed at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return re.sub("^file:/(?!/)", "file:///", folder)  # the form that other readers take too
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="panelscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)  # the setting itself cannot be changed in a running session
    return shared_folder(spark)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Counting the rows of such a table reads file footers only; see
    ``count_rows``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_rows = lambda: table.count()
    return table


def with_rows(df: DataFrame, rows: int | None) -> DataFrame:
    """Remember the exact row count of a DataFrame."""
    df._known_rows = rows
    return df


def known_rows(df: DataFrame) -> int | None:
    """Row count if it is known or costs only file footers, else None."""
    if getattr(df, "_known_rows", None) is None and hasattr(df, "_durable_rows"):
        df._known_rows = df._durable_rows()
    return getattr(df, "_known_rows", None)


def count_rows(df: DataFrame) -> int:
    """Row count, counted at most once per durable table."""
    rows = known_rows(df)
    return df.count() if rows is None else rows


def spread(df: DataFrame, copies: int, made_rows: int = MADE_ROWS) -> DataFrame:
    """``df``, whose rows a later step multiplies by ``copies``, dealt over tasks that make about ``made_rows`` rows each.

    Without it a small table is one task, whatever its rows are multiplied by.
    """
    tasks = -(-count_rows(df) * copies // made_rows)
    return with_rows(df.repartition(tasks), known_rows(df)) if tasks > 1 else df
