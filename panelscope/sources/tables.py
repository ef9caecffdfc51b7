"""Panel sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RECORD_KEYS, panel_schema, require_columns


# Schemas of the supplied star-schema tables (no inference job).
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of the supplied star schema."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def _nan_to_null(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def read_panel(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    required: Sequence[str] = RECORD_KEYS,
) -> DataFrame:
    """Read a panel as CSV (explicit schema, header) or a columnar format.

    NaN becomes NULL at ingest.  Missing key or predictor columns raise
    ValueError.
    """
    if fmt == "csv":
        schema = schema or panel_schema()
        header = spark.read.option("header", True).csv(path).columns
        require_columns_list(header, required)
        by_name = {f.name: f for f in schema.fields}
        actual = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
        df = spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd").schema(actual).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return _nan_to_null(require_columns(df, required, "panel"))


def require_columns_list(present: Sequence[str], required: Sequence[str]) -> None:
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"panel is missing required columns: {missing}")


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("Year",)) -> None:
    """Write a panel; parquet is partitioned by year so period filters prune files."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    keys = list(partition_by)
    # One shuffle on the partition column plus a hash salt: few files per
    # year, while a year holding most rows is still written by many tasks.
    spread = df.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(*_salt_columns(df, keys)), F.lit(16)))
    spread.write.mode("overwrite").partitionBy(*keys).format(fmt).save(path)


def _salt_columns(df: DataFrame, keys: Sequence[str]) -> list:
    return [F.col(c) for c in df.columns if c not in keys][:4] or [F.lit(0)]


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Persist a tidy result table."""
    df.write.mode("overwrite").format(fmt).save(path)
