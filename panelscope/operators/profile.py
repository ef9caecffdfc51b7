"""Profiling, quality rules and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import (
    DERIVED_ROLE,
    ENGINEERED_ROLES,
    PANEL_COLUMNS,
    POST_EVENT_COLUMNS,
    PREVALENCE_RANGE,
    REFERENCE_RANGES,
)
from .ordering import exact_quantiles


def _long(wide: DataFrame, entries: list[Column], by: Sequence[str] = ()) -> DataFrame:
    """One aggregated row to one row per entry."""
    return wide.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")


def profile_structure(df: DataFrame) -> DataFrame:
    """Per column: type, row count, nulls.  One pass over the data."""
    types = dict(df.dtypes)
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("data_type"),
            F.col("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.col(f"null_{c}").alias("null_count"),
        )
        for c in df.columns
    ]
    return _long(wide, entries)


def duplicate_count(df: DataFrame, id_column: str | None = None) -> DataFrame:
    """Excess exact duplicates and excess duplicate ids (keep-first counting).

    A group-by on the whole row: copies combine map side, so a row repeated
    very often is no hot key.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    out = rows.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess")).select(
        F.lit("duplicate_records").alias("check"), "excess"
    )
    if id_column:
        ids = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(
            ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess")).select(
                F.lit("duplicate_event_ids").alias("check"), "excess"
            )
        )
    return out


def impossible_values(df: DataFrame) -> DataFrame:
    """Counts of impossible values; an absent column counts 0."""
    rules = [
        ("negative_deaths", "Number_of_Deaths", lambda c: c < 0),
        ("negative_injuries", "Number_of_Injuries", lambda c: c < 0),
        ("negative_economic_loss", "Economic_Loss_Million", lambda c: c < 0),
        ("invalid_latitude", "Latitude", lambda c: (c < -90) | (c > 90)),
        ("invalid_longitude", "Longitude", lambda c: (c < -180) | (c > 180)),
    ]
    wide = df.agg(
        *[
            (F.count_if(rule(F.col(c))) if c in df.columns else F.max(F.lit(0)).cast("bigint")).alias(n)
            for n, c, rule in rules
        ]
    )
    return _long(wide, [F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("n_rows")) for n, _, _ in rules])


def iqr_outliers(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Tukey fences (rounded to 2) and the number of rows strictly outside.

    Absent columns are an error rather than silently skipped.  Fences are
    exact; ``approximate`` uses the sketch instead.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the panel: {missing}")
    if approximate:
        row = df.agg(*[F.percentile_approx(c, [0.25, 0.75], 10000).alias(c) for c in columns]).first()
        quartiles = {c: row[c] for c in columns}
    else:
        quartiles = {r["column"]: r["q"] for r in exact_quantiles(df, columns, [0.25, 0.75]).collect()}
    fences = {}
    for c in columns:
        q1, q3 = quartiles[c] or (None, None)
        fences[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))

    def outside(c):
        low, high = fences[c]
        if low is None:
            return F.lit(False)
        return (F.col(c) < low) | (F.col(c) > high)

    wide = df.agg(*[F.count_if(outside(c)).alias(c) for c in columns])
    entries = [
        F.struct(
            F.lit(c).alias("variable"),
            F.round(F.lit(fences[c][0]).cast("double"), 2).alias("lower_bound"),
            F.round(F.lit(fences[c][1]).cast("double"), 2).alias("upper_bound"),
            F.col(c).alias("outliers_count"),
        )
        for c in columns
    ]
    return _long(wide, entries)


NOT_IMPUTED = ("Record_ID", "Event_Date", "Disaster_Type", "Disaster_Occurred")


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = NOT_IMPUTED) -> DataFrame:
    """Fill numeric NULLs with the exact column median."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    chosen = [c for c in (columns or numeric) if c not in exclude]
    medians = {r["column"]: r["q"] for r in exact_quantiles(df, chosen, [0.5]).collect()}
    fills = {c: medians[c][0] for c in chosen if medians.get(c)}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()})


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column; ties give the smallest value.

    Values are counted with a map-side combine and the winner is a
    ``max_by`` over the counts, so no task holds all distinct values.
    """
    found = {}
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).first()
        found[c] = row[0]
    return found


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill categorical NULLs with the most frequent value."""
    modes = mode_values(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in modes.items() if v is not None})


def reference_range_check(
    df: DataFrame, ranges: dict[str, tuple[float, float, float]] | None = None, flag: str = "Disaster_Occurred"
) -> DataFrame:
    """Summary of each variable against its plausible range.

    ok when min >= 0.8 low and max <= 1.2 high (on values rounded to 2); the
    last row checks the prevalence of ``flag``.
    """
    ranges = {c: r for c, r in (ranges or REFERENCE_RANGES).items() if c in df.columns}
    medians = {r["column"]: r["q"] for r in exact_quantiles(df, list(ranges), [0.5]).collect()}
    wide = df.agg(
        F.avg(flag).alias("_prevalence"),
        *[
            F.struct(
                F.round(F.min(c), 2).alias("min"), F.round(F.max(c), 2).alias("max"),
                F.round(F.avg(c), 2).alias("mean"), F.round(F.stddev_samp(c), 2).alias("std"),
            ).alias(c)
            for c in ranges
        ],
    )
    null = F.lit(None).cast("double")
    entries = []
    for c, (low, high, _) in ranges.items():
        entries.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.col(f"{c}.min").alias("min_value"), F.col(f"{c}.max").alias("max_value"),
                F.col(f"{c}.mean").alias("mean_value"), F.col(f"{c}.std").alias("std_value"),
                F.round(F.lit(medians[c][0]).cast("double"), 2).alias("median_value"),
                ((F.col(f"{c}.min") >= low * 0.8) & (F.col(f"{c}.max") <= high * 1.2)).alias("within_range"),
            )
        )
    prevalence = F.col("_prevalence")
    entries.append(
        F.struct(
            F.lit("disaster_prevalence").alias("variable"), null.alias("min_value"), null.alias("max_value"),
            F.round(prevalence, 4).alias("mean_value"), null.alias("std_value"), null.alias("median_value"),
            prevalence.between(*PREVALENCE_RANGE).alias("within_range"),
        )
    )
    return _long(wide, entries)


def column_dictionary(df: DataFrame) -> DataFrame:
    """Column, type, role, description (the name in words) and null count."""
    known = {n: (r, n.replace("_", " ")) for n, r in [*((n, r) for n, _, r in PANEL_COLUMNS), *ENGINEERED_ROLES]}
    roles = F.create_map(*[F.lit(x) for n in df.columns if n in known for x in (n, known[n][0])])
    texts = F.create_map(*[F.lit(x) for n in df.columns if n in known for x in (n, known[n][1])])
    return profile_structure(df).select(
        F.col("column_name").alias("Column_Name"),
        F.col("data_type").alias("Data_Type"),
        F.coalesce(roles[F.col("column_name")], F.lit(DERIVED_ROLE)).alias("Variable_Role"),
        F.coalesce(texts[F.col("column_name")], F.lit("Custom feature engineered column")).alias("Description"),
        F.col("null_count").alias("Null_Count"),
    )


def default_rules(flag: str = "Disaster_Occurred") -> dict[str, Column]:
    """Rule name -> condition every row must meet."""
    def inside(c, low, high):
        return F.col(c).between(low, high)

    rules = {
        "latitude_bounds": inside("Latitude", -90, 90),
        "longitude_bounds": inside("Longitude", -180, 180),
        "soil_moisture_bounds": inside("Soil_Moisture", 0, 1),
        "vegetation_bounds": inside("Vegetation_Index", 0, 1),
        "drought_bounds": inside("Drought_Index", 0, 100),
        "preparedness_bounds": inside("Disaster_Preparedness_Index", 10, 100),
        "flag_binary": F.col(flag).isin(0, 1),
        "early_warning_binary": F.col("Early_Warning_System").isin(0, 1),
        "evacuation_binary": F.col("Evacuation_Plan_Available").isin(0, 1),
        "label_not_null": F.col("Disaster_Type").isNotNull() & (F.col("Disaster_Type") != ""),
    }
    for c in POST_EVENT_COLUMNS:
        rules[f"non_negative_{c}"] = F.col(c) >= 0
        rules[f"zero_without_event_{c}"] = (F.col(flag) != 0) | (F.col(c) == 0)
    return rules


def quality_rules(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(rule, violations); NULL counts as a violation.  One aggregation."""
    rules = rules or default_rules()
    wide = df.agg(*[F.count_if(~F.coalesce(cond, F.lit(False))).alias(n) for n, cond in rules.items()])
    return _long(wide, [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sd, min, exact quartiles, max per column."""
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = df.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    moments = _long(wide, [F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    # both sides hold one row per described column
    return moments.join(F.broadcast(quart), "column").select(
        F.col("column").alias("variable"),
        F.col("s.n").alias("count"), F.col("s.mean").alias("mean"), F.col("s.std").alias("std"),
        F.col("s.min").alias("min"), F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"), F.col("s.max").alias("max"),
    )

