"""Calendar, flag, lag, rolling and lead features; hazard scoring rules.

Windows are partitioned by unit and ordered by period.  A unit has one row per
period (the panel key), so a window holds at most the number of months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, divide
from ..schema import NO_EVENT
from ..sources.durable import known_rows, with_rows
from .ordering import quantile_values


def date_key(date: Column) -> Column:
    """yyyyMMdd as int."""
    return F.date_format(date, "yyyyMMdd").cast("int")


def quarter_label(date: Column) -> Column:
    """Year and quarter such as 2015Q1."""
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8, 9), "Monsoon").otherwise("Autumn")
    )


def date_parts(df: DataFrame, date: str = "Event_Date") -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "Month_Name": F.date_format(d, "MMMM"),
            "Quarter": quarter_label(d),
            "DateKey": date_key(d),
        }
    )


def above(value: Column, limit) -> Column:
    """1 when value > limit, else 0 (NULL counts as not above)."""
    return F.coalesce((value > limit).cast("int"), F.lit(0))


def below(value: Column, limit) -> Column:
    return F.coalesce((value < limit).cast("int"), F.lit(0))


def threshold_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "Coastal_Region_Flag": below(F.col("Distance_From_Coast_km"), 100.0),
            "Extreme_Rainfall_Flag": above(F.col("Rainfall_Anomaly"), 1.5),
            "Extreme_Temperature_Flag": above(F.col("Temperature_Anomaly"), 1.5),
        }
    )


def median_split_flag(df: DataFrame, column: str, output: str) -> DataFrame:
    """1 above the exact median of the whole column."""
    median = quantile_values(df, column, [0.5])[0]
    return df.withColumn(output, above(F.col(column), F.lit(median)))


def unit_window(unit: str, period: str):
    return Window.partitionBy(unit).orderBy(period)


def lag_features(
    df: DataFrame, unit: str = "District", period: str = "Event_Date",
    flag: str = "Disaster_Occurred", severity: str = "Hazard_Severity",
) -> DataFrame:
    """Flag and severity of the previous period; the first row gets 0."""
    w = unit_window(unit, period)
    return df.withColumns(
        {
            "Previous_Month_Disaster_Occurred": F.coalesce(F.lag(flag).over(w), F.lit(0)).cast("int"),
            "Previous_Month_Hazard_Severity": F.coalesce(F.lag(severity).over(w), F.lit(0.0)),
        }
    )


def rolling_count(
    df: DataFrame, periods: int = 12, unit: str = "District", period: str = "Event_Date",
    flag: str = "Disaster_Occurred", output: str = "Rolling_12_Month_Disaster_Count",
) -> DataFrame:
    """Sum of the flag over the previous ``periods`` rows, current excluded.

    0 until that many earlier rows exist.
    """
    w = unit_window(unit, period).rowsBetween(-periods, -1)
    full = F.count(flag).over(w) == periods
    return df.withColumn(output, F.when(full, F.sum(flag).over(w)).otherwise(F.lit(0)).cast("int"))


def lead_target(
    df: DataFrame, unit: str = "District", period: str = "Event_Date",
    flag: str = "Disaster_Occurred", output: str = "Disaster_Next_Month",
) -> DataFrame:
    """Flag of the next period; NULL in the last one."""
    return df.withColumn(output, F.lead(flag).over(unit_window(unit, period)).cast("int"))


def engineer_features(df: DataFrame) -> DataFrame:
    """All engineered columns; the unit windows share one shuffle and sort."""
    out = date_parts(df).drop("DateKey").withColumn("Season", season(F.col("Month")))
    out = median_split_flag(threshold_flags(out), "Population_Density", "High_Population_Density_Flag")
    if "Disaster_Risk_Score" in out.columns:
        out = out.withColumn("Risk_Preparedness_Gap", F.col("Disaster_Risk_Score") - F.col("Preparedness_Score"))
    return with_rows(lead_target(rolling_count(lag_features(out))), known_rows(df))


def alert_level(p: Column, threshold: Column | float) -> Column:
    """Low below the threshold, then bands of 0.15."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        F.when(p < t, "Low").when(p < t + F.lit(0.15), "Moderate").when(p < t + F.lit(0.30), "High")
        .otherwise("Critical")
    )


def policy_quadrant(risk: Column, preparedness: Column, median_risk, median_prep) -> Column:
    """Risk strictly above its median, preparedness at or above its median."""
    high_risk, high_prep = risk > median_risk, preparedness >= median_prep
    return (
        F.when(high_risk & ~high_prep, "High Risk - Low Preparedness (Priority 1)")
        .when(high_risk & high_prep, "High Risk - High Preparedness (Priority 2)")
        .when(~high_risk & ~high_prep, "Low Risk - Low Preparedness (Priority 3)")
        .otherwise("Low Risk - High Preparedness (Priority 4)")
    )


def prediction_type(year: Column, train_end: int = 2022, cal_end: int = 2023, val_end: int = 2024) -> Column:
    return (
        F.when(year <= train_end, "Training fitted").when(year <= cal_end, "Calibration")
        .when(year <= val_end, "Validation").otherwise("Final test")
    )


def forecast_key(date: Column) -> Column:
    return date_key(F.add_months(date, 1))


def anomaly_vs_baseline(
    df: DataFrame, value: str, output: str, unit: str = "District", month: str = "Month", additive: bool = False
) -> DataFrame:
    """Deviation from the unit's mean for the same calendar month.

    Relative form (x - m) / (0.3 m + 5), or x - m when ``additive``.  A
    (unit, month-of-year) group holds one row per year.
    """
    mean = F.avg(value).over(Window.partitionBy(unit, month))
    diff = F.col(value) - mean
    return df.withColumn(output, diff if additive else divide(diff, mean * F.lit(0.3) + F.lit(5.0)))


# --- multi-hazard scoring ---------------------------------------------------

# Per hazard the intercept, the linear terms and the gate.
HAZARD_TERMS: dict[str, tuple[float, dict[str, float], str]] = {
    "Flood": (-5.8, {"Rainfall_Anomaly": 2.8, "Elevation_Metres": -0.008, "Distance_From_River_km": -0.015, "River_Level_Metres": 0.5}, "true"),
    "Cyclone": (-7.5, {"Wind_Speed_kmph": 0.12, "Distance_From_Coast_km": -0.015}, "Month in (5, 10, 11)"),
    "Landslide": (-7.2, {"Rainfall_Anomaly": 2.2, "Slope_Degrees": 0.14, "Vegetation_Index": -3.5}, "Elevation_Metres > 400"),
    "Drought": (-5.5, {"Temperature_Anomaly": 1.8, "Rainfall_Anomaly": -2.5, "Soil_Moisture": -4.5}, "Month in (3, 4, 5, 10, 11)"),
    "Earthquake": (-9.0, {"Seismic_Activity_Index": 3.2}, "true"),
    "Heatwave": (-5.2, {"Temperature_Anomaly": 3.0, "Population_Density": 0.002}, "Month in (4, 5, 6)"),
    "Wildfire": (-6.5, {"Temperature_Anomaly": 2.2, "Soil_Moisture": -3.8, "Vegetation_Index": 1.2}, "Month in (3, 4, 5, 10, 11) and Urbanisation_Rate < 0.6"),
    "Severe Storm": (-6.2, {"Wind_Speed_kmph": 0.06, "Rainfall_Anomaly": 1.2}, "true"),
}
ACTIVE_THRESHOLD = 0.005


def hazard_probability(name: str) -> Column:
    """Logistic score of one hazard; 0 outside its gate."""
    intercept, terms, gate = HAZARD_TERMS[name]
    z = F.lit(intercept)
    for column, weight in terms.items():
        z = z + F.lit(weight) * F.col(column)
    return F.when(F.expr(gate), F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(F.lit(0.0))


def multi_hazard_score(df: DataFrame, output: str = "hazards") -> DataFrame:
    """array<struct<p, priority, name>> with one entry per hazard."""
    entries = [
        F.struct(hazard_probability(n).alias("p"), F.lit(-i).alias("priority"), F.lit(n).alias("name"))
        for i, n in enumerate(HAZARD_TERMS)
    ]
    return df.withColumn(output, F.array(*entries))


def dominant_hazard(df: DataFrame, hazards: str = "hazards", threshold: float = ACTIVE_THRESHOLD) -> DataFrame:
    """Most probable active hazard, compound flag and severity 1..10.

    On equal probability the hazard listed first wins.
    """
    active = F.filter(hazards, lambda h: h["p"] > threshold)
    top = F.array_max(active)
    return df.withColumns(
        {
            "Dominant_Type": F.coalesce(top["name"], F.lit(NO_EVENT)),
            "Dominant_Probability": F.coalesce(top["p"], F.lit(0.0)),
            "Compound_Flag": (F.size(active) >= 2).cast("int"),
            "Dominant_Severity": F.when(F.size(active) == 0, F.lit(0.0)).otherwise(
                clip(top["p"] * F.lit(12.0), F.lit(1.0), F.lit(10.0))
            ),
        }
    )
