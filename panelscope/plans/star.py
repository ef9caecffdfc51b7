"""Star schema and business-intelligence measures.

Dimensions and facts are plain DataFrames; a measure is a join, a filter and an
aggregation, so Catalyst prunes columns and pushes filters per measure.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..operators.features import alert_level, date_key, forecast_key, prediction_type, quarter_label, season
from ..operators.ordering import row_numbers
from ..operators.panel import distinct_rows
from ..schema import NO_EVENT

# Exported fact columns.
FACT_UNIT_MONTH = [
    "Record_ID", "DateKey", "GeographyKey", "DisasterTypeKey", "Disaster_Occurred", "Compound_Event",
    "Hazard_Severity", "Rainfall_Anomaly", "Temperature_Anomaly", "Wind_Speed_kmph", "River_Level_Metres",
    "Soil_Moisture", "Drought_Index", "Vegetation_Index", "Seismic_Activity_Index", "Hazard_Score",
    "Exposure_Score", "Vulnerability_Score", "Preparedness_Score", "Disaster_Risk_Score", "Risk_Category",
    "Emergency_Response_Time_Minutes",
]
FACT_EVENTS = [
    "Record_ID", "DateKey", "GeographyKey", "DisasterTypeKey", "Compound_Event", "Disaster_Duration_Days",
    "Disaster_Magnitude", "Hazard_Severity", "Number_of_Deaths", "Number_of_Injuries",
    "Number_of_People_Affected", "Displacement_Count", "Houses_Damaged", "Infrastructure_Damage_Score",
    "Crop_Loss_Percentage", "Economic_Loss_Million",
]
GEOGRAPHY = ["District", "State", "Region", "Latitude", "Longitude", "Population", "Area_SqKm"]
LABELS = ["Cluster", "Cluster_Label", "Policy_Quadrant"]


def surrogate_keys(dim: DataFrame, order: Sequence[str], key: str) -> DataFrame:
    """1..n in the given order; for dimensions of label size (types, dates)."""
    return dim.withColumn(key, F.row_number().over(Window.orderBy(*order)))


def dim_date(panel: DataFrame, date: str = "Event_Date") -> DataFrame:
    d = F.col("Date")
    return panel.select(F.col(date).alias("Date")).distinct().select(
        "Date", date_key(d).alias("DateKey"), F.year(d).alias("Year"), quarter_label(d).alias("Quarter"),
        F.month(d).alias("Month_Number"), F.date_format(d, "MMMM").alias("Month_Name"), season(F.month(d)).alias("Season"),
    )


def dim_geography(panel: DataFrame, typology: DataFrame | None = None, unit: str = "District") -> DataFrame:
    """One row per unit with labels and a surrogate key.

    A balanced panel lists every unit in its first period, so first-appearance
    order is unit order; keys are exact row numbers computed by range when
    there are many units.
    """
    columns = [c for c in GEOGRAPHY if c in panel.columns]
    rows = distinct_rows(panel.select(*columns, "Event_Date"), [unit], ["Event_Date"]).select(*columns)
    if typology is not None:
        present = [c for c in LABELS if c in typology.columns]
        rows = rows.join(typology.select(unit, *present), unit, "left")
    return row_numbers(rows, unit, "GeographyKey").withColumn("GeographyKey", F.col("GeographyKey").cast("int"))


def dim_event_type(panel: DataFrame, kind: str = "Disaster_Type") -> DataFrame:
    """Event types in order of first appearance, the no-event label first."""
    first = panel.groupBy(kind).agg(F.min(F.struct("Event_Date", "District")).alias("_first"))
    quiet = F.col(kind) != NO_EVENT
    return surrogate_keys(first, [quiet.cast("int"), F.col("_first"), F.col(kind)], "DisasterTypeKey").select(
        "DisasterTypeKey", kind
    )


def join_dim_keys(panel: DataFrame, geography: DataFrame, event_type: DataFrame | None = None) -> DataFrame:
    """Surrogate keys on the rows: plain equi-joins, broadcast while small."""
    out = panel.withColumn("DateKey", date_key(F.col("Event_Date"))).join(
        geography.select("District", "GeographyKey"), "District", "left"
    )
    if event_type is not None:
        # one row per event type
        out = out.join(F.broadcast(event_type), "Disaster_Type", "left")
    return out


def fact_unit_month(keyed: DataFrame) -> DataFrame:
    return keyed.select(*[c for c in FACT_UNIT_MONTH if c in keyed.columns])


def fact_events(keyed: DataFrame) -> DataFrame:
    return keyed.where("Disaster_Occurred = 1").select(*[c for c in FACT_EVENTS if c in keyed.columns])


def fact_predictions(
    scored: DataFrame, geography: DataFrame, threshold: float, p: str = "p", loss: str = "predicted_loss",
    train_end: int = 2022, cal_end: int = 2023, val_end: int = 2024,
    version: str = "3.1", training_end_date: str = "2022-12-01",
) -> DataFrame:
    """Scored rows with role-playing date keys, class, alert level and expected loss."""
    rows = scored.where("Disaster_Next_Month IS NOT NULL").join(
        geography.select("District", "GeographyKey"), "District", "left"
    )
    year, prob = F.col("Year"), F.col(p)
    return rows.select(
        F.col("Record_ID").alias("Prediction_ID"),
        "GeographyKey",
        date_key(F.col("Event_Date")).alias("Prediction_DateKey"),
        forecast_key(F.col("Event_Date")).alias("Forecast_DateKey"),
        prob.alias("Predicted_Disaster_Probability"),
        (prob >= threshold).cast("int").alias("Predicted_Disaster_Class"),
        alert_level(prob, threshold).alias("Alert_Level"),
        F.lit(float(threshold)).alias("Decision_Threshold"),
        F.col("Disaster_Next_Month").alias("Actual_Disaster_Occurred"),
        (prob * F.col(loss)).alias("Expected_Economic_Risk_Million"),
        prediction_type(year, train_end, cal_end, val_end).alias("Prediction_Type"),
        (year > train_end).cast("int").alias("Is_Out_Of_Sample"),
        F.lit(version).alias("Model_Version"),
        F.lit(training_end_date).alias("Training_End_Date"),
    )


@dataclass(frozen=True)
class Star:
    date: DataFrame
    geography: DataFrame
    event_type: DataFrame
    unit_month: DataFrame
    events: DataFrame
    predictions: DataFrame

    def fact(self, name: str, date_role: str = "DateKey") -> DataFrame:
        """A fact joined to its dimensions on the chosen date role."""
        if name == "predictions":
            role = "Prediction_DateKey" if date_role == "DateKey" else date_role
            rows = self.predictions.withColumn("DateKey", F.col(role))
        else:
            rows = {"unit_month": self.unit_month, "events": self.events}[name].join(
                F.broadcast(self.event_type), "DisasterTypeKey", "left"
            )
        # dates: one row per month; geography: plain join, broadcast while small
        return rows.join(F.broadcast(self.date), "DateKey", "left").join(self.geography, "GeographyKey", "left")


def measure(rows: DataFrame, measures: dict[str, Column], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Filter context, group and aggregate."""
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])


def total_events() -> Column:
    return F.sum(F.when(F.col("Disaster_Occurred") == 1, F.col("Disaster_Occurred")))


def kpi_totals(star: Star, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Events, impacts and average risk; facts are aggregated before joining."""
    by = list(by)
    risk = measure(
        star.fact("unit_month"),
        {"Total_Events": total_events(), "Average_Disaster_Risk_Score": F.avg("Disaster_Risk_Score")}, by, where,
    )
    impact = measure(
        star.fact("events"),
        {
            "Total_Deaths": F.sum("Number_of_Deaths"), "Total_Injuries": F.sum("Number_of_Injuries"),
            "Total_People_Affected": F.sum("Number_of_People_Affected"), "Total_Displaced": F.sum("Displacement_Count"),
            "Total_Economic_Loss_M_USD": F.sum("Economic_Loss_Million"),
        }, by, where,
    )
    # one row per group, or a single row each
    return risk.join(impact, by, "left") if by else risk.join(F.broadcast(impact), F.lit(True))


def kpi_forecast(star: Star, by: Sequence[str] = (), where: Column | None = None, date_role: str = "DateKey") -> DataFrame:
    active = F.col("Predicted_Disaster_Class") == 1
    out = measure(
        star.fact("predictions", date_role),
        {
            "Average_Forecast_Probability": F.avg("Predicted_Disaster_Probability"),
            "Active_Alerts": F.count_if(active),
            "_true": F.count_if(active & (F.col("Actual_Disaster_Occurred") == 1)),
            "Expected_Economic_Risk_M_USD": F.sum("Expected_Economic_Risk_Million"),
        }, by, where,
    )
    out = out.withColumn("Alert_Precision", ratio(F.col("_true"), F.col("Active_Alerts"))).drop("_true")
    return out.withColumn("False_Alarm_Rate", 1.0 - F.col("Alert_Precision"))


def kpi_priority(star: Star, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    top = F.col("Policy_Quadrant") == "High Risk - Low Preparedness (Priority 1)"
    return measure(
        star.fact("unit_month"),
        {
            "Districts_Count": F.count_distinct("GeographyKey"),
            "High_Priority_Districts": F.count_distinct(F.when(top, F.col("GeographyKey"))),
            "Risk_Preparedness_Gap": F.avg("Disaster_Risk_Score") - F.avg("Preparedness_Score"),
        }, by, where,
    )


def kpi_calibration(star: Star) -> DataFrame:
    """Prevalence of the whole panel, model and null Brier, skill."""
    prevalence = measure(
        star.unit_month,
        {"Historical_Disaster_Prevalence": ratio(F.count_if(F.col("Disaster_Occurred") == 1), F.count("Record_ID"))},
    )
    gap = F.col("Predicted_Disaster_Probability") - F.col("Actual_Disaster_Occurred")
    model = measure(star.predictions, {"Brier_Score_Model": ratio(F.sum(gap * gap), F.count("Prediction_ID"))})
    # two single aggregate rows
    both = prevalence.join(F.broadcast(model), F.lit(True))
    p = F.col("Historical_Disaster_Prevalence")
    both = both.withColumn("Brier_Score_Null", p * (1.0 - p))
    return both.withColumn(
        "Brier_Skill_Score", ratio(F.col("Brier_Score_Null") - F.col("Brier_Score_Model"), F.col("Brier_Score_Null"))
    )


def page_overview(star: Star, k: int = 10) -> dict[str, DataFrame]:
    facts = star.fact("unit_month")
    risk = F.avg("Disaster_Risk_Score")
    return {
        "events_by_season": measure(facts, {"Total_Events": total_events()}, ["Season"]),
        "map_by_state": measure(facts, {"Total_Events": total_events(), "Average_Disaster_Risk_Score": risk}, ["State"]),
        "top_risk_units": measure(facts, {"Average_Disaster_Risk_Score": risk}, ["District"]).orderBy(
            F.desc("Average_Disaster_Risk_Score"), "District"
        ).limit(k),
    }


def page_hotspots(star: Star) -> DataFrame:
    return measure(
        star.fact("unit_month"),
        {
            "Total_Events": total_events(), "Average_Preparedness": F.avg("Preparedness_Score"),
            "Average_Disaster_Risk_Score": F.avg("Disaster_Risk_Score"),
            "Risk_Preparedness_Gap": F.avg("Disaster_Risk_Score") - F.avg("Preparedness_Score"),
        },
        ["District", "State", "Region", "Latitude", "Longitude", "Policy_Quadrant"],
    )


def page_trends(star: Star) -> tuple[DataFrame, DataFrame]:
    """Events by year, month and type; month-of-year profile by type."""
    facts = star.fact("unit_month")
    line = measure(facts, {"Total_Events": total_events()}, ["Year", "Month_Number", "Month_Name", "Disaster_Type"], F.col("Disaster_Type") != NO_EVENT)
    profile = measure(facts, {"Total_Events": total_events()}, ["Month_Number", "Month_Name", "Disaster_Type"], F.col("Disaster_Type") != NO_EVENT)
    return line, profile


def page_capacity(panel: DataFrame, quadrants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Poverty against loss by quadrant, and facility rates per unit.

    Read from the panel: the exported star does not carry these columns.
    """
    labelled = panel.join(quadrants.select("District", "Policy_Quadrant"), "District", "left")
    poverty = measure(
        labelled, {"Average_Poverty_Rate": F.avg("Poverty_Rate"), "Total_Economic_Loss_M_USD": F.sum("Economic_Loss_Million")},
        ["Policy_Quadrant"],
    )
    rates = measure(
        panel, {c: F.avg(c) for c in ("Hospital_Rate_per_100k", "Shelter_Rate_per_100k")}, ["District"]
    )
    return poverty, rates


def page_alerts(star: Star) -> DataFrame:
    """Active alerts with their unit, most probable first."""
    rows = star.predictions.where("Predicted_Disaster_Class = 1").join(star.geography, "GeographyKey", "left")
    return rows.select(
        "Prediction_ID", "District", "State", "Policy_Quadrant", "Predicted_Disaster_Probability", "Alert_Level",
        "Expected_Economic_Risk_Million",
    ).orderBy(F.desc("Predicted_Disaster_Probability"), "Prediction_ID")


def page_response(star: Star) -> tuple[DataFrame, DataFrame]:
    """Expected loss by region, and by quadrant x alert level."""
    rows = star.fact("predictions")
    loss = F.sum("Expected_Economic_Risk_Million")
    by_region = measure(rows, {"Expected_Economic_Risk_M_USD": loss}, ["Region"])
    matrix = rows.groupBy("Policy_Quadrant").pivot("Alert_Level", ["Low", "Moderate", "High", "Critical"]).agg(loss)
    return by_region, matrix.fillna(0.0)
