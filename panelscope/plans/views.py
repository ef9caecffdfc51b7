"""Views of the supplied star-schema tables in the roles of the domain model.

unit = supplier, group = region, period = ship month.  One lineitem
aggregation by (supplier, month), map-side combined, feeds every panel query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..operators.features import engineer_features
from ..operators.index import facility_rates, fit_index, preparedness_index, score_index
from ..operators.panel import panel_complete_sums
from ..sources.durable import durable
from ..sources.tables import read_table


def unit_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Row-level observations: lineitems with unit and month."""
    return read_table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS unit", "trunc(CAST(l_shipdate AS DATE), 'month') AS Event_Date",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    )


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Unit dimension: supplier with state, region and coordinates."""
    supplier = read_table(spark, folder, "supplier")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "n_nationkey", "n_name AS State", "r_name AS Region"
    )
    # nation and region have a fixed size (25 and 5 rows) at every scale factor
    return supplier.join(F.broadcast(places), supplier.s_nationkey == places.n_nationkey).select(
        F.col("s_suppkey").alias("unit"),
        F.format_string("D_%06d", "s_suppkey").alias("District"),
        "State",
        "Region",
        F.round(F.lit(-60.0) + F.lit(120.0) * uniform("lat", F.col("s_suppkey")), 4).alias("Latitude"),
        F.round(F.lit(-180.0) + F.lit(360.0) * uniform("lon", F.col("s_suppkey")), 4).alias("Longitude"),
        F.col("s_acctbal").alias("acct"),
        F.expr("CAST(s_nationkey AS DOUBLE) AS place"),
    )


_SUMS = {
    "n_lines": "CAST(1 AS BIGINT)",
    "n_returned": "CAST(l_returnflag = 'R' AS BIGINT)",
    "qty": "l_quantity",
    "price": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
    "returned_qty": "IF(l_returnflag = 'R', l_quantity, 0D)",
    "returned_price": "IF(l_returnflag = 'R', l_extendedprice, 0D)",
}


def monthly_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Balanced unit x month sums, zero-filled."""
    sums = panel_complete_sums(
        unit_cells(spark, folder),
        read_table(spark, folder, "supplier").selectExpr("s_suppkey AS unit"),
        "unit",
        "Event_Date",
        {name: F.expr(text) for name, text in _SUMS.items()},
    )
    money = ("qty", "price", "discount", "tax", "returned_qty", "returned_price")
    return sums.selectExpr("unit", "Event_Date", "n_lines", "n_returned", *[f"round({c}, 2) AS {c}" for c in money])


# Helper columns, then the domain schema.  Impacts are 0 without an event.
_HELPERS = [
    "*",
    "returned_qty >= 110 AS f",
    "IF(returned_qty >= 110, least(10D, greatest(1D, returned_qty / 20D)), 0D) AS severity",
    "CAST(n_lines AS DOUBLE) AS nl",
    "CAST(100000 + floor(acct * 10D) AS BIGINT) AS pop",
    "500D + 20D * place AS area",
    "CAST(qty AS BIGINT) % 4 AS kind",
]
_PANEL = [
    "format_string('REC_%d_%02d_%s', year(Event_Date), month(Event_Date), District) AS Record_ID",
    "District", "State", "Region", "Latitude", "Longitude",
    "CAST(year(Event_Date) AS BIGINT) AS Year",
    "CAST(month(Event_Date) AS BIGINT) AS Month",
    "Event_Date",
    """CASE WHEN NOT f THEN 'No Disaster' WHEN kind = 0 THEN 'Flood' WHEN kind = 1 THEN 'Cyclone'
       WHEN kind = 2 THEN 'Drought' ELSE 'Earthquake' END AS Disaster_Type""",
    "CAST(f AS BIGINT) AS Disaster_Occurred",
    "CAST(floor(severity * 2D) AS BIGINT) AS Disaster_Duration_Days",
    "severity * 1.1D AS Disaster_Magnitude",
    "severity AS Hazard_Severity",
    "qty AS Monthly_Rainfall_mm",
    "CAST(returned_qty >= 150 AS BIGINT) AS Compound_Event",
    "(qty - 185D) / 75D AS Rainfall_Anomaly",
    "15D + discount * 30D AS Temperature_Celsius",
    "(discount - 0.36D) / 0.15D AS Temperature_Anomaly",
    "nl * 5D AS Wind_Speed_kmph",
    "2D + qty / 100D AS River_Level_Metres",
    "qty / (qty + 185D) AS Soil_Moisture",
    "100D / (1D + nl) AS Drought_Index",
    "nl / (nl + 7D) AS Vegetation_Index",
    "100D + 40D * place AS Elevation_Metres",
    "1.2D * place AS Slope_Degrees",
    "20D * place AS Distance_From_Coast_km",
    "5D + place / 2D AS Distance_From_River_km",
    "tax * 10D AS Seismic_Activity_Index",
    "pop AS Population",
    "area AS Area_SqKm",
    "CAST(pop AS DOUBLE) / area AS Population_Density",
    "(acct + 1000D) / 11000D AS Urbanisation_Rate",
    "100D * price / (price + 300000D) AS Infrastructure_Density",
    "returned_qty / (qty + 1D) AS Poverty_Rate",
    "20D * discount / (discount + 0.36D) AS Elderly_Population_Percentage",
    "30D * tax / (tax + 0.3D) AS Child_Population_Percentage",
    "100D * price / (price + 200000D) AS Housing_Quality_Index",
    "100D - 50D * nl / (nl + 7D) AS Healthcare_Access_Index",
    "40D + 2D * place AS Road_Access_Index",
    "90D - place AS Communication_Access_Index",
    "n_lines AS Raw_Shelter_Count",
    "n_lines - n_returned AS Raw_Hospital_Count",
    "n_returned AS Raw_Rescue_Team_Count",
    "CAST(acct > 5000 AS BIGINT) AS Early_Warning_System",
    "CAST(place AS BIGINT) % 2 AS Evacuation_Plan_Available",
    "20D + 80D / (1D + nl) AS Emergency_Response_Time_Minutes",
    "IF(f, n_returned, 0L) AS Number_of_Deaths",
    "IF(f, n_returned * 3L, 0L) AS Number_of_Injuries",
    "IF(f, CAST(returned_qty * 10D AS BIGINT), 0L) AS Number_of_People_Affected",
    "IF(f, CAST(returned_qty AS BIGINT), 0L) AS Displacement_Count",
    "IF(f, n_lines, 0L) AS Houses_Damaged",
    "IF(f, least(100D, returned_qty / 3D), 0D) AS Infrastructure_Damage_Score",
    "IF(f, least(100D, returned_qty / 5D), 0D) AS Crop_Loss_Percentage",
    "IF(f, returned_price / 10000D, 0D) AS Economic_Loss_Million",
]


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Raw panel in the domain schema, one row per (District, Year, Month)."""
    unit_table = units(spark, folder)
    # A plain equi-join: Spark broadcasts the unit table while it is under the
    # auto-broadcast size and shuffles both sides beyond it.
    base = monthly_sums(spark, folder).join(unit_table, "unit")
    return base.selectExpr(*_HELPERS).selectExpr(*_PANEL).withColumn(
        "Disaster_Preparedness_Index", preparedness_index()
    )


def indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Panel with rates, component scores, risk score and category.

    The rated panel is far smaller than the line items; it is written once so
    that fitting the ranges, fitting the thresholds and scoring read it
    instead of scanning and aggregating the line items three times.
    """
    rated = durable(facility_rates(panel(spark, folder)))
    return score_index(rated, fit_index(rated))


def featured(spark: SparkSession, folder: str) -> DataFrame:
    """Indexed panel with calendar, lag, rolling and lead features."""
    return engineer_features(indexed(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scored binary rows (unit, y, p) from the event stream table.

    p is kept to four digits, so it takes at most 10,001 distinct values.
    """
    return read_table(spark, folder, "events").selectExpr(
        "event_id", "user_id AS unit", "ts", "CAST(event_type = 'error' AS INT) AS y",
        "round(value / (value + 50D), 4) AS p",
        "round(value / (value + 200D), 4) AS p_low",
        "round(1D / (1D + exp(-value / 100D)), 4) AS p_logit",
    )


def losses(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows with a loss and a predicted loss (row grain: unit-month)."""
    return panel(spark, folder).where("Disaster_Occurred = 1").selectExpr(
        "Record_ID", "District AS unit", "Region", "Year", "Month",
        "Economic_Loss_Million AS y", "3D * Hazard_Severity + 2D AS y_hat",
    )


def line_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Line-grain loss rows: observed price against a flat unit price."""
    return read_table(spark, folder, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS id", "l_suppkey AS unit",
        "l_extendedprice AS y", "l_quantity * 1500D AS y_hat",
    )
