"""Registered queries: star schema, measures and dashboard pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import splits
from ..operators.aggregates import join_typology
from ..sources.durable import durable
from . import oracles as o
from . import star as st
from . import views as v
from .panel_queries import QUADRANTS, _r, r6, unit_quadrants
from .registry import query

T = 0.2
# A fixed score over known-before-the-event columns stands in for a model.
_P = "round(1D / (1D + exp(3D - Rainfall_Anomaly - Previous_Month_Disaster_Occurred)), 4)"
_P_SQL = "round(1.0::DOUBLE/(1.0::DOUBLE+exp(3.0::DOUBLE-Rainfall_Anomaly-Previous_Month_Disaster_Occurred)),4)"
_LOSS = "2D + 3D * Previous_Month_Hazard_Severity"
_LOSS_SQL = "2.0::DOUBLE+3.0::DOUBLE*Previous_Month_Hazard_Severity"

DIMS = f"""{o.FEATURED},
prof AS (SELECT District, avg(Disaster_Risk_Score) risk, avg(Preparedness_Score) prep FROM indexed GROUP BY 1),
meds AS (SELECT median(risk) mr, median(prep) mp FROM prof),
quadrants AS (SELECT District, CASE WHEN risk>mr AND prep<mp THEN 'High Risk - Low Preparedness (Priority 1)'
  WHEN risk>mr THEN 'High Risk - High Preparedness (Priority 2)' WHEN prep<mp THEN 'Low Risk - Low Preparedness (Priority 3)'
  ELSE 'Low Risk - High Preparedness (Priority 4)' END Policy_Quadrant FROM prof, meds),
dim_date AS (SELECT DISTINCT Event_Date AS "Date", strftime(Event_Date,'%Y%m%d')::INT DateKey, "Year"::INT AS "Year",
  year(Event_Date)||'Q'||quarter(Event_Date) AS "Quarter", "Month"::INT Month_Number, strftime(Event_Date,'%B') Month_Name, {o.SEASON} Season FROM panel),
dim_geo AS (SELECT DISTINCT ON (District) District, State, Region, Latitude, Longitude, Population, Area_SqKm, Policy_Quadrant,
  dense_rank() OVER (ORDER BY District)::INT GeographyKey FROM panel JOIN quadrants USING (District)),
dim_type AS (SELECT Disaster_Type, row_number() OVER (ORDER BY (Disaster_Type<>'No Disaster')::INT, first, Disaster_Type)::INT DisasterTypeKey
  FROM (SELECT Disaster_Type, min(Event_Date::VARCHAR||District) first FROM panel GROUP BY 1)),
fum AS (SELECT f.*, strftime(Event_Date,'%Y%m%d')::INT DateKey, g.GeographyKey, t.DisasterTypeKey
  FROM featured f LEFT JOIN dim_geo g USING (District) LEFT JOIN dim_type t ON t.Disaster_Type=f.Disaster_Type),
fe AS (SELECT * FROM fum WHERE Disaster_Occurred=1),
sc AS (SELECT *, {_P_SQL} p, {_LOSS_SQL} loss FROM fum WHERE Disaster_Next_Month IS NOT NULL),
fp AS (SELECT Record_ID Prediction_ID, GeographyKey, DateKey Prediction_DateKey, strftime(Event_Date+INTERVAL 1 MONTH,'%Y%m%d')::INT Forecast_DateKey,
  p Predicted_Disaster_Probability, (p>=0.2)::INT Predicted_Disaster_Class,
  CASE WHEN p<0.2::DOUBLE THEN 'Low' WHEN p<0.2::DOUBLE+0.15::DOUBLE THEN 'Moderate' WHEN p<0.2::DOUBLE+0.3::DOUBLE THEN 'High' ELSE 'Critical' END Alert_Level,
  0.2::DOUBLE Decision_Threshold, Disaster_Next_Month Actual_Disaster_Occurred, p*loss Expected_Economic_Risk_Million,
  CASE WHEN "Year"<=1998 THEN 'Training fitted' WHEN "Year"=1999 THEN 'Calibration' WHEN "Year"=2000 THEN 'Validation' ELSE 'Final test' END Prediction_Type,
  ("Year">1998)::INT Is_Out_Of_Sample, '3.1' Model_Version, '1998-12-01' Training_End_Date FROM sc)"""


def build_star(spark, folder, score=None, threshold: float = T) -> st.Star:
    """Featured panel written once; every dimension and fact reads it.

    ``score`` adds p and predicted_loss to the panel and may choose the threshold: (rows, threshold).
    """
    featured = durable(v.featured(spark, folder))
    typology = unit_quadrants(spark, folder, featured)
    geography = st.dim_geography(featured, typology)
    event_type = st.dim_event_type(featured)
    keyed = st.join_dim_keys(featured, geography, event_type)
    if score is None:
        scored = featured.withColumns({"p": F.expr(_P), "predicted_loss": F.expr(_LOSS)})
    else:
        scored, threshold = score(featured)
    return st.Star(
        st.dim_date(featured), geography, event_type, st.fact_unit_month(keyed), st.fact_events(keyed),
        st.fact_predictions(scored, geography, threshold, train_end=1998, cal_end=1999, val_end=2000, training_end_date="1998-12-01"),
    )


@query("dim_date", f"WITH {DIMS} SELECT * FROM dim_date")
def dim_date_query(spark, folder):
    return st.dim_date(v.panel(spark, folder))


@query("dim_geography", f"WITH {DIMS} SELECT * REPLACE ({r6('Population')}::BIGINT AS Population) FROM dim_geo")
def dim_geography_query(spark, folder):
    return build_star(spark, folder).geography


@query("dim_event_type", f"WITH {DIMS} SELECT * FROM dim_type")
def dim_type_query(spark, folder):
    return st.dim_event_type(v.panel(spark, folder))


@query("surrogate_keys", """WITH f AS (SELECT o_orderpriority, min(o_orderdate::VARCHAR||lpad(o_orderkey::VARCHAR,15,'0')) k FROM orders GROUP BY 1)
  SELECT o_orderpriority, row_number() OVER (ORDER BY k)::INT PriorityKey FROM f""")
def surrogate_query(spark, folder):
    first = v.read_table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")
    )
    return st.surrogate_keys(first, ["first"], "PriorityKey").drop("first")


@query("join_dim_keys", f"WITH {DIMS} SELECT Record_ID, DateKey, GeographyKey, DisasterTypeKey FROM fum")
def join_dim_keys_query(spark, folder):
    panel = durable(v.panel(spark, folder))
    keyed = st.join_dim_keys(panel, st.dim_geography(panel), st.dim_event_type(panel))
    return keyed.select("Record_ID", "DateKey", "GeographyKey", "DisasterTypeKey")


_EXACT = {"Record_ID", "DateKey", "GeographyKey", "DisasterTypeKey", "Disaster_Occurred", "Compound_Event", "Risk_Category",
          "Disaster_Duration_Days", "Number_of_Deaths", "Number_of_Injuries", "Number_of_People_Affected", "Displacement_Count", "Houses_Damaged"}


def _fact_columns(columns):
    return [F.col(c) if c in _EXACT else rounded(F.col(c)).alias(c) for c in columns]


def _fact_sql(columns) -> str:
    return ", ".join(c if c in _EXACT else f"{r6(c)} {c}" for c in columns)


@query("fact_unit_month", f"WITH {DIMS} SELECT {_fact_sql(st.FACT_UNIT_MONTH)} FROM fum")
def fact_unit_month_query(spark, folder):
    return build_star(spark, folder).unit_month.select(*_fact_columns(st.FACT_UNIT_MONTH))


@query("fact_events", f"WITH {DIMS} SELECT {_fact_sql(st.FACT_EVENTS)} FROM fe")
def fact_events_query(spark, folder):
    return build_star(spark, folder).events.select(*_fact_columns(st.FACT_EVENTS))


@query("fact_predictions", f"WITH {DIMS} SELECT * REPLACE ({r6('Expected_Economic_Risk_Million')} AS Expected_Economic_Risk_Million) FROM fp")
def fact_predictions_query(spark, folder):
    facts = build_star(spark, folder).predictions
    return facts.withColumn("Expected_Economic_Risk_Million", rounded(F.col("Expected_Economic_Risk_Million")))


_TOTALS = ["Total_Events", "Total_Deaths", "Total_Injuries", "Total_People_Affected", "Total_Displaced"]


@query("kpi_totals", f"""WITH {DIMS}, a AS (SELECT g.Region, sum(Disaster_Occurred)::BIGINT Total_Events, avg(Disaster_Risk_Score) r FROM fum JOIN dim_geo g USING (GeographyKey) GROUP BY 1),
  b AS (SELECT g.Region, sum(Number_of_Deaths)::BIGINT Total_Deaths, sum(Number_of_Injuries)::BIGINT Total_Injuries, sum(Number_of_People_Affected)::BIGINT Total_People_Affected,
  sum(Displacement_Count)::BIGINT Total_Displaced, sum(Economic_Loss_Million) l FROM fe JOIN dim_geo g USING (GeographyKey) GROUP BY 1)
  SELECT Region, {', '.join(_TOTALS)}, {r6('l', 4)} Total_Economic_Loss_M_USD, {r6('r')} Average_Disaster_Risk_Score FROM a LEFT JOIN b USING (Region)""")
def kpi_totals_query(spark, folder):
    out = st.kpi_totals(build_star(spark, folder), ["Region"])
    return out.select("Region", *_TOTALS, *_r("Average_Disaster_Risk_Score"), *_r("Total_Economic_Loss_M_USD", digits=4))


_FORECAST = f"""avg(Predicted_Disaster_Probability) fa, count(*) FILTER (Predicted_Disaster_Class=1) Active_Alerts,
  count(*) FILTER (Predicted_Disaster_Class=1 AND Actual_Disaster_Occurred=1) tp, sum(Expected_Economic_Risk_Million) er"""
_FORECAST_OUT = f"""{r6('fa')} Average_Forecast_Probability, Active_Alerts, {r6('CASE WHEN Active_Alerts=0 THEN 0 ELSE tp::DOUBLE/Active_Alerts END')} Alert_Precision,
  {r6('1-CASE WHEN Active_Alerts=0 THEN 0 ELSE tp::DOUBLE/Active_Alerts END')} False_Alarm_Rate, {r6('er', 4)} Expected_Economic_Risk_M_USD"""


def _forecast(df, *keys):
    return df.select(
        *keys, "Active_Alerts", *_r("Average_Forecast_Probability", "Alert_Precision", "False_Alarm_Rate"),
        *_r("Expected_Economic_Risk_M_USD", digits=4),
    )


@query("kpi_forecast", f"WITH {DIMS}, k AS (SELECT Region, {_FORECAST} FROM fp JOIN dim_geo USING (GeographyKey) GROUP BY 1) SELECT Region, {_FORECAST_OUT} FROM k")
def kpi_forecast_query(spark, folder):
    return _forecast(st.kpi_forecast(build_star(spark, folder), ["Region"]), "Region")


@query("kpi_priority", f"""WITH {DIMS} SELECT g.Region, count(DISTINCT GeographyKey) Districts_Count,
  count(DISTINCT CASE WHEN g.Policy_Quadrant LIKE '%(Priority 1)' THEN GeographyKey END) High_Priority_Districts,
  {r6('avg(Disaster_Risk_Score)-avg(Preparedness_Score)')} Risk_Preparedness_Gap FROM fum JOIN dim_geo g USING (GeographyKey) GROUP BY 1""")
def kpi_priority_query(spark, folder):
    out = st.kpi_priority(build_star(spark, folder), ["Region"])
    return out.select("Region", "Districts_Count", "High_Priority_Districts", *_r("Risk_Preparedness_Gap"))


@query("kpi_calibration", f"""WITH {DIMS}, a AS (SELECT avg(Disaster_Occurred) q FROM fum), b AS (SELECT avg(pow(Predicted_Disaster_Probability-Actual_Disaster_Occurred,2)) m FROM fp)
  SELECT {r6('q')} Historical_Disaster_Prevalence, {r6('m')} Brier_Score_Model, {r6('q*(1-q)')} Brier_Score_Null, {r6('(q*(1-q)-m)/(q*(1-q))')} Brier_Skill_Score FROM a, b""")
def kpi_calibration_query(spark, folder):
    out = st.kpi_calibration(build_star(spark, folder))
    return out.select(*_r(*out.columns))


@query("page_overview", f"""WITH {DIMS}, j AS (SELECT f.*, d.Season dseason FROM fum f JOIN dim_date d USING (DateKey)),
  top AS (SELECT District lb, avg(Disaster_Risk_Score) r FROM j GROUP BY 1 ORDER BY r DESC, lb LIMIT 10)
  SELECT 'season' visual, dseason label, sum(Disaster_Occurred)::BIGINT Total_Events, NULL::DOUBLE Average_Disaster_Risk_Score FROM j GROUP BY 2
  UNION ALL SELECT 'state', State, sum(Disaster_Occurred)::BIGINT, {r6('avg(Disaster_Risk_Score)')} FROM j GROUP BY 2
  UNION ALL SELECT 'top_units', lb, NULL, {r6('r')} FROM top""")
def page_overview_query(spark, folder):
    pages = st.page_overview(build_star(spark, folder))
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    parts = [
        pages["events_by_season"].select(F.lit("season").alias("visual"), F.col("Season").alias("label"), "Total_Events", none_d.alias("Average_Disaster_Risk_Score")),
        pages["map_by_state"].select(F.lit("state").alias("visual"), F.col("State").alias("label"), "Total_Events", *_r("Average_Disaster_Risk_Score")),
        pages["top_risk_units"].select(F.lit("top_units").alias("visual"), F.col("District").alias("label"), none_l.alias("Total_Events"), *_r("Average_Disaster_Risk_Score")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("page_hotspots", f"""WITH {DIMS} SELECT g.District, g.State, g.Region, g.Latitude, g.Longitude, g.Policy_Quadrant, sum(Disaster_Occurred)::BIGINT Total_Events,
  {r6('avg(Preparedness_Score)')} Average_Preparedness, {r6('avg(Disaster_Risk_Score)')} Average_Disaster_Risk_Score,
  {r6('avg(Disaster_Risk_Score)-avg(Preparedness_Score)')} Risk_Preparedness_Gap FROM fum JOIN dim_geo g USING (GeographyKey) GROUP BY ALL""")
def page_hotspots_query(spark, folder):
    out = st.page_hotspots(build_star(spark, folder))
    return out.select("District", "State", "Region", "Latitude", "Longitude", "Policy_Quadrant", F.coalesce("Total_Events", F.lit(0)).alias("Total_Events"),
                      *_r("Average_Preparedness", "Average_Disaster_Risk_Score", "Risk_Preparedness_Gap"))


@query("page_trends", f"""WITH {DIMS} SELECT d."Year", d.Month_Number, d.Month_Name, Disaster_Type, sum(Disaster_Occurred)::BIGINT Total_Events
  FROM fum JOIN dim_date d USING (DateKey) WHERE Disaster_Type<>'No Disaster' GROUP BY ALL""")
def page_trends_query(spark, folder):
    return st.page_trends(build_star(spark, folder))[0]


@query("page_seasonal_profile", f"""WITH {DIMS} SELECT d.Month_Number, d.Month_Name, Disaster_Type, sum(Disaster_Occurred)::BIGINT Total_Events
  FROM fum JOIN dim_date d USING (DateKey) WHERE Disaster_Type<>'No Disaster' GROUP BY ALL""")
def page_profile_query(spark, folder):
    return st.page_trends(build_star(spark, folder))[1]


@query("page_capacity", f"""WITH {QUADRANTS} SELECT Policy_Quadrant, {r6('avg(Poverty_Rate)')} Average_Poverty_Rate, {r6('sum(Economic_Loss_Million)', 4)} Total_Economic_Loss_M_USD
  FROM indexed JOIN quadrants USING (District) GROUP BY 1""")
def page_capacity_query(spark, folder):
    indexed = durable(v.indexed(spark, folder))
    poverty, _ = st.page_capacity(indexed, unit_quadrants(spark, folder, indexed))
    return poverty.select("Policy_Quadrant", *_r("Average_Poverty_Rate"), *_r("Total_Economic_Loss_M_USD", digits=4))


@query("page_facility_rates", f"""WITH {o.RATED} SELECT District, {r6('avg(Hospital_Rate_per_100k)')} Hospital_Rate_per_100k, {r6('avg(Shelter_Rate_per_100k)')} Shelter_Rate_per_100k FROM rated GROUP BY 1""")
def page_rates_query(spark, folder):
    rated = st_rates(spark, folder)
    _, rates = st.page_capacity(rated, rated.select("District").distinct().withColumn("Policy_Quadrant", F.lit("Unknown")))
    return rates.select("District", *_r("Hospital_Rate_per_100k", "Shelter_Rate_per_100k"))


def st_rates(spark, folder):
    from ..operators.index import facility_rates

    return facility_rates(v.panel(spark, folder))


@query("page_alerts", f"""WITH {DIMS} SELECT Prediction_ID, District, State, Policy_Quadrant, Predicted_Disaster_Probability, Alert_Level,
  {r6('Expected_Economic_Risk_Million')} Expected_Economic_Risk_Million FROM fp JOIN dim_geo USING (GeographyKey) WHERE Predicted_Disaster_Class=1""")
def page_alerts_query(spark, folder):
    out = st.page_alerts(build_star(spark, folder))
    return out.withColumn("Expected_Economic_Risk_Million", rounded(F.col("Expected_Economic_Risk_Million")))


@query("page_response", f"WITH {DIMS} SELECT Region, {r6('sum(Expected_Economic_Risk_Million)', 4)} Expected_Economic_Risk_M_USD FROM fp JOIN dim_geo USING (GeographyKey) GROUP BY 1")
def page_response_query(spark, folder):
    return st.page_response(build_star(spark, folder))[0].select("Region", *_r("Expected_Economic_Risk_M_USD", digits=4))


@query("page_response_matrix", f"WITH {DIMS} SELECT Policy_Quadrant, " + ", ".join(
    f"{r6(f'''coalesce(sum(Expected_Economic_Risk_Million) FILTER (Alert_Level='{a}'),0)''', 4)} AS {a}" for a in ("Low", "Moderate", "High", "Critical"))
    + " FROM fp JOIN dim_geo USING (GeographyKey) GROUP BY 1")
def page_matrix_query(spark, folder):
    return st.page_response(build_star(spark, folder))[1].select("Policy_Quadrant", *_r("Low", "Moderate", "High", "Critical", digits=4))


@query("inactive_date_role", f"""WITH {DIMS}, k AS (SELECT d."Year", {_FORECAST} FROM fp LEFT JOIN dim_date d ON d.DateKey=fp.Forecast_DateKey GROUP BY 1)
  SELECT "Year", {_FORECAST_OUT} FROM k""")
def inactive_role_query(spark, folder):
    return _forecast(st.kpi_forecast(build_star(spark, folder), ["Year"], date_role="Forecast_DateKey"), "Year")


# --- chronological splits ---------------------------------------------------

_SPLIT3 = "CASE WHEN \"Year\"<=1998 THEN 'train' WHEN \"Year\"<=2000 THEN 'validation' ELSE 'test' END"


def _labelled(parts, names):
    out = None
    for name, part in zip(names, parts):
        one = part.groupBy().agg(F.count(F.lit(1)).alias("n_rows"), F.min("Year").alias("first_year"), F.max("Year").alias("last_year"),
                                 F.sum("Disaster_Occurred").alias("n_events")).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.where("n_rows > 0")


def _split_sql(case: str, where: str) -> str:
    return f"""WITH {o.FEATURED} SELECT {case} split, count(*) n_rows, min("Year") first_year, max("Year") last_year,
  sum(Disaster_Occurred)::BIGINT n_events FROM featured {where} GROUP BY 1"""


def _targets(spark, folder):
    from ..operators.features import lead_target

    return lead_target(v.panel(spark, folder)).select("Year", "Disaster_Occurred", "Disaster_Next_Month")


@query("split_3way", _split_sql(_SPLIT3, "WHERE Disaster_Next_Month IS NOT NULL"))
def split3_query(spark, folder):
    return _labelled(splits.split_3way(_targets(spark, folder), train_end=1998, val_end=2000), ["train", "validation", "test"])


_SPLIT4 = "CASE WHEN \"Year\"<=1998 THEN 'train' WHEN \"Year\"=1999 THEN 'calibration' WHEN \"Year\"=2000 THEN 'validation' ELSE 'test' END"


@query("split_4way", _split_sql(_SPLIT4, "WHERE Disaster_Next_Month IS NOT NULL"))
def split4_query(spark, folder):
    parts = splits.split_4way(_targets(spark, folder), train_end=1998, cal_end=1999, val_end=2000)
    return _labelled(parts, ["train", "calibration", "validation", "test"])


@query("split_regression", _split_sql(_SPLIT3, "WHERE Disaster_Occurred=1"))
def split_regression_query(spark, folder):
    events = _targets(spark, folder).where("Disaster_Occurred = 1")
    return _labelled(splits.split_regression(events, train_end=1998, val_end=2000), ["train", "validation", "test"])


@query("typology_labels", f"""WITH {o.INDEXED}, u AS (SELECT Region, avg(Hazard_Score) hz FROM indexed GROUP BY 1),
  r AS (SELECT Region, row_number() OVER (ORDER BY hz, Region)-1 c FROM u) SELECT Region, c::INT Cluster,
  CASE c WHEN 0 THEN 'High-Exposure Well-Prepared' WHEN 1 THEN 'High-Exposure Low-Capacity' WHEN 2 THEN 'High-Vulnerability Low-Capacity' WHEN 3 THEN 'Low-Risk Well-Prepared' ELSE 'Unknown' END Cluster_Label FROM r""")
def typology_query(spark, folder):
    from ..operators.clusters import label_clusters, order_clusters

    centres = v.indexed(spark, folder).groupBy("Region").agg(F.avg("Hazard_Score").alias("hz"))
    return label_clusters(order_clusters(centres, ["hz", "Region"])).select("Region", "Cluster", "Cluster_Label")


@query("typology_fallback", f"WITH {o.PANEL} SELECT Record_ID, -1 AS Cluster, 'Unknown' Cluster_Label, 'Unknown' Policy_Quadrant FROM panel")
def typology_fallback_query(spark, folder):
    return join_typology(v.panel(spark, folder), None).select("Record_ID", "Cluster", "Cluster_Label", "Policy_Quadrant")
