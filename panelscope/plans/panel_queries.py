"""Registered queries: sources, profiling, projections, joins, aggregates, windows, top-k."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.numeric import half_even, rounded
from ..operators import aggregates as agg
from ..operators import features as feat
from ..operators import index as idx
from ..operators import ordering, panel as pan, profile as prof
from ..schema import COMPONENTS, EXPERT_WEIGHTS
from ..sources.durable import durable, shared_folder
from ..sources.tables import read_panel, read_table, write_panel, write_results
from . import oracles as o
from . import views as v
from .registry import query


def r6(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE,{digits})+0.0::DOUBLE)"


def _r(*names: str, digits: int = 6):
    return [rounded(F.col(n), digits).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


# --- sources, sinks, assembly ----------------------------------------------


@query("read_panel", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def read_panel_query(spark, folder):
    df = read_panel(spark, f"{folder}/orders.parquet", required=["o_orderkey", "o_custkey"])
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("write_panel", f"""WITH {o.PANEL} SELECT "Year", count(*) n_rows, sum(Disaster_Occurred)::BIGINT n_events,
  {r6('sum(Economic_Loss_Million)', 4)} loss FROM panel GROUP BY 1""")
def write_panel_query(spark, folder):
    path = f"{shared_folder(spark)}/panel-{uuid4().hex}"
    write_panel(v.panel(spark, folder), path)
    back = read_panel(spark, path)
    return back.groupBy(F.col("Year").cast("bigint").alias("Year")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("Disaster_Occurred").alias("n_events"),
        rounded(F.sum("Economic_Loss_Million"), 4).alias("loss"),
    )


@query("write_results", f"""WITH {o.PANEL} SELECT Region, sum(Disaster_Occurred)::BIGINT n_events FROM panel GROUP BY 1""")
def write_results_query(spark, folder):
    path = f"{shared_folder(spark)}/results-{uuid4().hex}"
    write_results(agg.events_per(v.panel(spark, folder), ["Region"]), path)
    return spark.read.schema("Region string, n_events bigint").json(path)


@query("panel_complete", f"WITH {o.UNITS}, {o.CELLS} SELECT unit, Event_Date, n_lines, qty FROM monthly")
def panel_complete_query(spark, folder):
    cells = v.unit_cells(spark, folder).groupBy("unit", "Event_Date").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )
    return pan.panel_complete(cells, v.units(spark, folder), "unit", "Event_Date", {"n_lines": 0, "qty": 0.0})


@query("duplicate_keys", """SELECT l_suppkey AS unit, date_trunc('month', l_shipdate)::DATE AS Event_Date, count(*) AS n_rows
  FROM lineitem GROUP BY 1,2 HAVING count(*)>1""")
def duplicate_keys_query(spark, folder):
    return pan.duplicate_keys(v.unit_cells(spark, folder), ["unit", "Event_Date"])


@query("panel_balance", f"""WITH {o.PANEL} SELECT count(DISTINCT District) n_units, count(DISTINCT Event_Date) n_periods,
  count(*) n_rows, {r6('avg(Disaster_Occurred)')} prevalence,
  count(DISTINCT District)*count(DISTINCT Event_Date)=count(*) is_balanced FROM panel""")
def panel_balance_query(spark, folder):
    out = pan.panel_balance(v.panel(spark, folder), "District", "Event_Date", "Disaster_Occurred")
    return out.withColumn("prevalence", rounded(F.col("prevalence")))


# --- profiling and cleaning -------------------------------------------------

_PROFILED = ["Record_ID", "Disaster_Occurred", "Hazard_Severity", "Disaster_Next_Month"]


@query("profile_structure", f"WITH {o.FEATURED} " + " UNION ALL ".join(
    f"SELECT '{c}' column_name, count(*) n_rows, {len(_PROFILED)} n_columns, count(*)-count({c}) null_count FROM featured"
    for c in _PROFILED))
def profile_structure_query(spark, folder):
    df = feat.lead_target(v.panel(spark, folder)).select(*_PROFILED)
    return prof.profile_structure(df).drop("data_type")


@query("duplicate_count", """SELECT 'duplicate_records' "check", coalesce(sum(n-1),0)::BIGINT excess
  FROM (SELECT count(*) n FROM events GROUP BY user_id, event_type)
  UNION ALL SELECT 'duplicate_event_ids', coalesce(sum(n-1),0)::BIGINT FROM (SELECT count(*) n FROM events GROUP BY user_id)""")
def duplicate_count_query(spark, folder):
    return prof.duplicate_count(read_table(spark, folder, "events").select("user_id", "event_type"), "user_id")


@query("impossible_values", """WITH t AS (SELECT floor(c_acctbal) d, c_acctbal e, c_acctbal/100 lat FROM customer)
  SELECT 'negative_deaths' "check", count(*) FILTER (d<0) n_rows FROM t
  UNION ALL SELECT 'negative_injuries', 0 FROM (SELECT 1)
  UNION ALL SELECT 'negative_economic_loss', count(*) FILTER (e<0) FROM t
  UNION ALL SELECT 'invalid_latitude', count(*) FILTER (lat<-90 OR lat>90) FROM t
  UNION ALL SELECT 'invalid_longitude', 0 FROM (SELECT 1)""")
def impossible_values_query(spark, folder):
    customer = read_table(spark, folder, "customer")
    return prof.impossible_values(
        customer.select(
            F.floor("c_acctbal").alias("Number_of_Deaths"),
            F.col("c_acctbal").alias("Economic_Loss_Million"),
            (F.col("c_acctbal") / 100).alias("Latitude"),
        )
    )


_IQR = ["Monthly_Rainfall_mm", "Wind_Speed_kmph", "Seismic_Activity_Index", "Hazard_Severity"]


@query("iqr_outliers", f"WITH {o.PANEL}, q AS (" + " UNION ALL ".join(
    f"SELECT '{c}' variable, {c} x, quantile_cont({c},0.25) OVER () q1, quantile_cont({c},0.75) OVER () q3 FROM panel"
    for c in _IQR) + """) SELECT variable, round(any_value(q1-1.5*(q3-q1)),2) lower_bound,
  round(any_value(q3+1.5*(q3-q1)),2) upper_bound,
  count(*) FILTER (x<q1-1.5*(q3-q1) OR x>q3+1.5*(q3-q1)) outliers_count FROM q GROUP BY 1""")
def iqr_outliers_query(spark, folder):
    return prof.iqr_outliers(v.panel(spark, folder), _IQR)


@query("clean_panel", """SELECT DISTINCT o_orderkey, o_orderdate::DATE AS Event_Date,
  round(greatest(o_totalprice-200000, 0),2) AS Economic_Loss_Million FROM orders""")
def clean_panel_query(spark, folder):
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Event_Date"),
        F.round(F.col("o_totalprice") - 200000, 2).alias("Economic_Loss_Million"),
    )
    return pan.clean_panel(orders.unionByName(orders))


@query("impute_median", """WITH m AS (SELECT median(l_extendedprice) v FROM lineitem WHERE l_returnflag<>'N')
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag<>'N' THEN l_extendedprice ELSE v END AS price FROM lineitem, m""")
def impute_median_query(spark, folder):
    df = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("price")
    )
    return prof.impute_median(df, ["price"])


@query("impute_mode", """WITH c AS (SELECT event_type v, count(*) n FROM events WHERE event_type<>'error' GROUP BY 1),
  m AS (SELECT v FROM c ORDER BY n DESC, v LIMIT 1)
  SELECT event_id, CASE WHEN event_type='error' THEN v ELSE event_type END event_type FROM events, m""")
def impute_mode_query(spark, folder):
    df = read_table(spark, folder, "events").select("event_id", F.expr("nullif(event_type, 'error')").alias("event_type"))
    return prof.impute_mode(df, ["event_type"])


_RANGES = [("Monthly_Rainfall_mm", 0, 1000), ("Temperature_Celsius", 5, 48), ("Wind_Speed_kmph", 0, 200),
           ("Population_Density", 50, 11000), ("Poverty_Rate", 0.05, 0.50), ("Elevation_Metres", 0, 8848)]


@query("reference_range_check", f"WITH {o.PANEL} " + " UNION ALL ".join(
    f"""SELECT '{c}' variable, round(min({c}),2) min_value, round(max({c}),2) max_value, round(avg({c}),2) mean_value,
    round(stddev_samp({c}),2) std_value, round(median({c}),2) median_value,
    round(min({c}),2)>={lo}*0.8 AND round(max({c}),2)<={hi}*1.2 within_range FROM panel""" for c, lo, hi in _RANGES)
    + """ UNION ALL SELECT 'disaster_prevalence', NULL, NULL, round(avg(Disaster_Occurred),4), NULL, NULL,
    avg(Disaster_Occurred) BETWEEN 0.10 AND 0.20 FROM panel""")
def reference_range_query(spark, folder):
    return prof.reference_range_check(v.panel(spark, folder))


_DICT = [("Record_ID", "string", "Identification"), ("Event_Date", "date", "Temporal Coordinate"),
         ("Rainfall_Anomaly", "double", "Environmental Variable"), ("Population", "bigint", "Exposure Variable"),
         ("Area_SqKm", "double", "Feature (Derived)"), ("Poverty_Rate", "double", "Vulnerability Variable"),
         ("Early_Warning_System", "bigint", "Preparedness Variable"),
         ("Economic_Loss_Million", "double", "Post-Event Impact Variable"),
         ("Disaster_Next_Month", "int", "Lead Variable (Target)"), ("Coastal_Region_Flag", "int", "Feature (Derived)")]


@query("column_dictionary", f"WITH {o.FEATURED} " + " UNION ALL ".join(
    f"SELECT '{c}' Column_Name, '{t}' Data_Type, '{role}' Variable_Role, count(*)-count({c}) Null_Count FROM featured"
    for c, t, role in _DICT))
def column_dictionary_query(spark, folder):
    df = feat.lead_target(feat.threshold_flags(v.panel(spark, folder)))
    return prof.column_dictionary(df.select(*[c for c, _, _ in _DICT])).drop("Description")


_IMPACTS = ["Number_of_Deaths", "Number_of_Injuries", "Number_of_People_Affected", "Displacement_Count",
            "Houses_Damaged", "Infrastructure_Damage_Score", "Crop_Loss_Percentage", "Economic_Loss_Million"]
_RULES = {
    "latitude_bounds": "Latitude BETWEEN -90 AND 90", "longitude_bounds": "Longitude BETWEEN -180 AND 180",
    "soil_moisture_bounds": "Soil_Moisture BETWEEN 0 AND 1", "vegetation_bounds": "Vegetation_Index BETWEEN 0 AND 1",
    "drought_bounds": "Drought_Index BETWEEN 0 AND 100",
    "preparedness_bounds": "Disaster_Preparedness_Index BETWEEN 10 AND 100",
    "flag_binary": "Disaster_Occurred IN (0,1)", "early_warning_binary": "Early_Warning_System IN (0,1)",
    "evacuation_binary": "Evacuation_Plan_Available IN (0,1)", "label_not_null": "Disaster_Type<>''",
    **{f"non_negative_{c}": f"{c}>=0" for c in _IMPACTS},
    **{f"zero_without_event_{c}": f"(Disaster_Occurred<>0 OR {c}=0)" for c in _IMPACTS},
}


@query("quality_rules", f"WITH {o.PANEL} " + " UNION ALL ".join(
    f"SELECT '{n}' \"rule\", count(*) FILTER (({c}) IS NOT TRUE) violations FROM panel" for n, c in _RULES.items()))
def quality_rules_query(spark, folder):
    return prof.quality_rules(v.panel(spark, folder))


_DESCRIBED = ["Hazard_Score", "Exposure_Score", "Disaster_Risk_Score"]


@query("describe", f"WITH {o.INDEXED} " + " UNION ALL ".join(
    f"""SELECT '{c}' variable, count({c}) "count", {r6(f'avg({c})')} "mean", {r6(f'stddev_samp({c})')} "std",
    {r6(f'min({c})')} "min", {r6(f'quantile_cont({c},0.25)')} q25, {r6(f'quantile_cont({c},0.5)')} q50,
    {r6(f'quantile_cont({c},0.75)')} q75, {r6(f'max({c})')} "max" FROM indexed""" for c in _DESCRIBED))
def describe_query(spark, folder):
    out = prof.describe(v.indexed(spark, folder), _DESCRIBED)
    return out.select("variable", "count", *_r("mean", "std", "min", "q25", "q50", "q75", "max"))


# --- projections ------------------------------------------------------------

_RATES = ["Shelter_Rate_per_100k", "Hospital_Rate_per_100k", "Rescue_Team_Rate_per_100k"]


@query("rates_per_100k", f"WITH {o.RATED} SELECT Record_ID, {_rs(*_RATES)} FROM rated")
def rates_query(spark, folder):
    return idx.facility_rates(v.panel(spark, folder)).select("Record_ID", *_r(*_RATES))


@query("minmax_fit", f"WITH {o.RATED} " + " UNION ALL ".join(
    f"SELECT '{n}' \"input\", {r6(f'min({e})')} \"min\", {r6(f'max({e})')} \"max\" FROM rated" for n, e in o.INPUTS.items()))
def minmax_fit_query(spark, folder):
    return idx.minmax_fit(idx.facility_rates(v.panel(spark, folder)), idx.INDEX_INPUTS).select("input", *_r("min", "max"))


_SCALED = list(o.INPUTS)


@query("minmax_scale", f"WITH {o.SCALED} SELECT Record_ID, " + ", ".join(f"{r6('s_'+n)} AS {n}" for n in _SCALED) + " FROM scaled")
def minmax_scale_query(spark, folder):
    rated = durable(idx.facility_rates(v.panel(spark, folder)))
    inputs = idx.INDEX_INPUTS
    ranges = {r["input"]: (r["min"], r["max"]) for r in idx.minmax_fit(rated, inputs).collect()}
    return rated.select(
        "Record_ID", *[rounded(F.expr(idx.minmax_scale(e, *ranges[n]))).alias(n) for n, e in inputs.items()]
    )


def _score_query(name: str, *columns: str):
    @query(name, f"WITH {o.INDEXED} SELECT Record_ID, {_rs(*columns)} FROM indexed")
    def run(spark, folder):
        return v.indexed(spark, folder).select("Record_ID", *_r(*columns))

    return run


_score_query("hazard_score", "Hazard_Score")
_score_query("exposure_score", "Exposure_Score")
_score_query("vulnerability_score", "Vulnerability_Score")
_score_query("preparedness_score", "Preparedness_Score", "Preparedness_Deficit_Score")
_score_query("risk_score", "Disaster_Risk_Score", "Equal_Weighted_Risk")


@query("risk_category", f"WITH {o.INDEXED} SELECT Record_ID, Risk_Category FROM indexed")
def risk_category_query(spark, folder):
    return v.indexed(spark, folder).select("Record_ID", "Risk_Category")


@query("risk_prep_gap", f"WITH {o.FEATURED} SELECT Record_ID, {r6('Risk_Preparedness_Gap')} Risk_Preparedness_Gap FROM featured")
def risk_prep_gap_query(spark, folder):
    return v.featured(spark, folder).select("Record_ID", *_r("Risk_Preparedness_Gap"))


@query("date_parts", """SELECT o_orderkey, strftime(o_orderdate,'%B') Month_Name,
  year(o_orderdate)||'Q'||quarter(o_orderdate) "Quarter", strftime(o_orderdate,'%Y%m%d')::INT DateKey FROM orders""")
def date_parts_query(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("Event_Date"))
    return feat.date_parts(orders).drop("Event_Date")


@query("season", """WITH t AS (SELECT o_orderkey, month(o_orderdate) "Month" FROM orders)
  SELECT o_orderkey, """ + o.SEASON + " Season FROM t")
def season_query(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", feat.season(F.month("o_orderdate")).alias("Season"))


_FLAGS = ["Coastal_Region_Flag", "Extreme_Rainfall_Flag", "Extreme_Temperature_Flag"]


@query("threshold_flags", f"WITH {o.FEATURED} SELECT Record_ID, {', '.join(_FLAGS)} FROM featured")
def threshold_flags_query(spark, folder):
    return feat.threshold_flags(v.panel(spark, folder)).select("Record_ID", *_FLAGS)


@query("median_split_flag", f"WITH {o.FEATURED} SELECT Record_ID, High_Population_Density_Flag FROM featured")
def median_split_query(spark, folder):
    out = feat.median_split_flag(v.panel(spark, folder), "Population_Density", "High_Population_Density_Flag")
    return out.select("Record_ID", "High_Population_Density_Flag")


@query("forecast_date", """SELECT o_orderkey, strftime(o_orderdate+INTERVAL 1 MONTH,'%Y%m%d')::INT Forecast_DateKey FROM orders""")
def forecast_date_query(spark, folder):
    return read_table(spark, folder, "orders").select(
        "o_orderkey", feat.forecast_key(F.col("o_orderdate").cast("date")).alias("Forecast_DateKey")
    )


@query("alert_level", f"""WITH {o.SCORED} SELECT event_id, CASE WHEN p<0.3::DOUBLE THEN 'Low' WHEN p<0.3::DOUBLE+0.15::DOUBLE THEN 'Moderate'
  WHEN p<0.3::DOUBLE+0.3::DOUBLE THEN 'High' ELSE 'Critical' END Alert_Level FROM scored""")
def alert_level_query(spark, folder):
    return v.scored(spark, folder).select("event_id", feat.alert_level(F.col("p"), 0.3).alias("Alert_Level"))


QUADRANTS = f"""{o.INDEXED},
prof AS (SELECT District, avg(Disaster_Risk_Score) risk, avg(Preparedness_Score) prep FROM indexed GROUP BY 1),
meds AS (SELECT median(risk) mr, median(prep) mp FROM prof),
quadrants AS (SELECT District, CASE WHEN risk>mr AND prep<mp THEN 'High Risk - Low Preparedness (Priority 1)'
  WHEN risk>mr THEN 'High Risk - High Preparedness (Priority 2)'
  WHEN prep<mp THEN 'Low Risk - Low Preparedness (Priority 3)'
  ELSE 'Low Risk - High Preparedness (Priority 4)' END Policy_Quadrant FROM prof, meds)"""


def unit_quadrants(spark, folder, indexed=None):
    indexed = v.indexed(spark, folder) if indexed is None else indexed
    means = durable(agg.unit_means(indexed, ["Disaster_Risk_Score", "Preparedness_Score"]))
    medians = {
        r["column"]: r["q"][0]
        for r in ordering.exact_quantiles(means, ["Disaster_Risk_Score", "Preparedness_Score"], [0.5]).collect()
    }
    quadrant = feat.policy_quadrant(
        F.col("Disaster_Risk_Score"), F.col("Preparedness_Score"),
        medians["Disaster_Risk_Score"], medians["Preparedness_Score"],
    )
    return means.select("District", quadrant.alias("Policy_Quadrant"))


@query("policy_quadrant", f"WITH {QUADRANTS} SELECT * FROM quadrants")
def policy_quadrant_query(spark, folder):
    return unit_quadrants(spark, folder)


@query("prediction_type", """SELECT o_orderkey, CASE WHEN year(o_orderdate)<=1998 THEN 'Training fitted'
  WHEN year(o_orderdate)=1999 THEN 'Calibration' WHEN year(o_orderdate)=2000 THEN 'Validation' ELSE 'Final test' END Prediction_Type,
  (year(o_orderdate)>1998)::INT Is_Out_Of_Sample, '3.1' Model_Version, '1998-12-01' Training_End_Date FROM orders""")
def prediction_type_query(spark, folder):
    year = F.year("o_orderdate")
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        feat.prediction_type(year, 1998, 1999, 2000).alias("Prediction_Type"),
        (year > 1998).cast("int").alias("Is_Out_Of_Sample"),
        F.lit("3.1").alias("Model_Version"),
        F.lit("1998-12-01").alias("Training_End_Date"),
    )


@query("expected_loss", f"WITH {o.SCORED} SELECT event_id, {r6('p*value')} expected_loss FROM scored JOIN events USING (event_id)")
def expected_loss_query(spark, folder):
    p = F.round(F.col("value") / (F.col("value") + F.lit(50.0)), 4)
    return read_table(spark, folder, "events").select("event_id", rounded(p * F.col("value")).alias("expected_loss"))


@query("log_target", f"""SELECT l_orderkey, l_linenumber, {r6('ln(1+l_extendedprice)')} log_y,
  {r6('exp(ln(1+l_extendedprice))-1', 4)} back FROM lineitem""")
def log_target_query(spark, folder):
    y = F.log1p("l_extendedprice")
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(y).alias("log_y"), rounded(F.expm1(y), 4).alias("back")
    )


@query("record_key", "SELECT o_orderkey, printf('REC_%d_%02d_%s', year(o_orderdate), month(o_orderdate), o_custkey::VARCHAR) Record_ID FROM orders")
def record_key_query(spark, folder):
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.format_string("REC_%d_%02d_%s", F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_custkey").cast("string")).alias("Record_ID"),
    )


def _hazard_sql() -> str:
    parts = []
    for i, (name, (b0, terms, gate)) in enumerate(feat.HAZARD_TERMS.items()):
        z = f"{b0}::DOUBLE" + "".join(f"+({w}::DOUBLE)*{c}" for c, w in terms.items())
        parts.append(f"SELECT Record_ID, '{name}' name, {i} pos, CASE WHEN {gate} THEN 1.0::DOUBLE/(1.0::DOUBLE+exp(-({z}))) ELSE 0.0::DOUBLE END p FROM panel")
    return " UNION ALL ".join(parts)


_HAZARDS = f"WITH {o.PANEL}, hz AS ({_hazard_sql()})"


@query("multi_hazard_score", f"{_HAZARDS} SELECT Record_ID, name, {r6('p')} p FROM hz")
def multi_hazard_query(spark, folder):
    df = feat.multi_hazard_score(v.panel(spark, folder))
    return df.select("Record_ID", F.explode("hazards").alias("h")).select(
        "Record_ID", "h.name", rounded(F.col("h.p")).alias("p")
    )


@query("dominant_hazard", f"""{_HAZARDS}, act AS (SELECT *, row_number() OVER (PARTITION BY Record_ID ORDER BY p DESC, pos) rn,
  count(*) OVER (PARTITION BY Record_ID) n FROM hz WHERE p>0.005),
  top AS (SELECT * FROM act WHERE rn=1)
  SELECT panel.Record_ID, coalesce(name,'No Disaster') Dominant_Type, {r6('coalesce(p,0)')} Dominant_Probability,
  (coalesce(n,0)>=2)::INT Compound_Flag,
  {r6('CASE WHEN name IS NULL THEN 0 ELSE least(10.0::DOUBLE,greatest(1.0::DOUBLE,p*12.0::DOUBLE)) END')} Dominant_Severity
  FROM panel LEFT JOIN top USING (Record_ID)""")
def dominant_hazard_query(spark, folder):
    df = feat.dominant_hazard(feat.multi_hazard_score(v.panel(spark, folder)))
    return df.select("Record_ID", "Dominant_Type", "Compound_Flag", *_r("Dominant_Probability", "Dominant_Severity"))


@query("anomaly_vs_baseline", f"""WITH {o.PANEL}, b AS (SELECT Record_ID, Monthly_Rainfall_mm x, Temperature_Celsius t,
  avg(Monthly_Rainfall_mm) OVER w mx, avg(Temperature_Celsius) OVER w mt FROM panel WINDOW w AS (PARTITION BY District, "Month"))
  SELECT Record_ID, {r6('(x-mx)/(0.3*mx+5.0)')} rain_anomaly, {r6('t-mt')} temp_anomaly FROM b""")
def anomaly_query(spark, folder):
    df = feat.anomaly_vs_baseline(v.panel(spark, folder), "Monthly_Rainfall_mm", "rain_anomaly")
    df = feat.anomaly_vs_baseline(df, "Temperature_Celsius", "temp_anomaly", additive=True)
    return df.select("Record_ID", *_r("rain_anomaly", "temp_anomaly"))


@query("preparedness_index", f"WITH {o.PANEL} SELECT Record_ID, {r6('Disaster_Preparedness_Index')} prep_index FROM panel")
def preparedness_index_query(spark, folder):
    return v.panel(spark, folder).select("Record_ID", rounded(idx.preparedness_index()).alias("prep_index"))


@query("round_half_even", """SELECT l_orderkey, l_linenumber, round_even(l_quantity/2, 0) AS half, round_even(l_quantity/4, 1) AS "quarter" FROM lineitem""")
def round_half_even_query(spark, folder):
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        half_even(F.col("l_quantity") / 2, 0).alias("half"), half_even(F.col("l_quantity") / 4, 1).alias("quarter"),
    )


@query("class_weights", f"""WITH {o.SCORED}, c AS (SELECT y, count(*) n FROM scored GROUP BY 1), t AS (SELECT sum(n) tot, sum(n*y) pos FROM c)
  SELECT y, n AS n_class, {r6('tot/(2.0*n)')} weight, {r6('(tot-pos)/greatest(pos,1)')} scale_pos_weight FROM c, t""")
def class_weights_query(spark, folder):
    return agg.class_weights(v.scored(spark, folder), "y").select("y", "n_class", *_r("weight", "scale_pos_weight"))


# --- joins ------------------------------------------------------------------


@query("join_typology", f"""WITH {QUADRANTS} SELECT Record_ID, -1 AS Cluster, 'Unknown' Cluster_Label,
  CASE WHEN Risk_Category IS NULL THEN 'x' ELSE coalesce(q.Policy_Quadrant,'Unknown') END Policy_Quadrant
  FROM indexed i LEFT JOIN (SELECT * FROM quadrants WHERE Policy_Quadrant LIKE 'High%') q USING (District)""")
def join_typology_query(spark, folder):
    indexed = v.indexed(spark, folder)
    quad = unit_quadrants(spark, folder, indexed).where(F.col("Policy_Quadrant").startswith("High"))
    typology = quad.select(
        "District", F.lit(None).cast("int").alias("Cluster"), F.lit(None).cast("string").alias("Cluster_Label"), "Policy_Quadrant"
    )
    joined = agg.join_typology(indexed, typology)
    return joined.select("Record_ID", "Cluster", "Cluster_Label", "Policy_Quadrant")


_HELD = o.uniform("'holdout'", "unit")


@query("group_membership", f"""WITH {o.SCORED}, held AS (SELECT DISTINCT unit FROM scored WHERE {_HELD}<0.2)
  SELECT event_id, unit, (unit IN (SELECT unit FROM held)) is_test FROM scored""")
def group_membership_query(spark, folder):
    rows = v.scored(spark, folder).select("event_id", "unit")
    held = rows.select("unit").distinct().where(uniform("holdout", F.col("unit")) < 0.2)
    test = rows.join(held, "unit", "left_semi").withColumn("is_test", F.lit(True))
    train = rows.join(held, "unit", "left_anti").withColumn("is_test", F.lit(False))
    return test.unionByName(train)


# --- aggregates -------------------------------------------------------------

_MEANS = [*COMPONENTS, "Disaster_Risk_Score"]


@query("unit_means", f"WITH {o.INDEXED} SELECT District, {', '.join(f'{r6(f'avg({c})')} {c}' for c in _MEANS)} FROM indexed GROUP BY 1")
def unit_means_query(spark, folder):
    return agg.unit_means(v.indexed(spark, folder), _MEANS).select("District", *_r(*_MEANS))


_PROFILE = {"Hazard_Score": "Hazard", "Exposure_Score": "Exposure", "Vulnerability_Score": "Vulnerability",
            "Preparedness_Score": "Preparedness", "Disaster_Risk_Score": "Risk_Score_Mean"}


@query("unit_profile", f"""WITH {o.INDEXED} SELECT District, {', '.join(f'{r6(f'avg({c})')} {n}' for c, n in _PROFILE.items())},
  sum(Disaster_Occurred)::BIGINT Total_Events, {r6('avg(Disaster_Occurred)')} Event_Rate FROM indexed GROUP BY 1""")
def unit_profile_query(spark, folder):
    out = agg.unit_profile(v.indexed(spark, folder), _PROFILE)
    return out.select("District", "Total_Events", *_r(*_PROFILE.values(), "Event_Rate"))


@query("events_per_year", f'WITH {o.PANEL} SELECT "Year", sum(Disaster_Occurred)::BIGINT n_events FROM panel GROUP BY 1')
def events_per_year_query(spark, folder):
    return agg.events_per(v.panel(spark, folder), ["Year"])


@query("type_distribution", f"WITH {o.PANEL} SELECT Disaster_Type, count(*) n_rows FROM panel GROUP BY 1")
def type_distribution_query(spark, folder):
    return agg.value_counts(v.panel(spark, folder), "Disaster_Type")


@query("compound_rates", f"""WITH {o.PANEL} SELECT 'overall' "level", 'all' label, sum(Compound_Event)::BIGINT n_compound, round(avg(Compound_Event),4) rate FROM panel
  UNION ALL SELECT 'type', Disaster_Type, sum(Compound_Event)::BIGINT, round(avg(Compound_Event),4) FROM panel GROUP BY 2 HAVING sum(Compound_Event)>0
  UNION ALL SELECT 'region', Region, sum(Compound_Event)::BIGINT, round(avg(Compound_Event),4) FROM panel GROUP BY 2""")
def compound_rates_query(spark, folder):
    return agg.compound_rates(v.panel(spark, folder))


MODAL = f"""{o.INDEXED}, mc AS (SELECT District, Region, Risk_Category, row_number() OVER (PARTITION BY District
  ORDER BY count(*) DESC, Risk_Category) rn FROM indexed GROUP BY 1,2,3),
modal AS (SELECT District, Region, Risk_Category FROM mc WHERE rn=1)"""


@query("modal_category", f"WITH {MODAL} SELECT * FROM modal")
def modal_category_query(spark, folder):
    return agg.modal_category(v.indexed(spark, folder), ["District", "Region"], "Risk_Category")


_LABELS = ["Low", "Moderate", "High", "Critical"]


@query("crosstab", f"WITH {o.INDEXED} SELECT Region, {', '.join(f'''count(*) FILTER (Risk_Category='{c}') AS {c}''' for c in _LABELS)} FROM indexed GROUP BY 1")
def crosstab_query(spark, folder):
    return agg.crosstab(v.indexed(spark, folder), "Region", "Risk_Category", _LABELS)


@query("crosstab_long", f"""WITH {o.PANEL} SELECT r.State, t.Disaster_Type, count(p.Record_ID) n FROM (SELECT DISTINCT State FROM panel) r
  CROSS JOIN (SELECT DISTINCT Disaster_Type FROM panel) t LEFT JOIN panel p ON p.State=r.State AND p.Disaster_Type=t.Disaster_Type GROUP BY 1,2""")
def crosstab_long_query(spark, folder):
    return agg.crosstab_long(v.panel(spark, folder), "State", "Disaster_Type")


@query("group_moments", f"""WITH {o.INDEXED}, m AS (SELECT District, Region, avg(Disaster_Risk_Score) x FROM indexed GROUP BY 1,2)
  SELECT Region, {r6('avg(x)')} "mean", {r6('stddev_samp(x)')} "std", count(*) n FROM m GROUP BY 1""")
def group_moments_query(spark, folder):
    means = agg.unit_means(v.indexed(spark, folder), ["Disaster_Risk_Score"], extra=["Region"])
    return agg.group_moments(means, "Region", "Disaster_Risk_Score").select("Region", "n", *_r("mean", "std"))


_CORR = ["Hazard_Score", "Exposure_Score", "Vulnerability_Score", "Preparedness_Score", "Disaster_Risk_Score"]


@query("corr_matrix", f"WITH {o.INDEXED} " + " UNION ALL ".join(
    f"SELECT '{a}' column_a, '{b}' column_b, {r6(f'corr({a},{b})') if a != b else '1.0::DOUBLE'} corr FROM indexed"
    for a in _CORR for b in _CORR).replace("1.0::DOUBLE corr FROM indexed", "1.0::DOUBLE corr"))
def corr_matrix_query(spark, folder):
    return agg.corr_matrix(v.indexed(spark, folder), _CORR).select("column_a", "column_b", *_r("corr"))


SPLIT = "CASE WHEN \"Year\"<=1998 THEN 'train' WHEN \"Year\"=1999 THEN 'calibration' WHEN \"Year\"=2000 THEN 'validation' ELSE 'test' END"


@query("split_summary", f"""WITH {o.FEATURED}, s AS (SELECT {SPLIT} split, count(Disaster_Next_Month) n_rows,
  avg(Disaster_Next_Month) pr, count(*)-count(Disaster_Next_Month) dropped_rows FROM featured GROUP BY 1)
  SELECT split, n_rows, {r6('100.0*n_rows/sum(n_rows) OVER ()')} percentage, {r6('pr')} positive_rate, dropped_rows FROM s""")
def split_summary_query(spark, folder):
    from ..operators.splits import split_label

    df = feat.lead_target(v.panel(spark, folder)).withColumn("split", split_label(F.col("Year"), 1998, 1999, 2000))
    return agg.split_summary(df, "split", "Disaster_Next_Month").select(
        "split", "n_rows", "dropped_rows", *_r("percentage", "positive_rate")
    )


@query("cluster_summary", f"""WITH {o.INDEXED}, u AS (SELECT District, Region, avg(Hazard_Score) Hazard, avg(Preparedness_Score) Preparedness FROM indexed GROUP BY 1,2)
  SELECT Region Cluster, count(*) n_units, round(avg(Hazard),3) Hazard, round(avg(Preparedness),3) Preparedness FROM u GROUP BY 1""")
def cluster_summary_query(spark, folder):
    means = agg.unit_means(v.indexed(spark, folder), ["Hazard_Score", "Preparedness_Score"], extra=["Region"])
    renamed = means.select(
        F.col("Region").alias("Cluster"), F.col("Hazard_Score").alias("Hazard"), F.col("Preparedness_Score").alias("Preparedness")
    )
    return agg.cluster_summary(renamed, "Cluster", ["Hazard", "Preparedness"])


_BOXED = ["Rainfall_Anomaly", "Wind_Speed_kmph", "River_Level_Metres"]


@query("five_number_by_flag", f"WITH {o.PANEL} " + " UNION ALL ".join(
    f"""SELECT Disaster_Occurred, '{c}' variable, {r6('min(x) FILTER (x>=a-1.5*(b-a))')} whisker_low, {r6('any_value(a)')} q25,
    {r6('any_value(m)')} median, {r6('any_value(b)')} q75, {r6('max(x) FILTER (x<=b+1.5*(b-a))')} whisker_high
    FROM (SELECT Disaster_Occurred, {c} x, quantile_cont({c},0.25) OVER w a, quantile_cont({c},0.5) OVER w m, quantile_cont({c},0.75) OVER w b
    FROM panel WINDOW w AS (PARTITION BY Disaster_Occurred)) GROUP BY 1""" for c in _BOXED))
def five_number_query(spark, folder):
    out = agg.five_number_by_flag(v.panel(spark, folder), _BOXED, "Disaster_Occurred")
    return out.select("Disaster_Occurred", "variable", *_r("whisker_low", "q25", "median", "q75", "whisker_high"))


@query("first_value_by_unit", """SELECT l_suppkey unit, min_by(l_quantity, l_shipdate::VARCHAR||lpad(l_orderkey::VARCHAR,12,'0')||lpad(l_linenumber::VARCHAR,4,'0')) l_quantity
  FROM lineitem GROUP BY 1""")
def first_value_query(spark, folder):
    rows = read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), "l_quantity"
    )
    return agg.first_value_by_unit(rows, ["l_quantity"], "unit", "at")


# --- windows ----------------------------------------------------------------


@query("lag_features", f"""WITH {o.FEATURED} SELECT Record_ID, Previous_Month_Disaster_Occurred,
  {r6('Previous_Month_Hazard_Severity')} Previous_Month_Hazard_Severity FROM featured""")
def lag_features_query(spark, folder):
    return feat.lag_features(v.panel(spark, folder)).select(
        "Record_ID", "Previous_Month_Disaster_Occurred", *_r("Previous_Month_Hazard_Severity")
    )


@query("rolling_12", f"WITH {o.FEATURED} SELECT Record_ID, Rolling_12_Month_Disaster_Count FROM featured")
def rolling_query(spark, folder):
    return feat.rolling_count(v.panel(spark, folder)).select("Record_ID", "Rolling_12_Month_Disaster_Count")


@query("lead_target", f"WITH {o.FEATURED} SELECT Record_ID, Disaster_Next_Month FROM featured")
def lead_target_query(spark, folder):
    return feat.lead_target(v.panel(spark, folder)).select("Record_ID", "Disaster_Next_Month")


@query("rank_average", """WITH t AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey) n FROM customer)
  SELECT c_custkey, n AS n_orders, rank() OVER (ORDER BY n DESC)+(count(*) OVER (PARTITION BY n)-1)/2.0::DOUBLE AS "rank" FROM t""")
def rank_average_query(spark, folder):
    customer, orders = read_table(spark, folder, "customer"), read_table(spark, folder, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    df = customer.select("c_custkey").join(counts, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    return ordering.average_rank(df, "n_orders")


@query("engineer_features", f"""WITH {o.FEATURED} SELECT Record_ID, Month_Name, "Quarter", Season, Coastal_Region_Flag, High_Population_Density_Flag,
  Rolling_12_Month_Disaster_Count, Disaster_Next_Month, {r6('Risk_Preparedness_Gap')} Risk_Preparedness_Gap FROM featured""")
def engineer_features_query(spark, folder):
    return v.featured(spark, folder).select(
        "Record_ID", "Month_Name", "Quarter", "Season", "Coastal_Region_Flag", "High_Population_Density_Flag",
        "Rolling_12_Month_Disaster_Count", "Disaster_Next_Month", *_r("Risk_Preparedness_Gap"),
    )


# --- sort, top-k, sets ------------------------------------------------------


@query("sort_panel", f'WITH {o.PANEL} SELECT Record_ID, "Year", "Month", District FROM panel')
def sort_panel_query(spark, folder):
    return pan.sort_panel(v.panel(spark, folder).select("Record_ID", "Year", "Month", "District"))


@query("top_k_units", f"""WITH {o.INDEXED} SELECT District, {r6('avg(Disaster_Risk_Score)')} Disaster_Risk_Score FROM indexed
  GROUP BY 1 ORDER BY avg(Disaster_Risk_Score) DESC, District LIMIT 10""")
def top_k_query(spark, folder):
    means = agg.unit_means(v.indexed(spark, folder), ["Disaster_Risk_Score"])
    return agg.top_k(means, 10, "Disaster_Risk_Score", "District").select("District", *_r("Disaster_Risk_Score"))


@query("distinct_rows", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events) WHERE rn=1""")
def distinct_rows_query(spark, folder):
    rows = read_table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return pan.distinct_rows(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


_TOP = """top_risk AS (SELECT District FROM indexed GROUP BY 1 ORDER BY avg(Disaster_Risk_Score) DESC, District LIMIT 10),
top_equal AS (SELECT District FROM indexed GROUP BY 1 ORDER BY avg(Equal_Weighted_Risk) DESC, District LIMIT 10)"""


@query("set_intersect", f"WITH {o.INDEXED}, {_TOP} SELECT District FROM top_risk INTERSECT SELECT District FROM top_equal")
def set_intersect_query(spark, folder):
    means = agg.unit_means(v.indexed(spark, folder), ["Disaster_Risk_Score", "Equal_Weighted_Risk"])
    tops = [agg.top_k(means, 10, c, "District").select("District") for c in ("Disaster_Risk_Score", "Equal_Weighted_Risk")]
    return tops[0].intersect(tops[1])


@query("row_sample", f"SELECT event_id FROM events ORDER BY {o.uniform('7', 'event_id')}, event_id LIMIT 200")
def row_sample_query(spark, folder):
    return row_sample(read_table(spark, folder, "events"), 200, "event_id", 7).select("event_id")


def row_sample(df, n: int, key: str, seed: int = 42):
    """n rows without replacement, ordered by a keyed uniform (top-k heaps)."""
    return df.orderBy(uniform(seed, F.col(key)), key).limit(n)
