"""Shared SQL fragments of the oracles (plain SQL over the supplied tables)."""

from __future__ import annotations


def _u(*parts: str) -> str:
    key = "||':'||".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x'||substr(md5({key}),1,8))::BIGINT::DOUBLE/4294967296.0::DOUBLE)"


uniform = _u

UNITS = f"""units AS (
  SELECT s_suppkey unit, printf('D_%06d', s_suppkey) District, n_name State, r_name Region,
         round(-60.0::DOUBLE + 120.0::DOUBLE*{_u("'lat'", "s_suppkey")}, 4) Latitude,
         round(-180.0::DOUBLE + 360.0::DOUBLE*{_u("'lon'", "s_suppkey")}, 4) Longitude,
         s_acctbal acct, s_nationkey::DOUBLE place
  FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"""

CELLS = """cells AS (
  SELECT l_suppkey unit, date_trunc('month', l_shipdate)::DATE Event_Date, count(*)::BIGINT n_lines,
         count(*) FILTER (l_returnflag='R')::BIGINT n_returned, round(sum(l_quantity),2) qty,
         round(sum(l_extendedprice),2) price, round(sum(l_discount),2) discount, round(sum(l_tax),2) tax,
         round(sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END),2) returned_qty,
         round(sum(CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE 0 END),2) returned_price
  FROM lineitem GROUP BY 1,2),
months AS (SELECT unnest(generate_series(min(Event_Date), max(Event_Date), INTERVAL 1 MONTH))::DATE Event_Date FROM cells),
monthly AS (
  SELECT u.unit, m.Event_Date, coalesce(n_lines,0)::BIGINT n_lines, coalesce(n_returned,0)::BIGINT n_returned,
         coalesce(qty,0.0)::DOUBLE qty, coalesce(price,0.0)::DOUBLE price, coalesce(discount,0.0)::DOUBLE discount,
         coalesce(tax,0.0)::DOUBLE tax, coalesce(returned_qty,0.0)::DOUBLE returned_qty,
         coalesce(returned_price,0.0)::DOUBLE returned_price, coalesce(n_lines,0)::DOUBLE nl
  FROM units u CROSS JOIN months m LEFT JOIN cells c ON c.unit=u.unit AND c.Event_Date=m.Event_Date)"""

PANEL = f"""{UNITS}, {CELLS},
panel0 AS (
  SELECT *, (returned_qty>=110) f,
    CASE WHEN returned_qty>=110 THEN least(10.0::DOUBLE, greatest(1.0::DOUBLE, returned_qty/20.0::DOUBLE)) ELSE 0.0::DOUBLE END sev,
    (100000+floor(acct*10.0::DOUBLE))::BIGINT pop, 500.0::DOUBLE+20.0::DOUBLE*place area,
    100.0::DOUBLE-50.0::DOUBLE*nl/(nl+7.0::DOUBLE) health, 20.0::DOUBLE+80.0::DOUBLE/(1.0::DOUBLE+nl) resp,
    (acct>5000)::BIGINT ews, (place::BIGINT%2)::BIGINT evac, year(Event_Date)::BIGINT y_, month(Event_Date)::BIGINT m_
  FROM monthly JOIN units USING (unit)),
panel AS (
  SELECT printf('REC_%d_%02d_%s', y_, m_, District) Record_ID, District, State, Region, Latitude, Longitude,
    y_ AS "Year", m_ AS "Month", Event_Date,
    CASE WHEN NOT f THEN 'No Disaster' WHEN qty::BIGINT%4=0 THEN 'Flood' WHEN qty::BIGINT%4=1 THEN 'Cyclone'
         WHEN qty::BIGINT%4=2 THEN 'Drought' ELSE 'Earthquake' END Disaster_Type,
    f::BIGINT Disaster_Occurred, floor(sev*2.0::DOUBLE)::BIGINT Disaster_Duration_Days,
    sev*1.1::DOUBLE Disaster_Magnitude, sev Hazard_Severity, qty Monthly_Rainfall_mm,
    (returned_qty>=150)::BIGINT Compound_Event, (qty-185.0::DOUBLE)/75.0::DOUBLE Rainfall_Anomaly,
    15.0::DOUBLE+discount*30.0::DOUBLE Temperature_Celsius, (discount-0.36::DOUBLE)/0.15::DOUBLE Temperature_Anomaly,
    nl*5.0::DOUBLE Wind_Speed_kmph, 2.0::DOUBLE+qty/100.0::DOUBLE River_Level_Metres,
    qty/(qty+185.0::DOUBLE) Soil_Moisture, 100.0::DOUBLE/(1.0::DOUBLE+nl) Drought_Index,
    nl/(nl+7.0::DOUBLE) Vegetation_Index, 100.0::DOUBLE+40.0::DOUBLE*place Elevation_Metres,
    1.2::DOUBLE*place Slope_Degrees, 20.0::DOUBLE*place Distance_From_Coast_km,
    5.0::DOUBLE+place/2.0::DOUBLE Distance_From_River_km, tax*10.0::DOUBLE Seismic_Activity_Index,
    pop Population, area Area_SqKm, pop::DOUBLE/area Population_Density,
    (acct+1000.0::DOUBLE)/11000.0::DOUBLE Urbanisation_Rate,
    100.0::DOUBLE*price/(price+300000.0::DOUBLE) Infrastructure_Density,
    returned_qty/(qty+1.0::DOUBLE) Poverty_Rate,
    20.0::DOUBLE*discount/(discount+0.36::DOUBLE) Elderly_Population_Percentage,
    30.0::DOUBLE*tax/(tax+0.3::DOUBLE) Child_Population_Percentage,
    100.0::DOUBLE*price/(price+200000.0::DOUBLE) Housing_Quality_Index, health Healthcare_Access_Index,
    40.0::DOUBLE+2.0::DOUBLE*place Road_Access_Index, 90.0::DOUBLE-place Communication_Access_Index,
    n_lines Raw_Shelter_Count, n_lines-n_returned Raw_Hospital_Count, n_returned Raw_Rescue_Team_Count,
    ews Early_Warning_System, evac Evacuation_Plan_Available, resp Emergency_Response_Time_Minutes,
    least(100.0::DOUBLE, greatest(10.0::DOUBLE, ews::DOUBLE*25.0::DOUBLE+evac::DOUBLE*20.0::DOUBLE
      +(100.0::DOUBLE-resp)*0.25::DOUBLE+health*0.30::DOUBLE)) Disaster_Preparedness_Index,
    CASE WHEN f THEN n_returned ELSE 0 END::BIGINT Number_of_Deaths,
    CASE WHEN f THEN n_returned*3 ELSE 0 END::BIGINT Number_of_Injuries,
    CASE WHEN f THEN returned_qty*10 ELSE 0 END::BIGINT Number_of_People_Affected,
    CASE WHEN f THEN returned_qty ELSE 0 END::BIGINT Displacement_Count,
    CASE WHEN f THEN n_lines ELSE 0 END::BIGINT Houses_Damaged,
    CASE WHEN f THEN least(100.0::DOUBLE, returned_qty/3.0::DOUBLE) ELSE 0.0::DOUBLE END Infrastructure_Damage_Score,
    CASE WHEN f THEN least(100.0::DOUBLE, returned_qty/5.0::DOUBLE) ELSE 0.0::DOUBLE END Crop_Loss_Percentage,
    CASE WHEN f THEN returned_price/10000.0::DOUBLE ELSE 0.0::DOUBLE END Economic_Loss_Million
  FROM panel0)"""

_INPUTS = {
    "rain_dev": "abs(Rainfall_Anomaly)", "temp_dev": "abs(Temperature_Anomaly)", "wind": "Wind_Speed_kmph",
    "seismic": "Seismic_Activity_Index", "pop_density": "Population_Density", "urban_rate": "Urbanisation_Rate",
    "infra_density": "Infrastructure_Density", "poverty": "Poverty_Rate",
    "elderly": "Elderly_Population_Percentage", "child": "Child_Population_Percentage",
    "rev_housing": "(100.0::DOUBLE-Housing_Quality_Index)",
    "rev_healthcare": "(100.0::DOUBLE-Healthcare_Access_Index)",
    "shelter_rate": "Shelter_Rate_per_100k", "hospital_rate": "Hospital_Rate_per_100k",
    "rescue_rate": "Rescue_Team_Rate_per_100k",
}
INPUTS = _INPUTS

RATED = PANEL + """,
rated AS (SELECT *, Raw_Shelter_Count::DOUBLE/greatest(Population,1)::DOUBLE*100000.0::DOUBLE Shelter_Rate_per_100k,
  Raw_Hospital_Count::DOUBLE/greatest(Population,1)::DOUBLE*100000.0::DOUBLE Hospital_Rate_per_100k,
  Raw_Rescue_Team_Count::DOUBLE/greatest(Population,1)::DOUBLE*100000.0::DOUBLE Rescue_Team_Rate_per_100k FROM panel)"""

_SCALED = ", ".join(
    f"CASE WHEN hi_{n}-lo_{n}=0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE*({e}-lo_{n})/(hi_{n}-lo_{n}) END s_{n}"
    for n, e in _INPUTS.items()
)
SCALED = RATED + f""",
ranges AS (SELECT {", ".join(f"min({e}) lo_{n}, max({e}) hi_{n}" for n, e in _INPUTS.items())} FROM rated),
scaled AS (SELECT rated.*, {_SCALED} FROM rated, ranges)"""

INDEXED = SCALED + """,
comp AS (SELECT * EXCLUDE (s_rain_dev,s_temp_dev,s_wind,s_seismic,s_pop_density,s_urban_rate,s_infra_density,s_poverty,
    s_elderly,s_child,s_rev_housing,s_rev_healthcare,s_shelter_rate,s_hospital_rate,s_rescue_rate),
  (s_rain_dev+s_temp_dev+s_wind+s_seismic)/4.0::DOUBLE Hazard_Score,
  (s_pop_density+s_urban_rate+s_infra_density)/3.0::DOUBLE Exposure_Score,
  (s_poverty+s_elderly+s_child+s_rev_housing+s_rev_healthcare)/5.0::DOUBLE Vulnerability_Score,
  (s_shelter_rate+s_hospital_rate+s_rescue_rate+Early_Warning_System::DOUBLE*100.0::DOUBLE
   +Evacuation_Plan_Available::DOUBLE*100.0::DOUBLE)/5.0::DOUBLE Preparedness_Score FROM scaled),
risk AS (SELECT *, 100.0::DOUBLE-Preparedness_Score Preparedness_Deficit_Score FROM comp),
risk2 AS (SELECT *,
  0.3::DOUBLE*Hazard_Score+0.25::DOUBLE*Exposure_Score+0.25::DOUBLE*Vulnerability_Score+0.2::DOUBLE*Preparedness_Deficit_Score Disaster_Risk_Score,
  0.25::DOUBLE*Hazard_Score+0.25::DOUBLE*Exposure_Score+0.25::DOUBLE*Vulnerability_Score+0.25::DOUBLE*Preparedness_Deficit_Score Equal_Weighted_Risk
  FROM risk),
cuts AS (SELECT quantile_cont(Disaster_Risk_Score,0.25) q25, quantile_cont(Disaster_Risk_Score,0.5) q50,
  quantile_cont(Disaster_Risk_Score,0.75) q75 FROM risk2),
indexed AS (SELECT risk2.*, CASE WHEN Disaster_Risk_Score<=q25 THEN 'Low' WHEN Disaster_Risk_Score<=q50 THEN 'Moderate'
  WHEN Disaster_Risk_Score<=q75 THEN 'High' ELSE 'Critical' END Risk_Category FROM risk2, cuts)"""

SEASON = """CASE WHEN "Month" IN (12,1,2) THEN 'Winter' WHEN "Month" IN (3,4,5) THEN 'Spring'
  WHEN "Month" IN (6,7,8,9) THEN 'Monsoon' ELSE 'Autumn' END"""

FEATURED = INDEXED + f""",
featured AS (SELECT indexed.*, strftime(Event_Date,'%B') Month_Name, year(Event_Date)||'Q'||quarter(Event_Date) "Quarter",
  {SEASON} Season, (Distance_From_Coast_km<100)::INT Coastal_Region_Flag, (Rainfall_Anomaly>1.5)::INT Extreme_Rainfall_Flag,
  (Temperature_Anomaly>1.5)::INT Extreme_Temperature_Flag,
  (Population_Density>(SELECT median(Population_Density) FROM indexed))::INT High_Population_Density_Flag,
  Disaster_Risk_Score-Preparedness_Score Risk_Preparedness_Gap,
  coalesce(lag(Disaster_Occurred) OVER w,0)::INT Previous_Month_Disaster_Occurred,
  coalesce(lag(Hazard_Severity) OVER w,0.0)::DOUBLE Previous_Month_Hazard_Severity,
  CASE WHEN count(*) OVER w12=12 THEN sum(Disaster_Occurred) OVER w12 ELSE 0 END::INT Rolling_12_Month_Disaster_Count,
  lead(Disaster_Occurred) OVER w::INT Disaster_Next_Month
  FROM indexed WINDOW w AS (PARTITION BY District ORDER BY Event_Date),
  w12 AS (PARTITION BY District ORDER BY Event_Date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""

SCORED = """scored AS (SELECT event_id, user_id unit, ts, (event_type='error')::INT y,
  round(value/(value+50.0::DOUBLE),4) p, round(value/(value+200.0::DOUBLE),4) p_low,
  round(1.0::DOUBLE/(1.0::DOUBLE+exp(-value/100.0::DOUBLE)),4) p_logit FROM events)"""

LOSSES = PANEL + """,
losses AS (SELECT Record_ID, District unit, Region, "Year", "Month", Economic_Loss_Million y,
  3.0::DOUBLE*Hazard_Severity+2.0::DOUBLE y_hat FROM panel WHERE Disaster_Occurred=1)"""

LINE_LOSSES = """line_losses AS (SELECT l_orderkey::VARCHAR||'-'||l_linenumber::VARCHAR id, l_suppkey unit,
  l_extendedprice y, l_quantity*1500.0::DOUBLE y_hat FROM lineitem)"""
