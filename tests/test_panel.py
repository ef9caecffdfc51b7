import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelscope.operators import features as feat
from panelscope.operators import panel as pan
from panelscope.operators import profile as prof
from panelscope.operators.index import IndexParams, facility_rates, fit_index, minmax_scale, risk_category, score_index
from panelscope.sources.tables import read_panel, write_panel


def d(y, m):
    return dt.date(y, m, 1)


def test_rates(spark):
    df = spark.createDataFrame(
        [(100000, 5, 2, 3), (200000, 10, 4, 6), (50000, 2, 1, 0), (0, 1, 0, 0)],
        "Population bigint, Raw_Shelter_Count bigint, Raw_Hospital_Count bigint, Raw_Rescue_Team_Count bigint",
    )
    rows = facility_rates(df).collect()
    assert [r["Shelter_Rate_per_100k"] for r in rows] == [5.0, 5.0, 4.0, 100000.0]
    assert [r["Hospital_Rate_per_100k"] for r in rows][:3] == [2.0, 2.0, 2.0]
    assert rows[2]["Rescue_Team_Rate_per_100k"] == 0.0


def small_panel(spark):
    rows = [("D1", d(2020, m), f, s) for m, f, s in [(1, 1, 5.0), (2, 1, 7.0), (3, 0, 0.0), (4, 1, 4.0)]]
    rows += [("D2", d(2020, m), f, s) for m, f, s in [(1, 0, 0.0), (2, 1, 6.0)]]
    return spark.createDataFrame(rows, "District string, Event_Date date, Disaster_Occurred int, Hazard_Severity double")


def test_lag_and_lead(spark):
    out = feat.lead_target(feat.lag_features(small_panel(spark))).where("District = 'D1'").orderBy("Event_Date").collect()
    assert [r["Previous_Month_Disaster_Occurred"] for r in out] == [0, 1, 1, 0]
    assert [r["Previous_Month_Hazard_Severity"] for r in out] == [0.0, 5.0, 7.0, 0.0]
    assert [r["Disaster_Next_Month"] for r in out] == [1, 0, 1, None]


def test_rolling_needs_a_full_window(spark):
    rows = [("D1", d(2020 + i // 12, i % 12 + 1), 1) for i in range(15)]
    df = spark.createDataFrame(rows, "District string, Event_Date date, Disaster_Occurred int")
    out = feat.rolling_count(df).orderBy("Event_Date").collect()
    assert [r["Rolling_12_Month_Disaster_Count"] for r in out] == [0] * 12 + [12] * 3


def test_panel_complete_fills_and_finds_duplicates(spark):
    facts = spark.createDataFrame([(1, d(2020, 1), 4), (2, d(2020, 3), 7)], "u int, p date, n int")
    units = spark.createDataFrame([(1,), (2,), (3,)], "u int")
    out = pan.panel_complete(facts, units, "u", "p", {"n": 0})
    assert out.count() == 9 and out.agg(F.sum("n")).first()[0] == 11
    assert pan.duplicate_keys(facts.union(facts), ["u", "p"]).count() == 2
    summed = pan.panel_complete_sums(facts.union(facts), units, "u", "p", {"n": F.col("n")})
    assert summed.count() == 9 and summed.agg(F.sum("n")).first()[0] == 22
    assert pan.panel_complete_sums(facts.limit(0), units, "u", "p", {"n": F.col("n")}).count() == 0


def test_clean_panel(spark):
    df = spark.createDataFrame(
        [("a", "2020-01-01", -5), ("a", "2020-01-01", -5), ("b", "2020-02-01", None)],
        "id string, Event_Date string, Number_of_Deaths bigint",
    )
    rows = {r["id"]: r for r in pan.clean_panel(df).collect()}
    assert len(rows) == 2 and rows["a"]["Number_of_Deaths"] == 0 and rows["b"]["Number_of_Deaths"] is None
    assert rows["a"]["Event_Date"] == d(2020, 1)


def test_quality_rules_count_violations_and_nulls(spark, featured):
    broken = featured.withColumn("Soil_Moisture", F.when(F.col("Month") == 1, 2.0).otherwise(F.col("Soil_Moisture")))
    broken = broken.withColumn("Latitude", F.when(F.col("Month") != 2, F.col("Latitude")))
    found = {r["rule"]: r["violations"] for r in prof.quality_rules(broken).collect()}
    assert found["soil_moisture_bounds"] == featured.where("Month = 1").count()
    assert found["latitude_bounds"] == featured.where("Month = 2").count()
    assert found["non_negative_Number_of_Deaths"] == 0


def test_absent_columns_are_reported(spark):
    df = spark.createDataFrame([(1.0,)], "Wind_Speed_kmph double")
    with pytest.raises(ValueError, match="Annual_Rainfall_mm"):
        prof.iqr_outliers(df, ["Annual_Rainfall_mm", "Wind_Speed_kmph"])


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "y"), (10.0, None), (None, "x")], "a double, c string")
    out = prof.impute_mode(prof.impute_median(df, ["a"]), ["c"]).collect()
    assert sorted(r["a"] for r in out) == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert [r["c"] for r in out].count("x") == 3  # tie between x and y: smallest wins


def test_minmax_and_categories(spark, featured):
    assert minmax_scale("x", 2.0, 2.0) == "CAST(x AS DOUBLE) * 0D"
    first = featured.where("Year <= 1997")
    params = fit_index(first)
    assert isinstance(params, IndexParams) and len(params.thresholds) == 3
    later = score_index(featured.where("Year > 1997"), params)
    labels = {r[0] for r in later.select("Risk_Category").distinct().collect()}
    assert labels <= {"Low", "Moderate", "High", "Critical"}
    again = fit_index(first)
    assert again == params  # scoring does not change fitted parameters
    edge = spark.createDataFrame([(1.0,), (1.5,), (3.0,), (9.0,)], "s double")
    got = [r[0] for r in edge.select(risk_category(F.col("s"), (1.0, 2.0, 3.0))).collect()]
    assert got == ["Low", "Moderate", "High", "Critical"]


def test_csv_round_trip_keeps_labels_and_types(spark, featured, tmp_path):
    path = str(tmp_path / "panel")
    from panelscope.plans import views

    panel = views.panel(spark, "/root/testdata/sf0.001")
    write_panel(panel, path, "csv")
    back = read_panel(spark, path, "csv")
    assert back.where("Disaster_Type IS NULL").count() == 0
    assert back.where("Disaster_Type = 'No Disaster'").count() == panel.where("Disaster_Occurred = 0").count()
    assert dict(back.dtypes)["Event_Date"] == "date" and dict(back.dtypes)["Latitude"] == "double"
    assert back.select("District", "Year", "Month").distinct().count() == panel.count()
    with pytest.raises(ValueError, match="No_Such"):
        read_panel(spark, path, "csv", required=["No_Such"])


def test_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "nan")
    spark.createDataFrame([("r", "D", 1, 1, float("nan"))], "Record_ID string, District string, Year int, Month int, x double").write.parquet(path)
    assert read_panel(spark, path).first()["x"] is None


def test_half_even_and_season(spark):
    from panelscope.functions.numeric import half_even

    df = spark.createDataFrame([(0.5, 12), (1.5, 4), (2.5, 9), (-0.2, 10)], "x double, m int")
    rows = df.select(half_even(F.col("x"), 0), feat.season(F.col("m"))).collect()
    assert [r[0] for r in rows] == [0.0, 2.0, 2.0, 0.0]
    assert [r[1] for r in rows] == ["Winter", "Spring", "Monsoon", "Autumn"]


def test_prevalence_and_balance(spark, featured):
    row = pan.panel_balance(featured, "District", "Event_Date", "Disaster_Occurred").first()
    assert row["is_balanced"] and 0.10 <= row["prevalence"] <= 0.20
