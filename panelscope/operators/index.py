"""Composite risk index: rates, min-max scaling, component scores, categories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..schema import EQUAL_WEIGHTS, EXPERT_WEIGHTS
from ..sources.durable import known_rows, with_rows
from .ordering import quantile_values

# Scaled inputs of each component score.
HAZARD_INPUTS = ["rain_dev", "temp_dev", "wind", "seismic"]
EXPOSURE_INPUTS = ["pop_density", "urban_rate", "infra_density"]
VULNERABILITY_INPUTS = ["poverty", "elderly", "child", "rev_housing", "rev_healthcare"]
SCORES = [
    "Hazard_Score", "Exposure_Score", "Vulnerability_Score", "Preparedness_Score", "Preparedness_Deficit_Score",
]
PREPAREDNESS_INPUTS = ["shelter_rate", "hospital_rate", "rescue_rate"]


def rate_per_100k(count: Column, population: Column) -> Column:
    """Count per 100,000 people; population below 1 counts as 1."""
    return count.cast("double") / clip(population, low=1).cast("double") * F.lit(100000.0)


def facility_rates(df: DataFrame) -> DataFrame:
    population = F.col("Population")
    return df.withColumns(
        {
            "Shelter_Rate_per_100k": rate_per_100k(F.col("Raw_Shelter_Count"), population),
            "Hospital_Rate_per_100k": rate_per_100k(F.col("Raw_Hospital_Count"), population),
            "Rescue_Team_Rate_per_100k": rate_per_100k(F.col("Raw_Rescue_Team_Count"), population),
        }
    )


# Unscaled inputs of the index over the domain columns.
INDEX_INPUTS: dict[str, str] = {
    "rain_dev": "abs(Rainfall_Anomaly)",
    "temp_dev": "abs(Temperature_Anomaly)",
    "wind": "Wind_Speed_kmph",
    "seismic": "Seismic_Activity_Index",
    "pop_density": "Population_Density",
    "urban_rate": "Urbanisation_Rate",
    "infra_density": "Infrastructure_Density",
    "poverty": "Poverty_Rate",
    "elderly": "Elderly_Population_Percentage",
    "child": "Child_Population_Percentage",
    "rev_housing": "100D - Housing_Quality_Index",
    "rev_healthcare": "100D - Healthcare_Access_Index",
    "shelter_rate": "Shelter_Rate_per_100k",
    "hospital_rate": "Hospital_Rate_per_100k",
    "rescue_rate": "Rescue_Team_Rate_per_100k",
}


@dataclass(frozen=True)
class IndexParams:
    """Fitted parameters; immutable, so a transform cannot change them."""

    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    thresholds: tuple[float, float, float] | None = None


def minmax_fit(df: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """One row (input, min, max) per input expression, from one aggregation."""
    wide = df.agg(
        *[F.expr(f"struct('{n}' AS input, CAST(min({e}) AS DOUBLE) AS min, CAST(max({e}) AS DOUBLE) AS max) AS {n}")
          for n, e in inputs.items()]
    )
    return wide.select(F.explode(F.array(*inputs)).alias("r")).select("r.*")


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def minmax_scale(expression: str, low: float | None, high: float | None) -> str:
    """100 (x - low) / (high - low); 0 when the range is 0; not clipped."""
    if low is None or high is None:
        return "CAST(NULL AS DOUBLE)"
    if high - low == 0:
        return f"CAST({expression} AS DOUBLE) * 0D"
    return f"(100D * (({expression}) - ({_number(low)})) / (({_number(high)}) - ({_number(low)})))"


def component_scores(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Equal-mean component scores of the scaled inputs."""
    scaled = {n: minmax_scale(e, *ranges[n]) for n, e in INDEX_INPUTS.items()}

    def mean_of(names, *extra):
        terms = [scaled[n] for n in names] + list(extra)
        return f"({' + '.join(terms)}) / {_number(len(terms))}"

    binary = ["Early_Warning_System * 100D", "Evacuation_Plan_Available * 100D"]
    scored = df.drop(*SCORES).selectExpr(
        "*",
        f"{mean_of(HAZARD_INPUTS)} AS Hazard_Score",
        f"{mean_of(EXPOSURE_INPUTS)} AS Exposure_Score",
        f"{mean_of(VULNERABILITY_INPUTS)} AS Vulnerability_Score",
        f"{mean_of(PREPAREDNESS_INPUTS, *binary)} AS Preparedness_Score",
    )
    return scored.selectExpr("*", "100D - Preparedness_Score AS Preparedness_Deficit_Score")


def weighted_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of component columns."""
    total = None
    for name, weight in (weights or EXPERT_WEIGHTS).items():
        term = F.lit(float(weight)) * F.col(name)
        total = term if total is None else total + term
    return total


def risk_category(score: Column, thresholds: tuple[float, float, float]) -> Column:
    """Low up to the first threshold, then Moderate, High, Critical."""
    q25, q50, q75 = thresholds
    return (
        F.when(score <= q25, "Low").when(score <= q50, "Moderate").when(score <= q75, "High")
        .otherwise("Critical")
    )


def fit_index(df: DataFrame) -> IndexParams:
    """Min-max ranges and risk-quartile thresholds of a rated panel."""
    ranges = {r["input"]: (r["min"], r["max"]) for r in minmax_fit(df, INDEX_INPUTS).collect()}
    scored = component_scores(df, ranges).select(weighted_score().alias("risk"))
    q = quantile_values(scored, "risk", [0.25, 0.50, 0.75])
    return IndexParams(ranges, tuple(q))


def score_index(df: DataFrame, params: IndexParams) -> DataFrame:
    """Component scores, risk scores and categories with fitted parameters."""
    scored = component_scores(df, params.ranges).withColumns(
        {"Disaster_Risk_Score": weighted_score(), "Equal_Weighted_Risk": weighted_score(EQUAL_WEIGHTS)}
    )
    out = scored.withColumn("Risk_Category", risk_category(F.col("Disaster_Risk_Score"), params.thresholds))
    return with_rows(out, known_rows(df))


def preparedness_index() -> Column:
    """25 early warning + 20 evacuation + response and health terms, 10..100."""
    raw = (
        F.col("Early_Warning_System").cast("double") * F.lit(25.0)
        + F.col("Evacuation_Plan_Available").cast("double") * F.lit(20.0)
        + (F.lit(100.0) - F.col("Emergency_Response_Time_Minutes")) * F.lit(0.25)
        + F.col("Healthcare_Access_Index") * F.lit(0.30)
    )
    return clip(raw, F.lit(10.0), F.lit(100.0))


