"""Registered queries: model fits, calibration, scoring, clustering."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import clusters, metrics, models, selection
from ..operators.aggregates import unit_means
from ..operators.splits import split_4way, split_regression
from ..schema import CATEGORICAL_PREDICTORS, NUMERIC_PREDICTORS, PREDICTORS, RECORD_KEYS
from ..sources.durable import durable, shared_folder
from ..sources.model_store import load_model, save_model
from . import oracles as o
from . import views as v
from .panel_queries import _r, r6
from .registry import query
from .star_queries import build_star

# Model size where a query fits many forests; the operators default to full size. Times of full fits: README.
FOREST = {"numTrees": 20, "maxDepth": 5}
BOOST = {"maxIter": 10}
YEARS = {"train_end": 1998, "cal_end": 1999, "val_end": 2000}


# What fits, splits and scores of this module read of the featured panel.
MODEL_COLUMNS = [*RECORD_KEYS, "Event_Date", "Disaster_Occurred", "Economic_Loss_Million", models.TARGET, *PREDICTORS]


def _panel(spark, folder):
    return durable(v.featured(spark, folder).select(*MODEL_COLUMNS))


def _parts(spark, folder):
    return split_4way(_panel(spark, folder), **YEARS)


@query("feature_pipeline")
def feature_pipeline_query(spark, folder):
    train, _, _, test = _parts(spark, folder)
    model = Pipeline(stages=models.feature_pipeline(train)).fit(train)
    x = vector_to_array("features")
    return model.transform(test).select(
        "Record_ID", F.size(x).alias("n_slots"), rounded(F.aggregate(x, F.lit(0.0), lambda a, b: a + b)).alias("slot_sum")
    )


def _classifier_query(name: str, kind: str, **params):
    @query(name)
    def run(spark, folder):
        train, _, _, test = _parts(spark, folder)
        model = models.fit_classifier(train, kind, **params)
        return models.score(model, test).select("Record_ID", models.TARGET, rounded(F.col("p")).alias("p"))

    return run


_classifier_query("fit_logistic", "logistic_regression")
_classifier_query("fit_random_forest", "random_forest", **FOREST)
_classifier_query("fit_gbt", "gradient_boosting")
_classifier_query("fit_boosted_preset", "xgboost")


@query("fit_ridge", f"""WITH {o.PANEL}, d AS (SELECT Hazard_Severity x, ln(1+Economic_Loss_Million) y FROM panel WHERE Disaster_Occurred=1),
  s AS (SELECT regr_sxy(y,x) sxy, regr_sxx(y,x) sxx, avg(x) mx, avg(y) my FROM d)
  SELECT {r6('sxy/(sxx+1.0)')} coefficient, {r6('my-sxy/(sxx+1.0)*mx')} intercept FROM s""")
def fit_ridge_query(spark, folder):
    events = v.panel(spark, folder).where("Disaster_Occurred = 1").select(
        "Hazard_Severity", F.log1p("Economic_Loss_Million").alias("label")
    )
    rows = durable(events)
    data = VectorAssembler(inputCols=["Hazard_Severity"], outputCol="features").transform(rows)
    model = models.ridge("label", models._ridge_penalty(rows, "label", 1.0)).fit(data)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "coefficient double, intercept double").select(
        *_r("coefficient", "intercept")
    )


def _loss_query(name: str, kind: str, **params):
    @query(name)
    def run(spark, folder):
        events = _panel(spark, folder).where("Disaster_Occurred = 1")
        train, _, test = split_regression(events, train_end=1998, val_end=2000)
        model = models.fit_regressor(train, "Economic_Loss_Million", kind, **params)
        scored = models.predict_loss(model, test, kind)
        return scored.select("Record_ID", "Economic_Loss_Million", rounded(F.col("y_hat")).alias("y_hat"))

    return run


_loss_query("fit_ridge_full", "ridge")
_loss_query("fit_rf_regressor", "random_forest", **FOREST)
_loss_query("fit_gbt_regressor", "gradient_boosting")
_loss_query("fit_gamma_glm", "gamma")
_loss_query("fit_tweedie_glm", "tweedie")


@query("tune_time_series")
def tune_query(spark, folder):
    train, _, _, _ = _parts(spark, folder)
    grid = {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2, 5]}
    return models.tune_time_series(train, "random_forest", n_draws=3, n_folds=3, grid=grid)


def _halves(spark, folder):
    scored = v.scored(spark, folder).select("event_id", "ts", F.col("y"), "p")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return scored.where(early), scored.where(~early)


@query("calibrate_platt")
def platt_query(spark, folder):
    calibration, validation = _halves(spark, folder)
    model = models.calibrate_platt(calibration, "y")
    return models.apply_calibration(validation.select("event_id", "y", "p"), model)


@query("calibrate_isotonic")
def isotonic_query(spark, folder):
    calibration, validation = _halves(spark, folder)
    model = models.calibrate_isotonic(calibration, "y")
    return models.apply_calibration(validation.select("event_id", "y", "p"), model)


def _package(spark, folder):
    train, cal, val, test = _parts(spark, folder)
    base = models.fit_classifier(train, "random_forest", **FOREST)
    pipeline, method, _, hist = models.calibrate_with_scores(base, cal, val)
    threshold = metrics.optimal_threshold(hist).first()["threshold"]
    return models.ModelPackage(pipeline, threshold, tuple(PREDICTORS), method), test


# --- chosen models: comparison, star -----------------------------------------

CANDIDATES = {"logistic_regression": {}, "random_forest": FOREST, "xgboost": BOOST}
LOSSES = {"ridge": {}, "random_forest": FOREST, "gradient_boosting": BOOST, "gamma": {}, "tweedie": {}}


def _event_models(panel, kinds):
    rows = selection.with_roles(panel, **YEARS)
    return rows, {k: selection.EventClassifier(kind=k, settings=json.dumps(CANDIDATES[k])).fit(rows) for k in kinds}


@query("fitted_model_comparison")
def fitted_comparison_query(spark, folder):
    """Fitted and calibrated classifiers on validation rows at 0.50, at their own and at the winner's threshold."""
    rows, fitted = _event_models(_panel(spark, folder), CANDIDATES)
    out = selection.compare_classifiers(fitted, rows.where("Role = 'validation'"))
    names = ["roc_auc", "pr_auc", "recall", "precision", "f1_score", "brier_score"]
    return out.select("threshold_kind", "model", "is_winner", *_r("threshold", *names))


def _losses(panel):
    train, _, test = split_regression(panel.where("Disaster_Occurred = 1"), train_end=1998, val_end=2000)
    return selection.compare_regressors(train, test, "Economic_Loss_Million", LOSSES)


@query("fitted_regressor_comparison")
def regressor_comparison_query(spark, folder):
    """Fitted loss regressors on test events, the winner by R2."""
    table, _ = _losses(_panel(spark, folder))
    return table.select("model", "is_winner", "n", *_r("mae", "rmse", "r_squared"))


@query("fact_predictions_fitted")
def fitted_facts_query(spark, folder):
    """The prediction fact of the star, scored by the fitted event and loss models."""

    def score(featured):
        _, fitted = _event_models(featured, ["random_forest"])
        table, losses = _losses(featured)
        best = table.where("is_winner").first()["model"]
        model = fitted["random_forest"]
        return selection.score_for_star(featured, model, losses[best], best), model.threshold

    facts = build_star(spark, folder, score).predictions
    return facts.withColumns({c: rounded(F.col(c)) for c in ("Predicted_Disaster_Probability", "Expected_Economic_Risk_Million")})


@query("score_batch")
def score_batch_query(spark, folder):
    package, test = _package(spark, folder)
    return models.score_batch(test, package)


@query("save_model")
def save_model_query(spark, folder):
    """Largest difference between saved-and-reloaded and original scores."""
    package, test = _package(spark, folder)
    path = f"{shared_folder(spark)}/model-{uuid4().hex}"
    save_model(spark, package, path)
    loaded = load_model(spark, path)
    a = models.score(package.pipeline, test, "p1", package.method).select("Record_ID", "p1")
    b = models.score(loaded.pipeline, test, "p2", loaded.method).select("Record_ID", "p2")
    return a.join(b, "Record_ID").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("largest_difference")
    )


@query("feature_group_ablation")
def ablation_query(spark, folder):
    train, _, val, _ = _parts(spark, folder)
    return models.feature_group_ablation(train, val, **FOREST)


@query("permutation_importance")
def importance_query(spark, folder):
    train, _, val, _ = _parts(spark, folder)
    model = models.fit_classifier(train, "random_forest", **FOREST)
    return models.permutation_importance(model, val, "Record_ID", PREDICTORS)


@query("group_holdout")
def holdout_query(spark, folder):
    reps = models.group_holdout(_panel(spark, folder), **FOREST)
    return models.holdout_summary(reps)


@query("attribution_topk")
def attribution_query(spark, folder):
    train, _, _, test = _parts(spark, folder)
    model = models.fit_classifier(train, "random_forest", **FOREST)
    names = models.feature_names(model, NUMERIC_PREDICTORS, CATEGORICAL_PREDICTORS)
    return models.attribution_topk(model, test, names)


@query("shapley_values")
def shapley_query(spark, folder):
    """Shapley values of every test row; base plus their sum is the forest's probability."""
    train, _, _, test = _parts(spark, folder)
    model = models.fit_classifier(train, "random_forest", **FOREST)
    out = models.shapley_values(model, test, "Record_ID")
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b)
    return out.select("Record_ID", F.size("values").alias("n_slots"), rounded(F.col("base")).alias("base"), rounded(F.col("base") + total).alias("p"))


# --- clustering -------------------------------------------------------------

_CLUST = ["Hazard_Score", "Exposure_Score", "Vulnerability_Score", "Preparedness_Score"]


def _unit_scores(spark, folder):
    return durable(unit_means(v.indexed(spark, folder), _CLUST, extra=["Region"]))


@query("kmeans_units")
def kmeans_query(spark, folder):
    labelled = clusters.kmeans_units(_unit_scores(spark, folder), "District", _CLUST)
    return labelled.select("District", "Cluster")


@query("cluster_diagnostics")
def diagnostics_query(spark, folder):
    return clusters.cluster_diagnostics(_unit_scores(spark, folder), "District", _CLUST)


_POINTS = f"""{o.INDEXED}, pt AS (SELECT District u, Region c, avg(Hazard_Score) a, avg(Exposure_Score) b, avg(Vulnerability_Score) d, avg(Preparedness_Score) e FROM indexed GROUP BY 1,2)"""


@query("silhouette", f"""WITH {_POINTS}, ds AS (SELECT x.u, x.c own, y.c, sum(sqrt((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)+(x.d-y.d)*(x.d-y.d)+(x.e-y.e)*(x.e-y.e))) s, count(*) n FROM pt x, pt y GROUP BY 1,2,3),
  ab AS (SELECT u, max(CASE WHEN own=c THEN n END) n, max(CASE WHEN own=c AND n>1 THEN s/(n-1) END) a, min(CASE WHEN own<>c THEN s/n END) b FROM ds GROUP BY 1)
  SELECT {r6('avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END)')} silhouette, count(*) n_units FROM ab""")
def silhouette_query(spark, folder):
    return clusters.silhouette(_unit_scores(spark, folder), "District", "Region", _CLUST).select("n_units", *_r("silhouette"))


@query("squared_silhouette", f"""WITH {_POINTS}, ds AS (SELECT x.u, x.c own, y.c, sum((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)+(x.d-y.d)*(x.d-y.d)+(x.e-y.e)*(x.e-y.e)) s, count(*) n FROM pt x, pt y GROUP BY 1,2,3),
  ab AS (SELECT u, max(CASE WHEN own=c THEN n END) n, max(CASE WHEN own=c AND n>1 THEN s/(n-1) END) a, min(CASE WHEN own<>c THEN s/n END) b FROM ds GROUP BY 1)
  SELECT {r6('avg(CASE WHEN n=1 THEN 0 ELSE (b-a)/greatest(a,b) END)')} silhouette, count(*) n_units FROM ab""")
def squared_silhouette_query(spark, folder):
    return clusters.squared_silhouette(_unit_scores(spark, folder), "Region", _CLUST).select("n_units", *_r("silhouette"))


@query("davies_bouldin", f"""WITH {_POINTS}, ct AS (SELECT c, avg(a) a, avg(b) b, avg(d) d, avg(e) e FROM pt GROUP BY 1),
  sc AS (SELECT ct.c, any_value(ct.a) a, any_value(ct.b) b, any_value(ct.d) d, any_value(ct.e) e,
    avg(sqrt((pt.a-ct.a)*(pt.a-ct.a)+(pt.b-ct.b)*(pt.b-ct.b)+(pt.d-ct.d)*(pt.d-ct.d)+(pt.e-ct.e)*(pt.e-ct.e))) s FROM pt JOIN ct USING (c) GROUP BY 1),
  w AS (SELECT x.c, max((x.s+y.s)/sqrt((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)+(x.d-y.d)*(x.d-y.d)+(x.e-y.e)*(x.e-y.e))) m FROM sc x JOIN sc y ON x.c<>y.c GROUP BY 1)
  SELECT {r6('avg(m)')} davies_bouldin, count(*)::INT n_clusters FROM w""")
def davies_bouldin_query(spark, folder):
    return clusters.davies_bouldin(_unit_scores(spark, folder), "Region", _CLUST).select("n_clusters", *_r("davies_bouldin"))


@query("pca_2d")
def pca_query(spark, folder):
    return clusters.pca_2d(_unit_scores(spark, folder), "District", _CLUST).select("District", *_r("PCA_1", "PCA_2"))
