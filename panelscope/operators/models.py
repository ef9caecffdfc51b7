"""Event classifiers and loss regressors on MLlib.

Feature handling, fits, calibration, tuning, ablation and attribution.  Every
fitted object is a ``PipelineModel``, so it can be saved and used on batch or
streaming rows without Python in the row path.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    GeneralizedLinearRegression,
    IsotonicRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..schema import (
    CATEGORICAL_PREDICTORS,
    NUMERIC_PREDICTORS,
    POST_EVENT_COLUMNS,
    PREDICTOR_GROUPS,
    RECORD_KEYS,
    require_columns,
)
from ..sources.durable import count_rows, durable, spread
from . import metrics
from .newton import NewtonClassifier, NewtonRegressor
from .ordering import row_numbers
from .permute import HELD_UNITS, permuted_values
from .profile import mode_values
from .votes import MOST_LEAVES, Ballot, ballot, replaced_areas

TARGET = "Disaster_Next_Month"
WEIGHT = "class_weight"
# Rows that one task scores where rows are multiplied.
SCORED_ROWS = 100_000


# Settings of second-order boosting by the name of the library whose defaults they are.
# Leaves are unlimited in depth there where 31 leaves are the limit; here eight levels are.
NEWTON = {
    "xgboost": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "regLambda": 1.0, "minChildWeight": 1.0},
    "lightgbm": {
        "maxIter": 100, "maxDepth": 8, "maxLeaves": 31, "stepSize": 0.1, "regLambda": 0.0, "minChildWeight": 0.001,
        "minInstancesPerNode": 20,
    },
}


def _base_columns(model):
    """Output columns of the uncalibrated classifier inside a calibrated pipeline."""
    model.setPredictionCol("base_prediction")
    model.setProbabilityCol("base_probability")
    return model.setRawPredictionCol("base_raw")


def check_predictors(predictors: Sequence[str]) -> None:
    """Refuse outcomes among the predictors."""
    leaked = [c for c in predictors if c in POST_EVENT_COLUMNS]
    if leaked:
        raise ValueError(f"post-event columns cannot be predictors: {leaked}")


def feature_pipeline(
    df: DataFrame,
    numeric: Sequence[str] = tuple(NUMERIC_PREDICTORS),
    categorical: Sequence[str] = tuple(CATEGORICAL_PREDICTORS),
    output: str = "features",
) -> list:
    """Stages: median imputation, standardisation, mode imputation, one-hot.

    Unknown categories become all zeros.  The scaler uses the sample standard
    deviation.  Modes are fitted here and stored in the SQL stage.
    """
    check_predictors([*numeric, *categorical])
    numeric, categorical = list(numeric), list(categorical)
    stages, parts = [], []
    if numeric:
        casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_n_{c}`" for c in numeric)
        stages += [
            SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
            Imputer(
                strategy="median", relativeError=0.0001,
                inputCols=[f"_n_{c}" for c in numeric], outputCols=[f"_i_{c}" for c in numeric],
            ),
            VectorAssembler(inputCols=[f"_i_{c}" for c in numeric], outputCol="_numeric"),
            StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    if categorical:
        modes = mode_values(df, categorical)
        fills = ", ".join(
            "coalesce(`{0}`, '{1}') AS `_c_{0}`".format(c, str(modes[c] if modes[c] is not None else "").replace("'", "''"))
            for c in categorical
        )
        stages += [
            SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"),
            StringIndexer(
                inputCols=[f"_c_{c}" for c in categorical], outputCols=[f"_x_{c}" for c in categorical],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(
                inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical],
                handleInvalid="error", dropLast=True,
            ),
        ]
        parts += [f"_o_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return stages


def feature_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Vector slot names: numeric columns, then column_value per category."""
    names = list(numeric)
    for stage in model.stages:
        labels = getattr(stage, "labelsArray", None)
        if labels is not None:
            for c, values in zip(categorical, labels):
                names += [f"{c}_{v}" for v in values]
    return names


def with_class_weight(df: DataFrame, label: str = TARGET, output: str = WEIGHT) -> DataFrame:
    """Balanced weights n / (2 n_c); the class counts are two scalars."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (2.0 * n))).otherwise(weight)
    return df.withColumn(output, weight)


def with_positive_weight(df: DataFrame, label: str = TARGET, output: str = WEIGHT) -> DataFrame:
    """Positives weigh neg / max(1, pos)."""
    pos, n = df.agg(F.sum(F.col(label).cast("bigint")), F.count(label)).first()
    scale = (n - (pos or 0)) / max(1, pos or 0)
    return df.withColumn(output, F.when(F.col(label) == 1, F.lit(float(scale))).otherwise(F.lit(1.0)))


def classifier(kind: str, seed: int = 42, **params):
    """Unfitted classifier by name, with the weights column attached.

    ``xgboost`` and ``lightgbm`` are second-order boosting with the default
    settings of those libraries; see ``NEWTON``.
    """
    common = {"labelCol": TARGET, "weightCol": WEIGHT, "featuresCol": "features"}
    if kind == "logistic_regression":
        # features are already standardised; see ``fit_classifier`` for the penalty
        model = LogisticRegression(**{**common, "maxIter": 1000, "standardization": False, **params})
    elif kind == "random_forest":
        model = RandomForestClassifier(
            **{**common, "numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "sqrt", "seed": seed, **params}
        )
    elif kind == "gradient_boosting":
        model = GBTClassifier(**{**common, "maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": seed, **params})
    elif kind in NEWTON:
        model = NewtonClassifier(**{**common, "seed": seed, **NEWTON[kind], **params})
    else:
        raise ValueError(f"unknown classifier: {kind}")
    return _base_columns(model)


def fit_classifier(
    train: DataFrame, kind: str = "random_forest",
    numeric: Sequence[str] = tuple(NUMERIC_PREDICTORS), categorical: Sequence[str] = tuple(CATEGORICAL_PREDICTORS),
    balanced: bool = True, seed: int = 42, **params,
) -> PipelineModel:
    """Fit features + classifier on rows with a target."""
    require_columns(train, [*numeric, *categorical, TARGET], "training data")
    rows = train.where(F.col(TARGET).isNotNull()).select(*numeric, *categorical, F.col(TARGET).cast("double").alias(TARGET))
    if not balanced or kind == "gradient_boosting":  # plain boosting takes no class weight
        rows = rows.withColumn(WEIGHT, F.lit(1.0))
    elif kind in ("xgboost", "lightgbm"):
        rows = with_positive_weight(rows)
    else:
        rows = with_class_weight(rows)
    rows = durable(rows)  # iterative fits read a compact table, not the lineage
    if kind == "logistic_regression":
        # unit inverse penalty on the summed loss: balanced weights sum to n
        params.setdefault("regParam", 1.0 / max(1, count_rows(rows)))
    features = Pipeline(stages=feature_pipeline(rows, numeric, categorical)).fit(rows)
    # a forest passes over its rows once a level; kept on disk, the features are computed once, in the same partitions
    prepared = features.transform(rows).select("features", TARGET, WEIGHT).persist(StorageLevel.DISK_ONLY)
    try:
        final = classifier(kind, seed, **params).fit(prepared)
    finally:
        prepared.unpersist()
    return PipelineModel(stages=[*features.stages, final])


def base_probability() -> Column:
    return vector_to_array(F.col("base_probability"))[1]


def score(model: PipelineModel, df: DataFrame, output: str = "p", method: str = "none") -> DataFrame:
    """Append the (calibrated) event probability and drop working columns."""
    scored = model.transform(df)
    p = {
        "none": lambda: base_probability(),
        "sigmoid": lambda: vector_to_array(F.col("cal_probability"))[1],
        "isotonic": lambda: F.col("cal_prediction"),
    }[method]()
    return scored.select(*df.columns, p.alias(output))


# --- calibration ------------------------------------------------------------


def _score_table(df: DataFrame, y: str, p: str) -> DataFrame:
    """Distinct scores with weights: calibration never sees raw rows."""
    return metrics.score_histogram(df, y, p)


def calibrate_platt(df: DataFrame, y: str = TARGET, p: str = "p") -> LogisticRegression:
    """Sigmoid on the score with Platt's soft targets.

    Each score contributes its positives and negatives as weighted rows of
    either label: t+ = (P + 1) / (P + 2) and t- = 1 / (N + 2).
    """
    hist = durable(_score_table(df, y, p))
    pos, n = hist.agg(F.sum("pos"), F.sum("n")).first()
    high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (n - pos + 2.0)
    neg = F.col("n") - F.col("pos")
    up = F.col("pos") * F.lit(high) + neg * F.lit(low)
    rows = hist.select(
        "p", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), up.alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - up).alias("w")))).alias("e")
    ).select("p", "e.label", "e.w").where("w > 0")
    data = VectorAssembler(inputCols=["p"], outputCol="_score").transform(rows)
    return LogisticRegression(
        featuresCol="_score", labelCol="label", weightCol="w", maxIter=200, regParam=0.0, standardization=False,
        predictionCol="cal_class", probabilityCol="cal_probability", rawPredictionCol="cal_raw",
    ).fit(data)


def calibrate_isotonic(df: DataFrame, y: str = TARGET, p: str = "p"):
    """Monotone step fit of the positive share on the score."""
    hist = durable(_score_table(df, y, p)).select("p", (F.col("pos") / F.col("n")).alias("label"), F.col("n").cast("double").alias("w"))
    data = VectorAssembler(inputCols=["p"], outputCol="_score").transform(hist)
    return IsotonicRegression(featuresCol="_score", labelCol="label", weightCol="w", predictionCol="cal_prediction").fit(data)


def apply_calibration(df: DataFrame, model, p: str = "p", output: str = "p_calibrated") -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=[p], outputCol="_score").transform(df))
    value = F.col("cal_prediction") if "cal_prediction" in out.columns else vector_to_array(F.col("cal_probability"))[1]
    return out.select(*df.columns, value.alias(output))


def calibrated_pipeline(base: PipelineModel, calibrator) -> PipelineModel:
    """Base pipeline, score slice and calibrator as one persistable model."""
    cut = VectorSlicer(inputCol="base_probability", outputCol="_score", indices=[1])
    return PipelineModel(stages=[*base.stages, cut, calibrator])


def calibrate_with_scores(base: PipelineModel, calibration: DataFrame, validation: DataFrame, y: str = TARGET) -> tuple[PipelineModel, str, dict, DataFrame]:
    """``calibrate_best`` with the score histogram of the chosen pipeline on the validation rows.

    The base scores either part once; calibration is a function of the score,
    so the candidates are applied to written scores.
    """
    cal, val = [durable(score(base, part).select(y, "p")) for part in (calibration, validation)]
    candidates = {"sigmoid": calibrate_platt(cal, y), "isotonic": calibrate_isotonic(cal, y)}
    hists = {
        name: durable(metrics.score_histogram(apply_calibration(val, fitted).select(y, F.col("p_calibrated").alias("p")), y))
        for name, fitted in candidates.items()
    }
    errors = {name: metrics.ece(hist).first()["ece"] for name, hist in hists.items()}
    best = "sigmoid" if errors["sigmoid"] < errors["isotonic"] else "isotonic"
    return calibrated_pipeline(base, candidates[best]), best, errors, hists[best]


def calibrate_best(base: PipelineModel, calibration: DataFrame, validation: DataFrame, y: str = TARGET) -> tuple[PipelineModel, str, dict]:
    """Sigmoid or isotonic, whichever has the lower validation ECE (isotonic on a tie)."""
    return calibrate_with_scores(base, calibration, validation, y)[:3]


# --- regressors -------------------------------------------------------------

LOG_SCALE = {"ridge", "linear", "random_forest", "gradient_boosting", "xgboost", "lightgbm"}


def _ridge_penalty(rows: DataFrame, label: str, alpha: float) -> float:
    """MLlib scales the label by its deviation: alpha * sd(y) / n gives ridge alpha."""
    sd, n = rows.agg(F.stddev_pop(label), F.count(label)).first()
    return alpha * (sd or 0.0) / max(1, n)


def ridge(label: str, penalty: float, features: str = "features") -> LinearRegression:
    return LinearRegression(
        labelCol=label, featuresCol=features, elasticNetParam=0.0, standardization=False, regParam=penalty, solver="normal"
    )


def _tweedie_stage(label: str, power: float, penalty: float) -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(
        family="tweedie", variancePower=power, linkPower=0.0, labelCol=label, featuresCol="features",
        regParam=penalty, maxIter=100, tol=1e-8,
    )


def regressor(kind: str, rows: DataFrame, label: str, seed: int = 42, **params):
    """Unfitted regressor by name; log-scale kinds expect a log1p label."""
    tree = {"labelCol": label, "featuresCol": "features", "seed": seed}
    if kind in ("ridge", "linear"):
        return ridge(label, _ridge_penalty(rows, label, params.pop("alpha", 1.0)))
    if kind == "random_forest":
        return RandomForestRegressor(**{**tree, "numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "all", **params})
    if kind == "gradient_boosting":
        return GBTRegressor(**{**tree, "maxIter": 100, "maxDepth": 5, "stepSize": 0.1, **params})
    if kind in NEWTON:
        return NewtonRegressor(**{**tree, **NEWTON[kind], **params})
    if kind == "gamma":
        return GeneralizedLinearRegression(
            **{"family": "gamma", "link": "log", "labelCol": label, "featuresCol": "features", "regParam": 1.0, "maxIter": 100, **params}
        )
    raise ValueError(f"unknown regressor: {kind}")


def fit_regressor(
    train: DataFrame, target: str, kind: str = "ridge",
    numeric: Sequence[str] = tuple(NUMERIC_PREDICTORS), categorical: Sequence[str] = tuple(CATEGORICAL_PREDICTORS),
    seed: int = 42, **params,
) -> PipelineModel:
    """Loss regressor; log1p target for ridge and trees, raw y > 0 for GLMs."""
    require_columns(train, [*numeric, *categorical, target], "training data")
    y = F.col(target).cast("double")
    label = F.log1p(y) if kind in LOG_SCALE else y
    rows = train.where(y.isNotNull() if kind in LOG_SCALE else (y > 0)).select(*numeric, *categorical, label.alias("label"))
    rows = durable(rows)
    features = Pipeline(stages=feature_pipeline(rows, numeric, categorical)).fit(rows)
    prepared = durable(features.transform(rows).select("features", "label"))
    if kind == "tweedie":
        final = fit_tweedie(prepared, "label", **params)
    else:
        final = regressor(kind, prepared, "label", seed, **params).fit(prepared)
    return PipelineModel(stages=[*features.stages, final])


def fit_tweedie(rows: DataFrame, label: str, power: float = 1.5, alpha: float = 1.0, rounds: int = 8, tol: float = 1e-6):
    """Tweedie GLM with log link and penalty alpha.

    MLlib applies the penalty inside weighted least squares whose weights are
    normalised, so the equivalent value is alpha / mean(mu^(2 - power)); it is
    refitted until that value is stable.
    """
    penalty, model = alpha, None
    for _ in range(rounds):
        model = _tweedie_stage(label, power, penalty).fit(rows)
        moment = model.transform(rows).agg(F.avg(F.pow("prediction", F.lit(2.0 - power)))).first()[0]
        updated = alpha / moment
        if abs(updated - penalty) <= tol * penalty:
            break
        penalty = updated
    return model


def predict_loss(model: PipelineModel, df: DataFrame, kind: str, output: str = "y_hat") -> DataFrame:
    """Predictions on the original scale (expm1 for log-scale kinds)."""
    value = F.expm1("prediction") if kind in LOG_SCALE else F.col("prediction")
    return model.transform(df).select(*df.columns, value.alias(output))


# --- tuning -----------------------------------------------------------------

# Hyper-parameter grids.
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [1, 2, 5]},
    "xgboost": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1, 0.2]},
}


def grid_draws(kind: str, n: int = 20, seed: int = 42, grid: dict | None = None) -> list[dict]:
    """n settings drawn without replacement from the grid."""
    grid = grid or GRIDS[kind]
    cells = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    picks = np.random.default_rng(seed).permutation(len(cells))[:n]
    return [cells[i] for i in picks]


def expanding_folds(df: DataFrame, period: str, n_folds: int = 5) -> list[tuple[DataFrame, DataFrame]]:
    """Expanding windows by period: train on everything before, test on the next block.

    Periods (months) are calendar sized, so listing them on the driver is safe.
    """
    periods = [r[0] for r in df.select(period).distinct().orderBy(period).collect()]
    size = len(periods) // (n_folds + 1)
    if not size:
        raise ValueError(f"{n_folds} folds need at least {n_folds + 1} periods, found {len(periods)}")
    folds = []
    for i in range(n_folds):
        start = len(periods) - (n_folds - i) * size
        end = start + size
        last = periods[end - 1]
        folds.append(
            (df.where(F.col(period) < F.lit(periods[start])), df.where(F.col(period).between(periods[start], last)))
        )
    return folds


def tuning_scores(
    train: DataFrame, kind: str, period: str = "Event_Date", n_draws: int = 20, n_folds: int = 5, seed: int = 42,
    parallelism: int = 2, grid: dict | None = None,
    numeric: Sequence[str] = tuple(NUMERIC_PREDICTORS), categorical: Sequence[str] = tuple(CATEGORICAL_PREDICTORS),
) -> list[tuple[dict, int, float, float, int]]:
    """(setting, number, mean and sd of average precision, folds) per drawn setting, best first."""
    rows = durable(train.where(F.col(TARGET).isNotNull()).select(period, TARGET, *numeric, *categorical))
    folds = expanding_folds(rows, period, n_folds)
    draws = grid_draws(kind, n_draws, seed, grid)

    def run(job):
        setting, (fit_rows, test_rows) = job
        model = fit_classifier(fit_rows, kind, numeric, categorical, seed=seed, **draws[setting])
        hist = metrics.score_histogram(score(model, test_rows).select(TARGET, "p"), TARGET)
        return setting, metrics.curve_areas(hist).first()["average_precision"]

    jobs = [(i, fold) for i in range(len(draws)) for fold in folds]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        results = list(pool.map(run, jobs))
    values: dict[int, list[float]] = {}
    for setting, value in results:
        if value is not None:  # a fold without positives has no average precision
            values.setdefault(setting, []).append(value)
    if not values:
        raise ValueError("no fold has both classes")
    table = [(draws[i], i, float(np.mean(v)), float(np.std(v)), len(v)) for i, v in values.items()]
    return sorted(table, key=lambda r: (-r[2], r[1]))


TUNING = "setting int, parameters string, mean_average_precision double, std_average_precision double, n_folds int"


def tune_time_series(train: DataFrame, kind: str, **how) -> DataFrame:
    """Mean average precision per drawn setting, best first; ``selection.EventClassifier`` refits the best one."""
    table = [(i, str(sorted(draw.items())), *rest) for draw, i, *rest in tuning_scores(train, kind, **how)]
    return train.sparkSession.createDataFrame(table, TUNING).orderBy(F.desc("mean_average_precision"), "setting")


# --- batch scoring ----------------------------------------------------------


@dataclass(frozen=True)
class ModelPackage:
    """A fitted pipeline with what scoring needs to know about it."""

    pipeline: PipelineModel
    threshold: float
    features: tuple[str, ...]
    method: str = "none"
    version: str = "3.1"
    target: str = TARGET


def score_batch(df: DataFrame, package: ModelPackage, threshold: float | None = None) -> DataFrame:
    """Keys, probability rounded to 4, class by the unrounded probability, threshold.

    Works on batch and streaming rows: projections only, no shuffle.
    """
    require_columns(df, RECORD_KEYS, "scoring input")
    require_columns(df, package.features, "scoring input")
    t = float(package.threshold if threshold is None else threshold)
    scored = score(package.pipeline, df, "_p", package.method)
    return scored.select(
        *RECORD_KEYS,
        half_even(F.col("_p"), 4).alias("Predicted_Disaster_Probability"),
        (F.col("_p") >= t).cast("int").alias("Predicted_Disaster_Next_Month"),
        F.lit(t).alias("Decision_Threshold_Used"),
    )


# --- ablation, importance, holdout ------------------------------------------


def _areas(model: PipelineModel, rows: DataFrame) -> tuple[float, float]:
    hist = metrics.score_histogram(score(model, rows).select(TARGET, "p"), TARGET)
    r = metrics.curve_areas(hist).first()
    return r["roc_auc"], r["pr_auc"]


def feature_group_ablation(
    train: DataFrame, validation: DataFrame, groups: dict[str, Sequence[str]] | None = None,
    categorical: Sequence[str] = tuple(CATEGORICAL_PREDICTORS), seed: int = 42, **params,
) -> DataFrame:
    """ROC and PR area without each feature group, against all features."""
    groups = groups or PREDICTOR_GROUPS
    everything = [c for g in groups.values() for c in g]
    fit_rows, test_rows = durable(train), durable(validation)
    rows = []
    base = None
    for name, removed in [("baseline", []), *groups.items()]:
        left = [c for c in everything if c not in removed]
        if not left:
            continue
        model = fit_classifier(fit_rows, "random_forest", left, categorical, seed=seed, **params)
        roc, pr = _areas(model, test_rows)
        base = base or (roc, pr)
        rows.append((name, len(removed), len(left) + len(categorical), roc, pr, base[0] - roc, base[1] - pr))
    return train.sparkSession.createDataFrame(
        rows,
        "feature_group string, n_removed int, n_remaining int, roc_auc double, pr_auc double, delta_roc_auc double, delta_pr_auc double",
    )


def permutation_importance(
    model: PipelineModel, rows: DataFrame, key: str, features: Sequence[str], n_repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Drop in ROC-AUC when one feature is shuffled, mean and sd over repeats.

    Every row is paired with a donor row per repeat; shuffling a feature takes
    its value from the donor.  Where the model is a forest of small trees on
    ``feature_pipeline`` and a task can hold the rows, features are computed
    once a row and all variants of a replicate are scored in arrays; else all
    (feature, repeat) variants are scored in one job and reduced to score histograms.
    """
    base = durable(rows.where(F.col(TARGET).isNotNull()).select(key, TARGET, *features))
    baseline = _areas(model, base)[0]
    forest = forest_ballot(model, features) if 0 < count_rows(base) <= HELD_UNITS and features and n_repeats > 0 else None
    if forest is not None:
        numbered = durable(row_numbers(base, key, "_i"))
        areas = replaced_areas(forest, _coded_rows(model, forest, numbered, key), key, features, n_repeats, seed)
    else:
        areas = _replaced_areas(model, base, key, features, n_repeats, seed)
    drop = F.lit(baseline) - F.col("roc_auc")
    return areas.groupBy("feature").agg(
        F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"), F.count(F.lit(1)).alias("n_repeats")
    ).orderBy(F.desc("importance_mean"), "feature")


def predictor_slots(model: PipelineModel) -> tuple[dict[str, tuple[int, int]], list[str]] | None:
    """First slot and end of each predictor in the vector of ``feature_pipeline``, and the one-hot ones; None for other pipelines."""
    slots, one_hot, expected = {}, [], []
    for stage in model.stages[:-1]:
        kind = type(stage).__name__
        if kind == "VectorAssembler" and stage.getOutputCol() == "_numeric":
            slots |= {c.removeprefix("_i_"): (i, i + 1) for i, c in enumerate(stage.getInputCols())}
            expected.append("_scaled")
        elif kind == "StringIndexerModel":
            for c, labels in zip(stage.getInputCols(), stage.labelsArray):
                first = max((stop for _, stop in slots.values()), default=0)
                slots[c.removeprefix("_c_")] = (first, first + len(labels))
                one_hot.append(c.removeprefix("_c_"))
            expected += [f"_o_{c}" for c in one_hot]
        elif kind == "VectorAssembler":
            if stage.getOutputCol() != "features" or stage.getInputCols() != expected:
                return None
        elif kind not in ("SQLTransformer", "ImputerModel", "StandardScalerModel", "OneHotEncoderModel"):
            return None
    last = model.stages[-1]
    whole = max((stop for _, stop in slots.values()), default=0)
    return (slots, one_hot) if slots and getattr(last, "numFeatures", None) == whole else None


def forest_ballot(model: PipelineModel, features: Sequence[str]) -> Ballot | None:
    """The model's forest for ``replaced_areas``, None where that does not apply."""
    forest = model.stages[-1]
    if type(forest).__name__ != "RandomForestClassificationModel" or forest.numClasses != 2:
        return None
    if any(t.numNodes > 2 * MOST_LEAVES - 1 for t in forest.trees):
        return None
    found = predictor_slots(model)
    if found is None or not set(features) <= set(found[0]):
        return None
    return ballot([_tree_arrays(t, 1.0) for t in forest.trees], *found)


def _coded_rows(model: PipelineModel, forest: Ballot, numbered: DataFrame, key: str) -> DataFrame:
    """_i, key, _y, _codes: the features of every row, computed once."""
    prepared = PipelineModel(stages=model.stages[:-1]).transform(numbered)
    prepared = prepared.select("_i", F.col(key), (F.col(TARGET) == 1).alias("_y"), vector_to_array("features").alias("_x"))

    def code(batches):
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = forest.codes(x) if batch.num_rows else np.zeros((0, 1), np.uint16)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary())], ["_i", key, "_y", "_codes"])

    kind = prepared.schema[key].dataType.simpleString()
    return prepared.mapInArrow(code, f"_i bigint, `{key}` {kind}, _y boolean, _codes binary")


def _replaced_areas(model: PipelineModel, base: DataFrame, key: str, features: Sequence[str], n_repeats: int, seed: int) -> DataFrame:
    """(feature, rep, roc_auc): a row per variant, scored by the whole pipeline."""
    donors = permuted_values(base.select(key, F.struct(*features).alias("donor")), key, "donor", n_repeats, seed)
    paired = spread(durable(base.join(donors, key)), len(features), SCORED_ROWS).withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    variants = paired.select(
        "feature", "rep", TARGET,
        *[F.when(F.col("feature") == f, F.col("donor")[f]).otherwise(F.col(f)).alias(f) for f in features],
    )
    hist = metrics.score_histogram(score(model, variants).select("feature", "rep", TARGET, "p"), TARGET, by=["feature", "rep"])
    return metrics.roc_auc(hist, ["feature", "rep"])


def holdout_units(units: DataFrame, unit: str, share: float, rep: int, seed: int) -> DataFrame:
    """The ``share`` of units that come first in a keyed random order of this repeat."""
    order = F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(seed), F.lit(rep), F.col(unit).cast("string"))), F.col(unit).cast("string"))
    placed = row_numbers(durable(units.select(unit, order.alias("_order"))), "_order", "_place")
    return placed.where(F.col("_place") <= max(1, int(count_rows(units) * share))).select(unit)


def group_holdout(
    df: DataFrame, unit: str = "District", n_repeats: int = 5, share: float = 0.2, seed: int = 42,
    numeric: Sequence[str] = tuple(NUMERIC_PREDICTORS), categorical: Sequence[str] = tuple(CATEGORICAL_PREDICTORS), **params,
) -> DataFrame:
    """ROC, PR and Brier of a forest on held-out units, one row per repeat.

    Repeats whose train or test part has a single class are skipped.
    """
    rows = durable(df.where(F.col(TARGET).isNotNull()).select(unit, TARGET, *numeric, *categorical))
    units = durable(rows.select(unit).distinct())
    reps = [holdout_units(units, unit, share, rep, seed).withColumn("_rep", F.lit(rep)) for rep in range(n_repeats)]
    if reps:  # the rows meet the units once, not once for each part of each repeat
        held = functools.reduce(DataFrame.unionByName, reps).groupBy(unit).agg(F.collect_set("_rep").alias("_held"))
        rows = durable(rows.join(held, unit, "left"))
    found = []
    for rep in range(n_repeats):
        is_held = F.coalesce(F.array_contains("_held", rep), F.lit(False))
        test, train = rows.where(is_held), rows.where(~is_held)
        classes = [part.select(TARGET).distinct().count() for part in (train, test)]
        if min(classes) < 2:
            continue
        model = fit_classifier(train, "random_forest", numeric, categorical, seed=seed + rep, **params)
        hist = durable(metrics.score_histogram(score(model, test).select(TARGET, "p"), TARGET))
        area, quality = metrics.curve_areas(hist).first(), metrics.brier(hist).first()
        found.append((rep, area["roc_auc"], area["pr_auc"], quality["brier"]))
    return df.sparkSession.createDataFrame(found, "rep int, roc_auc double, pr_auc double, brier double")


def holdout_summary(reps: DataFrame) -> DataFrame:
    """Mean, population sd, min and max per metric."""
    names = ["roc_auc", "pr_auc", "brier"]
    wide = reps.agg(
        F.count(F.lit(1)).alias("n_repeats"),
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in names],
    )
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col("n_repeats"), F.col(c).alias("s")) for c in names])
    return wide.select(F.explode(entries).alias("e")).select("e.metric", "e.n_repeats", "e.s.*")


# --- attribution ------------------------------------------------------------


def _tree_arrays(tree, weight: float) -> dict[str, np.ndarray]:
    """Flat arrays of one fitted tree (feature, threshold, children, value, cover)."""
    feature, threshold, left, right, value, cover, votes = [], [], [], [], [], [], []

    def visit(node) -> int:
        i = len(feature)
        stats = list(node.impurityStats().stats())
        votes.append([s / sum(stats) for s in stats] if sum(stats) else [0.0 for _ in stats])
        feature.append(-1), threshold.append(0.0), left.append(i), right.append(i)
        cover.append(node.impurityStats().count())
        value.append(weight * (stats[1] / sum(stats) if len(stats) == 2 else node.prediction()))
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[i] = split.featureIndex()
            first, second = node.leftChild(), node.rightChild()
            if "Categorical" in split.getClass().getSimpleName():
                # one-hot slots are 0/1 categories: cut between them
                threshold[i] = 0.5
                if 0.0 not in list(split.leftCategories()):
                    first, second = second, first
            else:
                threshold[i] = split.threshold()
            left[i], right[i] = visit(first), visit(second)
        return i

    visit(tree._call_java("rootNode"))
    return {
        "feature": np.array(feature), "threshold": np.array(threshold), "left": np.array(left),
        "right": np.array(right), "value": np.array(value), "cover": np.array(cover, dtype=float),
        "votes": np.array(votes) if all(len(v) == 2 for v in votes) else None,
    }


@dataclass(frozen=True)
class LeafPath:
    """The way to a leaf: per feature the interval (low, high] that leads there and the share of rows that take it."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_paths(tree: dict[str, np.ndarray]) -> list[LeafPath]:
    """Every leaf with the features on its path merged, so that each counts once."""
    found, stack = [], [(0, {})]
    while stack:
        node, way = stack.pop()
        split = int(tree["feature"][node])
        if split < 0:
            ends = np.array([[*way[f]] for f in way]).reshape(-1, 3)
            found.append(LeafPath(float(tree["value"][node]), np.array(list(way), dtype=int), ends[:, 0], ends[:, 1], ends[:, 2]))
            continue
        low, high, share = way.get(split, (-np.inf, np.inf, 1.0))
        cut = tree["threshold"][node]
        for child, ends in ((tree["left"][node], (low, min(high, cut))), (tree["right"][node], (max(low, cut), high))):
            stack.append((child, {**way, split: (*ends, share * tree["cover"][child] / tree["cover"][node])}))
    return found


def expected_value(paths: Sequence[LeafPath]) -> float:
    """The value of a row of which nothing is known."""
    return sum(p.value * float(p.share.prod()) for p in paths)


def add_shapley(paths: Sequence[LeafPath], x: np.ndarray, out: np.ndarray) -> None:
    """Add the path-dependent Shapley values of one tree to ``out`` (rows x slots).

    A feature that is known follows the row, one that is not divides it by the
    shares of the children.  For a leaf with d features, the Shapley weights of
    feature i sum the coefficients of the polynomial of the others; that sum is
    the integral over t in (0, 1) of the product of
    share_j (1 - t) + follows_j t, of degree d - 1, which (d + 1) / 2 nodes of
    Gauss-Legendre give without error.
    """
    for path in paths:
        d = len(path.features)
        if not d:
            continue
        own = x[:, path.features]
        follows = ((own > path.low) & (own <= path.high)).astype(float)
        nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        total = np.zeros_like(follows)
        for t, w in zip((nodes + 1) / 2, weights / 2):
            factors = path.share * (1 - t) + follows * t  # positive, as t < 1 and every child has rows
            total += w * factors.prod(axis=1, keepdims=True) / factors
        out[:, path.features] += path.value * (follows - path.share) * total


def ensemble_paths(ensemble) -> list[list[LeafPath]]:
    """The leaf paths of the trees of a fitted ensemble, with the trees' weights in the values."""
    if hasattr(ensemble, "tree_arrays"):
        return [tree_paths(t) for t in ensemble.tree_arrays]
    weights = [1.0 / len(ensemble.trees)] * len(ensemble.trees)
    if "GBT" in type(ensemble).__name__:
        weights = list(ensemble.treeWeights)
    return [tree_paths(_tree_arrays(t, w)) for t, w in zip(ensemble.trees, weights)]


def shapley_values(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """key, base, values: Shapley values per feature slot; base plus their sum is the ensemble's output.

    The output is the probability of a forest classifier, the margin of boosted
    trees and the prediction of a regressor.  The model travels with the task.
    """
    trees = ensemble_paths(model.stages[-1])
    base = sum(expected_value(t) for t in trees) + getattr(model.stages[-1], "base", 0.0)
    prepared = PipelineModel(stages=model.stages[:-1]).transform(rows).select(key, vector_to_array("features").alias("x"))

    def explain(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 0))
            out = np.zeros(x.shape)
            for paths in trees:
                add_shapley(paths, x, out)
            yield pd.DataFrame({key: pdf[key], "base": base, "values": list(out)})

    kind = prepared.schema[key].dataType.simpleString()
    return prepared.mapInPandas(explain, f"`{key}` {kind}, base double, values array<double>")


def attribution_topk(model: PipelineModel, rows: DataFrame, names: Sequence[str], k: int = 10) -> DataFrame:
    """Mean absolute Shapley value per feature slot of a tree ensemble.

    Trees (a model-sized object) travel with the task; only per-batch sums
    leave it.
    """
    trees = ensemble_paths(model.stages[-1])
    n_slots, labels = len(names), list(names)
    prepared = PipelineModel(stages=model.stages[:-1]).transform(rows).select(vector_to_array("features").alias("x"))

    def explain(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, n_slots))
            total = np.zeros((len(x), n_slots))
            for paths in trees:
                add_shapley(paths, x, total)
            yield pd.DataFrame({"feature": labels, "total": np.abs(total).sum(axis=0), "n": len(x)})

    sums = prepared.mapInPandas(explain, "feature string, total double, n long").groupBy("feature").agg(
        (F.sum("total") / F.sum("n")).alias("mean_abs_contribution")
    )
    return sums.orderBy(F.desc("mean_abs_contribution"), "feature").limit(k)
