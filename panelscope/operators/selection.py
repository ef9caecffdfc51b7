"""From candidate event models to the one in use, as an Estimator with a Model that can be saved.

``EventClassifier`` tunes over expanding periods where asked, refits the best
setting on all training rows, calibrates on the calibration rows and chooses
the threshold on the validation rows.  Its model scores rows, can be a stage of
a pipeline, and is saved and loaded like any other model.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PREDICTORS
from ..sources.durable import durable
from ..sources.model_store import load_model, save_model
from . import metrics, models
from .splits import split_label

ROLES = ("train", "calibration", "validation")


def with_roles(panel: DataFrame, train_end: int = 2022, cal_end: int = 2023, val_end: int = 2024, year: str = "Year", output: str = "Role") -> DataFrame:
    """Rows with a target and the part of the chronological split they belong to."""
    return panel.where(F.col(models.TARGET).isNotNull()).withColumn(output, split_label(F.col(year), train_end, cal_end, val_end))


class _Settings(Params):
    kind = Param(Params._dummy(), "kind", "classifier by name", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "JSON of the classifier's settings; the best of the tuning replace them", TypeConverters.toString)
    tune = Param(Params._dummy(), "tune", "draw settings and compare them on expanding periods", TypeConverters.toBoolean)
    grid = Param(Params._dummy(), "grid", "JSON of the tuning grid; empty: the grid of the kind", TypeConverters.toString)
    draws = Param(Params._dummy(), "draws", "settings drawn from the grid", TypeConverters.toInt)
    folds = Param(Params._dummy(), "folds", "expanding folds by period", TypeConverters.toInt)
    period = Param(Params._dummy(), "period", "column of the period", TypeConverters.toString)
    role = Param(Params._dummy(), "role", "column that tells training, calibration and validation rows", TypeConverters.toString)
    recall = Param(Params._dummy(), "recall", "least recall of the threshold on validation rows", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of draws and fits", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            kind="random_forest", settings="{}", tune=False, grid="", draws=20, folds=5, period="Event_Date", role="Role",
            recall=0.75, seed=42,
        )


class EventClassifier(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Tuned, refitted, calibrated classifier with a decision threshold."""

    @keyword_only
    def __init__(self, *, kind=None, settings=None, tune=None, grid=None, draws=None, folds=None, period=None, role=None, recall=None, seed=None) -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> EventClassifierModel:
        get = lambda name: self.getOrDefault(getattr(self, name))
        needed = dict.fromkeys([get("role"), models.TARGET, *PREDICTORS, *([get("period")] if get("tune") else [])])
        rows = durable(df.where(F.col(get("role")).isin(*ROLES)).select(*needed))
        train, calibration, validation = [rows.where(F.col(get("role")) == part) for part in ROLES]
        settings, table = json.loads(get("settings")), []
        if get("tune"):
            grid = json.loads(get("grid")) if get("grid") else None
            found = models.tuning_scores(train, get("kind"), get("period"), get("draws"), get("folds"), get("seed"), grid=grid)
            settings = {**settings, **found[0][0]}
            table = [(i, str(sorted(draw.items())), *rest) for draw, i, *rest in found]
        base = models.fit_classifier(train, get("kind"), seed=get("seed"), **settings)
        pipeline, method, _, hist = models.calibrate_with_scores(base, calibration, validation)
        threshold = metrics.optimal_threshold(hist, get("recall")).first()["threshold"]
        package = models.ModelPackage(pipeline, float(threshold), tuple(PREDICTORS), method)
        return self._copyValues(EventClassifierModel(package, table))


class EventClassifierModel(Model, _Settings, MLWritable, MLReadable):
    """Adds ``p`` and ``event`` (p reaches the threshold) to rows; ``tuning`` holds the settings that were compared."""

    def __init__(self, package: models.ModelPackage | None = None, table: Sequence[tuple] = ()) -> None:
        super().__init__()
        self.package, self.table = package, list(table)

    @property
    def threshold(self) -> float:
        return self.package.threshold

    def tuning(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.table, models.TUNING)

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = models.score(self.package.pipeline, df, "p", self.package.method)
        return scored.withColumn("event", (F.col("p") >= self.threshold).cast("int"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: EventClassifierModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        save_model(self.sparkSession, self.model.package, f"{path}/package")
        self.model.tuning(self.sparkSession).coalesce(1).write.parquet(f"{path}/tuning")


class _Reader(MLReader):
    def load(self, path: str) -> EventClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.parquet(f"{path}/tuning").orderBy(F.desc("mean_average_precision"), "setting")
        model = EventClassifierModel(load_model(self.sparkSession, f"{path}/package"), [tuple(r) for r in table.collect()])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def compare_classifiers(
    fitted: dict[str, EventClassifierModel], rows: DataFrame, preferred: str = "random_forest", rival: str = "xgboost", margin: float = 0.01
) -> DataFrame:
    """All metrics of every model at 0.50, at its own threshold and at the winner's; ``is_winner`` by PR area.

    The preferred model wins where it is within ``margin`` of its rival.
    """
    target = models.TARGET
    parts = [m.transform(rows).select(F.lit(name).alias("model"), target, "p") for name, m in fitted.items()]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    hist = durable(metrics.score_histogram(scored, target, by=["model"]))
    both = preferred in fitted and rival in fitted
    picked = metrics.select_model(
        metrics.classification_report(hist, 0.5, ["model"]), preferred=preferred if both else None, rival=rival if both else None, margin=margin
    )
    winner = picked.where("is_winner").first()["model"]

    def at(name: str, thresholds: dict[str, float]) -> DataFrame:
        value = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("model")]
        report = metrics.classification_report(hist.withColumn("_at", value), F.col("_at"), ["model"])
        return report.select(F.lit(name).alias("threshold_kind"), value.alias("threshold"), "*", (F.col("model") == winner).alias("is_winner"))

    out = at("default", dict.fromkeys(fitted, 0.5))
    out = out.unionByName(at("own", {name: m.threshold for name, m in fitted.items()}))
    return out.unionByName(at("winner", dict.fromkeys(fitted, fitted[winner].threshold)))


def compare_regressors(train: DataFrame, test: DataFrame, target: str, settings: dict[str, dict]) -> tuple[DataFrame, dict]:
    """(n, MAE, RMSE, R2 and more per kind with ``is_winner`` by R2, fitted models by kind)."""
    fitted = {kind: models.fit_regressor(train, target, kind, **params) for kind, params in settings.items()}
    found = []
    for kind, model in fitted.items():
        scored = models.predict_loss(model, test, kind)
        found.append(metrics.regression_metrics(scored, target, "y_hat").select(F.lit(kind).alias("model"), "*"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    table = durable(out)
    winner = table.agg(F.max_by("model", F.struct("r_squared", "model"))).first()[0]
    return table.withColumn("is_winner", F.col("model") == winner), fitted


def score_for_star(panel: DataFrame, model: EventClassifierModel, loss_model, loss_kind: str) -> DataFrame:
    """``panel`` with ``p`` of the event model and ``predicted_loss`` of the loss model, as the prediction fact takes them."""
    scored = models.score(model.package.pipeline, panel, "p", model.package.method)
    return models.predict_loss(loss_model, scored, loss_kind, "predicted_loss")
