"""Boosted trees by second-order steps over quantised features.

Features become bins once; a block of rows then is one byte string, slot by
slot, that a task reads without touching single rows.  A tree grows
level by level: every task sums gradients and curvatures of its rows by
(node, feature, bin), the sums of a feature meet in one stream that keeps only
running totals, and the driver sees one best split per node and feature.  The
rows themselves never move.  Leaves take Newton steps with an L2 penalty.

Reruns agree: partial sums are added in the order of their tasks, and a task
lost with its executor reads the same rows of a written table again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasFeaturesCol,
    HasLabelCol,
    HasMaxIter,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
    HasSeed,
    HasStepSize,
    HasWeightCol,
)
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
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import durable

TREE = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"
BLOCKS = "bins binary, y binary, w binary, margin binary, ahead binary"
SPLITS = "feature int, node int, gain double, bin int, left_g double, left_h double, g double, h double"


# --- bins ---------------------------------------------------------------------


def quantile_cuts(rows: DataFrame, slots: int, max_bins: int) -> list[np.ndarray]:
    """Per slot of ``x`` its ascending cuts: the least value and approximate quantiles, at most ``max_bins - 1``."""
    grid = [i / (max_bins - 1) for i in range(max_bins - 1)]  # the greatest value needs no cut
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], grid, 100 * max_bins).alias(f"c{i}") for i in range(slots)]).first()
    return [np.unique(np.array([v for v in cuts or [] if v is not None and not np.isnan(v)], dtype=float)) for cuts in found]


def binned(rows: DataFrame, cuts: Sequence[np.ndarray], base: float) -> DataFrame:
    """Blocks of rows (bins slot by slot, y, w, margin, ahead): bin b holds values above cut b - 1 and up to cut b; NaN is above all cuts.

    ``ahead`` is the sum of the trees since the margins were written.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)
                y, w = (pdf[c].to_numpy(dtype=float) for c in ("y", "w"))
                yield pd.DataFrame({c: [v.tobytes()] for c, v in zip(_COLUMNS, (bins, y, w, np.full(len(x), base), np.zeros(len(x))))})

    return rows.mapInPandas(deal, BLOCKS)


_COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[list[np.ndarray]]:
    """bins (slots, rows), y, w, margin, ahead of each block; nothing is copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            bins, *numbers = [np.frombuffer(column[i].as_buffer(), np.uint8) for column in batch.columns]
            yield [bins.reshape(slots, -1), *[v.view(np.float64) for v in numbers]]


# Least curvature of a child from which no rows need to be counted.
COUNTLESS = 1e-3


# --- trees --------------------------------------------------------------------


def walk(tree: dict[str, np.ndarray], x: np.ndarray, ends: str, by_slot: bool = False) -> np.ndarray:
    """The node that every row of ``x`` (``by_slot``: every column) reaches, by ``x <= tree[ends]``; a leaf leads to itself."""
    rows, slot = len(x), np.maximum(tree["feature"], 0)
    row, flat, sides = np.arange(rows) * x.shape[1], x.ravel(), np.column_stack([tree["right"], tree["left"]]).ravel()
    if by_slot:
        rows = x.shape[1]
        row, slot = np.arange(rows), slot * rows
    node = np.zeros(rows, dtype=np.int64)
    for _ in range(len(slot)):  # at most as many levels
        if (tree["feature"][node] < 0).all():
            break
        node = sides[2 * node + (flat[row + slot[node]] <= tree[ends][node])]
    return node


def gradients(loss: str, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return w * (p - y), w * np.maximum(p * (1.0 - p), 1e-16)
    return w * (margin - y), w


class _Tree:
    """A tree while it grows: nodes with sums of gradients and curvatures."""

    def __init__(self) -> None:
        self.nodes = [{"feature": -1, "bin": 0, "left": 0, "right": 0, "gain": 0.0, "g": 0.0, "h": 0.0}]

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array([n[k] for n in self.nodes], dtype=np.int64) for k in ("feature", "bin", "left", "right")}

    def split(self, at: int, feature: int, cut: int, gain: float, left: tuple[float, float]) -> list[int]:
        node, first = self.nodes[at], len(self.nodes)
        node.update(feature=feature, bin=cut, left=first, right=first + 1, gain=gain)
        for i, (g, h) in enumerate((left, (node["g"] - left[0], node["h"] - left[1]))):
            self.nodes.append({"feature": -1, "bin": 0, "left": first + i, "right": first + i, "gain": 0.0, "g": g, "h": h})
        return [first, first + 1]

    def finished(self, cuts: Sequence[np.ndarray], rate: float, penalty: float, max_leaves: int) -> dict[str, np.ndarray]:
        """Flat arrays.  With a limit of leaves, splits open by descending gain, as if grown leaf by leaf."""
        opened, heap = set(), [(-self.nodes[0]["gain"], 0)]
        while heap and (not max_leaves or len(opened) + 1 < max_leaves):
            _, at = heapq.heappop(heap)
            node = self.nodes[at]
            if node["feature"] >= 0:
                opened.add(at)
                for child in (node["left"], node["right"]):
                    heapq.heappush(heap, (-self.nodes[child]["gain"], child))
        order, place = [0], {0: 0}
        for at in order:
            if at in opened:
                for child in (self.nodes[at]["left"], self.nodes[at]["right"]):
                    place[child] = len(order)
                    order.append(child)
        out = {k: [] for k in ("feature", "bin", "threshold", "left", "right", "value", "cover")}
        for at in order:
            node, inner = self.nodes[at], at in opened
            out["feature"].append(node["feature"] if inner else -1)
            out["bin"].append(node["bin"])
            out["threshold"].append(float(cuts[node["feature"]][node["bin"]]) if inner else 0.0)
            out["left"].append(place[node["left"]] if inner else place[at])
            out["right"].append(place[node["right"]] if inner else place[at])
            out["value"].append(-rate * node["g"] / (node["h"] + penalty) if node["h"] + penalty > 0 else 0.0)
            out["cover"].append(node["h"])
        return {k: np.array(v) for k, v in out.items()}


def level_splits(
    rows: DataFrame, loss: str, tree: dict, active: Sequence[int], bins: Sequence[int],
    penalty: float, min_weight: float, min_rows: int, rate: float, seed: int,
) -> DataFrame:
    """The best split of every active node in every feature, with the node's sums; gain null where none is allowed.

    Rows are counted only where their number matters: every row has a positive
    curvature, so a child that reaches a least curvature well above rounding has one.
    """
    slots, width, nodes = len(bins), max(bins), len(active)
    kinds = 2 if min_rows <= 1 and min_weight >= COUNTLESS else 3
    where = np.full(len(tree["feature"]), -1)
    where[list(active)] = np.arange(nodes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        draws = np.random.Generator(np.random.Philox(key=[seed, part]))
        shaped = np.zeros((kinds, slots, nodes * width))
        for x, y, w, margin, ahead in _blocks(batches, slots):
            at = where[walk(tree, x, "bin", by_slot=True)]
            if rate < 1.0:
                at = np.where(draws.random(len(y)) < rate, at, -1)
            in_use = at >= 0
            g, h = gradients(loss, y, w, margin + ahead)
            if not in_use.all():
                x, at, g, h = x[:, in_use], at[in_use], g[in_use], h[in_use]
            first = at * width
            for f, bin_ in enumerate(x):  # one slot at a time: its cells stay in the processor's cache
                cell = first + bin_
                for i, v in enumerate((g, h, None)[:kinds]):
                    shaped[i, f] += np.bincount(cell, v, nodes * width)
        sums = [shaped[:, i].tobytes() for i in range(slots)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([part] * slots, pa.int32()), pa.array(sums, pa.binary())], ["feature", "part", "sums"])

    def best(feature: int, total: np.ndarray) -> pd.DataFrame:
        total = total.reshape(kinds, nodes, width)
        whole = total.sum(axis=2)
        g, h = whole[:2]
        left = total.cumsum(axis=2)[:, :, :-1] if width > 1 else np.zeros((kinds, nodes, 1))
        right = whole[:, :, None] - left
        allowed = np.minimum(left[1], right[1]) >= min_weight
        if kinds == 3:
            allowed &= np.minimum(left[2], right[2]) >= max(1, min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            worth = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty)
            gain = np.where(allowed, (worth - (g**2 / (h + penalty))[:, None]) / 2, -np.inf)
        cut, every = gain.argmax(axis=1), np.arange(nodes)
        top = gain[every, cut]
        return pd.DataFrame({
            "feature": feature, "node": list(active), "gain": [float(v) if np.isfinite(v) else None for v in top], "bin": cut,
            "left_g": left[0][every, cut], "left_h": left[1][every, cut], "g": g, "h": h,
        })

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, total = None, None
        for pdf in batches:
            for f, sums in zip(pdf["feature"], pdf["sums"]):
                if f != feature:
                    if total is not None:
                        yield best(feature, total)
                    feature, total = f, np.zeros(kinds * nodes * width)
                total += np.frombuffer(sums)
        if total is not None:
            yield best(feature, total)

    partials = rows.mapInArrow(partial, "feature int, part int, sums binary")
    return partials.repartition("feature").sortWithinPartitions("feature", "part").mapInPandas(merge, SPLITS)


def grow_tree(rows: DataFrame, loss: str, cuts: Sequence[np.ndarray], s: dict, seed: int) -> dict:
    """One tree on the gradients at the margins of ``rows``."""
    tree, active, bins = _Tree(), [0], [len(c) + 1 for c in cuts]
    for _ in range(s["maxDepth"]):
        found = level_splits(
            rows, loss, tree.arrays(), active, bins, s["regLambda"], s["minChildWeight"], s["minInstancesPerNode"],
            s["subsamplingRate"], seed,
        ).collect()  # nodes of the level x features
        if active == [0]:
            sums = min(found, key=lambda r: r["feature"])
            tree.nodes[0].update(g=sums["g"], h=sums["h"])
        by_node = {}
        for r in sorted((r for r in found if r["gain"] is not None and r["gain"] > s["minGain"]), key=lambda r: (-r["gain"], r["feature"])):
            by_node.setdefault(r["node"], r)
        active = [
            child for at in sorted(by_node) for r in [by_node[at]]
            for child in tree.split(at, r["feature"], r["bin"], r["gain"], (r["left_g"], r["left_h"]))
        ]
        if not active:
            break
    return tree.finished(cuts, s["stepSize"], s["regLambda"], s["maxLeaves"])


def boost(rows: DataFrame, loss: str, s: dict) -> tuple[float, list[dict]]:
    """(base margin, trees) from (x array, y, w).

    A row walks a tree once: its margins are kept on local disk after every
    tree, and written again after every ``checkpointInterval`` trees, so that
    what an executor loses is made again from few trees.
    """
    held = durable(rows.where("y IS NOT NULL AND w > 0 AND x IS NOT NULL"))
    first = held.agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"), F.max(F.size("x")).alias("slots")).first()
    if first["w"] is None:
        raise ValueError("no rows with a label, features and a positive weight")
    if not first["slots"]:
        raise ValueError("the rows have no features")
    mean = first["wy"] / first["w"]
    base = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))) if loss == "logistic" else float(mean)
    cuts = quantile_cuts(held, first["slots"], s["maxBins"])
    table, trees, kept = durable(binned(held, cuts, base)), [], []
    try:
        for i in range(s["maxIter"]):
            if trees:
                write = (len(trees) - 1) % max(1, s["checkpointInterval"]) == max(1, s["checkpointInterval"]) - 1
                table = _advanced(table, trees[-1], len(cuts), write)
                if write:
                    table = durable(table)
                else:
                    kept.append(table.persist(StorageLevel.DISK_ONLY))
            trees.append(grow_tree(table, loss, cuts, s, s["seed"] % 2**31 * 2**20 + i))
            while kept and kept[0] is not table:
                kept.pop(0).unpersist()
    finally:
        for old in kept:
            old.unpersist()
    return base, trees


def _advanced(table: DataFrame, tree: dict, slots: int, write: bool) -> DataFrame:
    """The blocks after one more tree; ``write``: with all trees ahead in the margins."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (x, _, _, margin, ahead) in enumerate(_blocks([batch], slots)):
                ahead = ahead + tree["value"][walk(tree, x, "bin", by_slot=True)]
                margin, ahead = (margin + ahead, np.zeros(len(ahead))) if write else (margin, ahead)
                made = [pa.array([v.tobytes()], pa.binary()) for v in (margin, ahead)]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:3]], *made], _COLUMNS)

    return table.mapInArrow(add, BLOCKS)


# --- estimators ---------------------------------------------------------------


class _Settings(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree, opened by gain; 0: no limit", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 2 to 256", TypeConverters.toInt)
    regLambda = Param(Params._dummy(), "regLambda", "L2 penalty of leaves", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "a split gains more than this", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least curvature of a child", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows that a tree sees", TypeConverters.toFloat)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "trees between writes of margins", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            maxIter=100, stepSize=0.3, seed=42, maxDepth=6, maxLeaves=0, maxBins=64, regLambda=1.0, minGain=0.0, minChildWeight=1.0,
            minInstancesPerNode=1, subsamplingRate=1.0, checkpointInterval=10,
        )

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)


class _ClassifierSettings(_Settings, HasProbabilityCol, HasRawPredictionCol):
    def setProbabilityCol(self, value: str):
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value: str):
        return self._set(rawPredictionCol=value)


class _Booster(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    loss: str

    def __init__(self, **settings) -> None:
        super().__init__()
        self._set(**settings)

    def _fit(self, df: DataFrame):
        s = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        if not 2 <= s["maxBins"] <= 256:
            raise ValueError("maxBins is 2 to 256")
        weight = F.col(s["weightCol"]).cast("double") if s.get("weightCol") else F.lit(1.0)
        rows = df.select(
            vector_to_array(s["featuresCol"]).alias("x"), F.col(s["labelCol"]).cast("double").alias("y"), weight.alias("w")
        )
        base, trees = boost(rows, self.loss, s)
        return self._copyValues(self.fitted(base, trees))


class _BoosterModel(Model, MLWritable, MLReadable):
    """``tree_arrays`` hold the trees; their values include the learning rate.  ``base`` is the margin without trees."""

    def __init__(self, base: float = 0.0, trees: Sequence[dict] = ()) -> None:
        super().__init__()
        self.base, self.tree_arrays = base, list(trees)

    def margin(self) -> Column:
        """The summed trees, on Arrow batches; the model travels with the task."""
        base, trees = self.base, self.tree_arrays

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series(dtype=float)
            rows = np.stack(x.to_numpy())
            return pd.Series(base + sum((t["value"][walk(t, rows, "threshold")] for t in trees), np.zeros(len(rows))))

        return margin(vector_to_array(self.getOrDefault("featuresCol")))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class NewtonClassifierModel(_BoosterModel, _ClassifierSettings):
    def _transform(self, df: DataFrame) -> DataFrame:
        raw, probability, prediction = (self.getOrDefault(c) for c in ("rawPredictionCol", "probabilityCol", "predictionCol"))
        p = 1.0 / (1.0 + F.exp(-vector_to_array(raw)[1]))
        out = df.withColumn(raw, self.margin()).withColumn(raw, array_to_vector(F.array(-F.col(raw), F.col(raw))))
        out = out.withColumn(probability, array_to_vector(F.array(1.0 - p, p)))
        return out.withColumn(prediction, (vector_to_array(raw)[1] > 0).cast("double"))


class NewtonRegressorModel(_BoosterModel, _Settings):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault("predictionCol"), self.margin())


class NewtonClassifier(_Booster, _ClassifierSettings):
    """Two classes, logistic loss.  Rows without label, features or positive weight take no part."""

    loss, fitted = "logistic", NewtonClassifierModel


class NewtonRegressor(_Booster, _Settings):
    """Squared loss.  Rows without label, features or positive weight take no part."""

    loss, fitted = "squared", NewtonRegressorModel


class _Writer(MLWriter):
    def __init__(self, model: _BoosterModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"base": self.model.base})
        names = [c.split()[0] for c in TREE.split(", ")][2:]
        rows = [
            (i, j, *[t[c][j].item() for c in names]) for i, t in enumerate(self.model.tree_arrays) for j in range(len(t["feature"]))
        ]
        self.sparkSession.createDataFrame(rows, TREE).coalesce(1).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _BoosterModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.schema(TREE).parquet(f"{path}/trees").toPandas().sort_values(["tree", "node"])
        trees = [{c: part[c].to_numpy() for c in nodes.columns[2:]} for _, part in nodes.groupby("tree")]
        model = self.cls(metadata["base"], trees)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
