"""Unit clustering: k-means, cluster diagnostics, PCA and labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide
from ..sources.durable import count_rows, durable, spread, with_rows

# Labels of the four operational clusters.
TYPOLOGY = {
    0: "High-Exposure Well-Prepared",
    1: "High-Exposure Low-Capacity",
    2: "High-Vulnerability Low-Capacity",
    3: "Low-Risk Well-Prepared",
}


def standardised(df: DataFrame, columns: Sequence[str], output: str = "features") -> tuple[DataFrame, PipelineModel]:
    """Zero mean, unit variance feature vector."""
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol=output, withMean=True, withStd=True),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model.transform(df).drop("_raw"), model


def _mixed(keys: np.ndarray, *labels: int) -> np.ndarray:
    """Uniforms in (0, 1] from 64-bit row keys and labels (splitmix64 steps)."""
    h = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for label in (*labels, 0):
            h = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(label + 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(float) + 1.0) / 2.0**53


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centres, coordinate by coordinate, so that equal points are at 0."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centres[None, :, j]) ** 2
    return out


def _next_centres(points: DataFrame, sets: dict[int, np.ndarray], step: int, seed: int) -> dict[int, np.ndarray]:
    """One more centre per set, drawn by squared distance to its centres: the row with the least exponential clock."""

    def clocks(batches):
        best = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, keys = np.stack(pdf["x"].to_numpy()), pdf["h"].to_numpy().view(np.uint64)
            for number, centres in sets.items():
                weight = _distances(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    clock = -np.log(_mixed(keys, seed, number, step)) / weight
                clock = np.where(weight > 0, clock, np.inf)
                at = np.lexsort((keys, clock))[0]
                best[number] = min(best.get(number, (np.inf, 0, None)), (clock[at], keys[at], x[at]), key=lambda b: b[:2])
        rows = [(n, float(c), k.astype(np.int64), x) for n, (c, k, x) in best.items() if x is not None and np.isfinite(c)]
        yield pd.DataFrame(rows, columns=["s", "clock", "h", "x"])

    drawn = points.mapInPandas(clocks, "s int, clock double, h long, x array<double>").groupBy("s")
    found = {r["s"]: np.array(r["x"]) for r in drawn.agg(F.min_by("x", F.struct("clock", "h")).alias("x")).collect()}  # one row per set
    return {n: np.array([*c, found[n]]) if n in found else c for n, c in sets.items()}


def _moved(points: DataFrame, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """Means of the rows nearest to every centre, and the cost before the move, of all sets in one scan."""
    numbers = list(sets)
    width = len(next(iter(sets.values()))[0])

    def partial(batches):
        part = TaskContext.get().partitionId()
        sums = {n: np.zeros((len(sets[n]), width + 2)) for n in numbers}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            for n in numbers:
                d = _distances(x, sets[n])
                own = d.argmin(axis=1)
                for j, v in enumerate((*x.T, np.ones(len(x)), d[np.arange(len(x)), own])):
                    sums[n][:, j] += np.bincount(own, v, len(sets[n]))
        yield pd.DataFrame({"s": numbers, "part": part, "sums": [sums[n].tobytes() for n in numbers]})

    def add(batches):
        number, total = None, None
        for pdf in batches:
            for n, sums in zip(pdf["s"], pdf["sums"]):
                if n != number:
                    if total is not None:
                        yield pd.DataFrame({"s": [number], "sums": [total.tobytes()]})
                    number, total = n, 0.0
                total = total + np.frombuffer(sums)
        if total is not None:
            yield pd.DataFrame({"s": [number], "sums": [total.tobytes()]})

    # added in the order of the tasks, so that reruns agree; the driver takes one row per set
    rows = points.mapInPandas(partial, "s int, part int, sums binary").repartition("s").sortWithinPartitions("s", "part")
    out = {}
    for r in rows.mapInPandas(add, "s int, sums binary").collect():
        total = np.frombuffer(r["sums"]).reshape(-1, width + 2)
        n = total[:, width, None]
        out[r["s"]] = np.where(n > 0, total[:, :width] / np.maximum(n, 1.0), sets[r["s"]]), float(total[:, width + 1].sum())
    return out


def kmeans_all(
    df: DataFrame, unit: str, ks: Sequence[int], restarts: int = 10, seed: int = 42, features: str = "features", rounds: int = 300,
    tol: float = 1e-6,
) -> dict[int, tuple[np.ndarray, float]]:
    """{k: (centres, cost)}: the best of ``restarts`` k-means fits of every k, all fitted together.

    One scan a step serves every (k, restart): distance-weighted seeding takes
    as many as the largest k has centres, then each scan assigns the rows and
    sums them, until no centre of a set moves by more than ``tol`` or after
    ``rounds``.  A set that has settled leaves the scans.  Centres come sorted.

    Draws are keyed by the unit.  Rows with null features take no part; with
    fewer distinct points than k there are fewer centres; a centre that loses
    all rows stays.  No rows: no centres and cost 0.
    """
    points = durable(df.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"), F.xxhash64(unit).alias("h")))
    size = {i * restarts + r: k for i, k in enumerate(ks) for r in range(restarts)}
    sets: dict[int, np.ndarray] = {n: np.zeros((0, 0)) for n in size}
    for step in range(max(ks)):
        growing = {n: c for n, c in sets.items() if size[n] > step and len(c) == step}
        if not growing:
            break
        sets.update(_next_centres(points, growing, step, seed))
    cost, active = dict.fromkeys(sets, 0.0), [n for n, c in sets.items() if len(c)]
    for _ in range(rounds):
        if not active:
            break
        still = []
        for n, (centres, spent) in _moved(points, {n: sets[n] for n in active}).items():
            cost[n] = spent
            if ((centres - sets[n]) ** 2).sum(axis=1).max() > tol * tol:
                still.append(n)
                sets[n] = centres
        active = sorted(still)
    if active:
        cost.update({n: spent for n, (_, spent) in _moved(points, {n: sets[n] for n in active}).items()})
    out = {}
    for k in ks:
        best = min((n for n in size if size[n] == k), key=lambda n: (cost[n], n))
        out[k] = np.array(sorted(sets[best].tolist())), cost[best]
    return out


def with_clusters(df: DataFrame, fitted: dict[int, tuple[np.ndarray, float]], columns: dict[int, str], features: str = "features") -> DataFrame:
    """Add the number of the nearest centre for every k; null without features, the first centre on a tie."""
    x = vector_to_array(features)

    def nearest(centres: np.ndarray) -> Column:
        gaps = F.array(*[
            F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            for c in centres
        ])
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    return df.withColumns({name: nearest(fitted[k][0]) if len(fitted[k][0]) else F.lit(None).cast("int") for k, name in columns.items()})


def kmeans_units(
    df: DataFrame, unit: str, columns: Sequence[str], k: int = 4, restarts: int = 10, seed: int = 42
) -> DataFrame:
    """Cluster of every unit; ids are ordered by the first centroid coordinate."""
    scaled, _ = standardised(df, columns)
    fitted = kmeans_all(scaled, unit, [k], restarts, seed)
    return with_clusters(scaled, fitted, {k: "Cluster"}).select(unit, *columns, "Cluster")


def cluster_sums(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Count, coordinate sums and squared-norm sum per cluster."""
    norm = None
    for c in columns:
        term = F.col(c) * F.col(c)
        norm = term if norm is None else norm + term
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], F.sum(norm).alias("sq")
    )


def davies_bouldin(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij.

    Centroids are a k-row table; the pairs of clusters are formed inside one
    array expression.
    """
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    gap = None
    for c in columns:
        term = (F.col(c) - F.col(f"m_{c}")) * (F.col(c) - F.col(f"m_{c}"))
        gap = term if gap is None else gap + term
    # one row per cluster on the right-hand side
    scatter = df.join(F.broadcast(centres), cluster).groupBy(cluster).agg(
        F.avg(F.sqrt(gap)).alias("s"), *[F.first(f"m_{c}").alias(f"m_{c}") for c in columns]
    )
    packed = scatter.agg(F.collect_list(F.struct(cluster, "s", F.array(*[f"m_{c}" for c in columns]).alias("m"))).alias("cs"))

    def distance(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a["m"], b["m"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))

    worst = F.transform(
        "cs",
        lambda a: F.array_max(
            F.transform(F.filter("cs", lambda b: b[cluster] != a[cluster]), lambda b: divide(a["s"] + b["s"], distance(a, b)))
        ),
    )
    return packed.select(
        divide(F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v), F.size("cs")).alias("davies_bouldin"),
        F.size("cs").alias("n_clusters"),
    )


def _distance_sums(points: DataFrame, width: int, sizes: Sequence[int], group_rows: int) -> DataFrame:
    """(l, u, own, c, d): for every row and labelling the summed distances to each cluster.

    ``points`` has u, x0, x1, ... and cluster numbers c0, c1, ..., one per
    labelling of ``sizes[l]`` clusters, -1 for none.  Rows are dealt into
    groups of about ``group_rows``; a group meets all rows in a stream, its own
    first, and holds only its rows and their sums.  A cluster with a missing
    coordinate has no sum.
    """
    rows = count_rows(points)
    groups = max(1, -(-rows // group_rows))
    xs, cs = [f"x{j}" for j in range(width)], [f"c{i}" for i in range(len(sizes))]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    meeting = spread(with_rows(points, rows), groups).withColumn("home", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int"))
    meeting = meeting.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("other", F.col("g") != F.col("home"))
    # only the asking rows need their id
    meeting = meeting.select("g", "other", F.when(~F.col("other"), F.col("u")).alias("u"), *xs, *cs)
    kind = points.schema["u"].dataType.simpleString()

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False)

    class Group:
        def __init__(self, parts: list[pa.RecordBatch]) -> None:
            own = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            self.ids, self.x = own.column("u"), np.column_stack([column(own, c) for c in xs]).astype(float)
            self.own = [column(own, c) for c in cs]
            self.total, self.missing = np.zeros((own.num_rows, first[-1])), np.zeros(first[-1], dtype=bool)
            self.meet(own)

        def meet(self, batch: pa.RecordBatch) -> None:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x, member = np.column_stack([column(part, c) for c in xs]).astype(float), np.zeros((part.num_rows, first[-1]))
                for i, c in enumerate(cs):
                    number = column(part, c)
                    member[np.flatnonzero(number >= 0), first[i] + number[number >= 0]] = 1.0
                whole = ~np.isnan(x).any(axis=1)
                self.missing |= member[~whole].any(axis=0)
                self.total += np.sqrt(_distances(self.x, x[whole])) @ member[whole]

        def result(self) -> Iterator[pa.RecordBatch]:
            d = np.where(self.missing, np.nan, self.total)
            for i, n in enumerate(sizes):
                part = d[:, first[i] : first[i + 1]].ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), i, dtype=np.int32)), self.ids.take(pa.array(np.repeat(np.arange(len(d)), n))),
                        pa.array(np.repeat(self.own[i], n).astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(d))),
                        pa.array(part, mask=np.isnan(part)),
                    ],
                    ["l", "u", "own", "c", "d"],
                )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, asking, group = None, [], None
        for batch in batches:
            keys = column(batch, "g").astype(np.int64) * 2 + column(batch, "other").astype(np.int64)
            ends = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(ends, ends[1:]):
                part, g, other = batch.slice(lo, hi - lo), keys[lo] // 2, keys[lo] % 2
                if g != number:
                    if asking:
                        yield from (group or Group(asking)).result()
                    number, asking, group = g, [], None
                if not other:
                    asking.append(part)
                elif asking:
                    group = group or Group(asking)
                    group.meet(part)
        if asking:
            yield from (group or Group(asking)).result()

    dealt = meeting.repartition(4 * groups, "g").sortWithinPartitions("g", "other")
    return dealt.mapInArrow(sums, f"l int, u {kind}, own int, c int, d double")


def silhouettes(df: DataFrame, unit: str, clusters: Sequence[str], columns: Sequence[str], block_rows: int = 2048) -> DataFrame:
    """(l, silhouette, n_units): mean Euclidean silhouette, exact, of every labelling ``clusters[l]``.

    Every unit needs its mean distance to each cluster, an inherently quadratic
    number of distances; all labellings share them.  A task holds
    ``block_rows`` units and the sums of each to the clusters, and the rest
    passes by.  ``squared_silhouette`` is linear.
    """
    points = durable(df.select(F.col(unit).alias("u"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)], *[
        F.col(c).alias(f"label{i}") for i, c in enumerate(clusters)
    ]))
    known = []
    for i in range(len(clusters)):  # one row per cluster
        known.append(points.where(F.col(f"label{i}").isNotNull()).groupBy(f"label{i}").count().orderBy(f"label{i}").collect())

    def number(i: int) -> Column:
        found = F.array_position(F.array(*[F.lit(r[0]) for r in known[i]]), F.col(f"label{i}")) if known[i] else F.lit(0)
        return (F.coalesce(found, F.lit(0)) - 1).cast("int").alias(f"c{i}")

    numbered = with_rows(points.select("u", *[f"x{j}" for j in range(len(columns))], *[number(i) for i in range(len(clusters))]), count_rows(points))
    sums = _distance_sums(numbered, len(columns), [len(k) for k in known], block_rows)
    per = sums.groupBy("l", "u", "own", "c").agg(F.sum("d").alias("d"))
    sizes = F.array(*[F.array(*[F.lit(r[1]) for r in k]).cast("array<bigint>") for k in known])
    per = per.withColumn("size", F.get(F.get(sizes, F.col("l")), F.col("c")))
    own = F.col("own") == F.col("c")
    ab = per.groupBy("l", "u", "own").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own & (F.col("size") > 1), divide(F.col("d"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("d") / F.col("size"))).alias("b"),
    )
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.groupBy("l").agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n_units"))


def silhouette(df: DataFrame, unit: str, cluster: str, columns: Sequence[str], block_rows: int = 2048) -> DataFrame:
    """(silhouette, n_units) of one labelling; see ``silhouettes``."""
    out = silhouettes(df, unit, [cluster], columns, block_rows)
    return out.agg(F.max("silhouette").alias("silhouette"), F.coalesce(F.max("n_units"), F.lit(0)).cast("bigint").alias("n_units"))


def squared_silhouette(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Silhouette with squared Euclidean distance: linear in the rows.

    The mean squared distance to a cluster follows from its count, mean and
    squared-norm sum, so each row only meets k centroids.
    """
    sums = cluster_sums(df, cluster, columns)
    packed = sums.collect()  # one row per cluster
    table = F.array(
        *[
            F.struct(F.lit(r[cluster]).alias("c"), F.lit(float(r["n"])).alias("n"), F.lit(float(r["sq"])).alias("sq"),
                     F.array(*[F.lit(float(r[f"m_{c}"])) for c in columns]).alias("m"))
            for r in packed
        ]
    )
    x = F.array(*columns)
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)

    def spread(k):  # sum of squared distances from the row to cluster k
        dot = F.aggregate(F.zip_with(x, k["m"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return k["n"] * norm + k["sq"] - F.lit(2.0) * k["n"] * dot

    own = F.filter(table, lambda k: k["c"] == F.col(cluster))[0]
    a = F.when(own["n"] > 1, divide(spread(own), own["n"] - 1))
    b = F.array_min(F.transform(F.filter(table, lambda k: k["c"] != F.col(cluster)), lambda k: spread(k) / k["n"]))
    rows = df.select(own["n"].alias("n"), a.alias("a"), b.alias("b"))
    s = F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n_units"))


def cluster_diagnostics(
    df: DataFrame, unit: str, columns: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6, 7), restarts: int = 10, seed: int = 42
) -> DataFrame:
    """Silhouette, Davies-Bouldin and sizes for each k on standardised columns."""
    scaled, _ = standardised(df.select(unit, *columns), columns)
    coords = [f"z{i}" for i in range(len(columns))]
    flat = durable(scaled.select(unit, "features", *[vector_to_array("features")[i].alias(z) for i, z in enumerate(coords)]))
    fitted = kmeans_all(flat, unit, ks, restarts, seed)
    assigned = durable(with_clusters(flat, fitted, {k: f"Cluster_{k}" for k in ks}).drop("features"))
    scores = durable(silhouettes(assigned, unit, [f"Cluster_{k}" for k in ks], coords))
    out = None
    for i, k in enumerate(ks):
        labels = assigned.select(unit, *coords, F.col(f"Cluster_{k}").alias("Cluster"))
        sizes = labels.groupBy("Cluster").count().agg(F.sort_array(F.collect_list("count"), asc=False).alias("cluster_sizes"))
        # single aggregate rows
        mean = scores.where(F.col("l") == i).agg(F.max("silhouette").alias("silhouette"))
        row = mean.join(
            F.broadcast(davies_bouldin(labels, "Cluster", coords)), F.lit(True)
        ).join(F.broadcast(sizes), F.lit(True))
        row = row.select(F.lit(k).alias("k"), "silhouette", "davies_bouldin", "cluster_sizes")
        out = row if out is None else out.unionByName(row)
    return out


def pca_2d(df: DataFrame, unit: str, columns: Sequence[str]) -> DataFrame:
    """Two principal components of the standardised columns.

    The sign of a component is fixed by making its largest loading positive.
    """
    scaled, _ = standardised(df, columns)
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    pc = vector_to_array("_pc")
    return model.transform(scaled).select(
        unit, *[(pc[j] * F.lit(signs[j])).alias(f"PCA_{j + 1}") for j in range(2)]
    )


def order_clusters(centres: DataFrame, order: Sequence[str], output: str = "Cluster") -> DataFrame:
    """Number clusters 0..k-1 by their centroid (one row per cluster)."""
    return centres.withColumn(output, F.row_number().over(Window.orderBy(*order)) - 1)


def label_clusters(df: DataFrame, cluster: str = "Cluster", labels: dict[int, str] | None = None) -> DataFrame:
    """Map cluster ids to typology labels."""
    pairs = F.create_map(*[F.lit(x) for k, label in (labels or TYPOLOGY).items() for x in (k, label)])
    return df.withColumn("Cluster_Label", F.coalesce(pairs[F.col(cluster)], F.lit("Unknown")))
