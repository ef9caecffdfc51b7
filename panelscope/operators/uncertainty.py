"""Index sensitivity, Monte Carlo weights and cluster bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_index, uniform
from ..functions.numeric import divide
from ..schema import COMPONENTS, EXPERT_WEIGHTS
from ..sources.durable import count_rows, durable
from . import metrics
from .ordering import _ranged, average_rank, exact_quantiles, running_totals
from .permute import draw_vectors, drawn_replicates

MAX_SIMULATIONS = 1_000_000  # weight rows that travel with a task
DRAWN = 5_000_000  # residuals that one task draws


def _literal_weights(spark: SparkSession, rows: list[tuple], columns: Sequence[str], id_schema: str) -> DataFrame:
    schema = id_schema + ", " + ", ".join(f"w{i} double" for i in range(len(columns)))
    return spark.createDataFrame(rows, schema)


def knockout_weights(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per component: that weight 0, the others rescaled to sum 1."""
    weights = weights or EXPERT_WEIGHTS
    rows = []
    for name in weights:
        left = sum(w for c, w in weights.items() if c != name)
        rows.append((name, *[0.0 if c == name else w / left for c, w in weights.items()]))
    return _literal_weights(spark, rows, list(weights), "component string")


def sweep_weights(
    spark: SparkSession, weights: dict[str, float] | None = None, low: float = 0.0, high: float = 2.0, steps: int = 21
) -> DataFrame:
    """Each weight times an even grid of multipliers, rescaled to sum 1."""
    weights = weights or EXPERT_WEIGHTS
    rows = []
    for name in weights:
        for k in range(steps):
            m = low + (high - low) * k / (steps - 1)
            moved = {c: w * m if c == name else w for c, w in weights.items()}
            total = sum(moved.values())
            rows.append((name, k, round(m, 10), *[w / total for w in moved.values()]))
    return _literal_weights(spark, rows, list(weights), "component string, step int, multiplier double")


def uniform_weights(
    spark: SparkSession, n: int = 200, low: float = 0.1, high: float = 0.9, seed: int = 42, size: int = len(COMPONENTS)
) -> DataFrame:
    """(sim, w0..) for simulations 1..n; see ``weights_for``."""
    return weights_for(spark.range(1, n + 1).select(F.col("id").alias("sim")), low, high, seed, size)


def weights_for(
    sims: DataFrame, low: float = 0.1, high: float = 0.9, seed: int = 42, size: int = len(COMPONENTS)
) -> DataFrame:
    """Uniform weights rescaled to sum 1, keyed by (sim, component)."""
    raw = sims.select(
        "sim", *[(F.lit(low) + F.lit(high - low) * uniform(seed, F.col("sim"), i)).alias(f"r{i}") for i in range(size)]
    )
    total = sum((F.col(f"r{i}") for i in range(1, size)), F.col("r0"))
    return raw.select("sim", *[(F.col(f"r{i}") / total).alias(f"w{i}") for i in range(size)])


def dirichlet_weights(
    spark: SparkSession, n: int = 1000, weights: Sequence[float] | None = None, concentration: float = 50.0, seed: int = 42
) -> DataFrame:
    """(sim, w0..): Dirichlet draws centred on ``weights``.

    Each row seeds its generator with (seed, sim), so rows do not depend on the
    partitioning and are identical after recomputation.
    """
    centre = [float(w) for w in (weights or EXPERT_WEIGHTS.values())]
    if abs(sum(centre) - 1.0) > 1e-8:
        raise ValueError("weights must sum to 1")
    alpha = np.array(centre) * concentration
    names = [f"w{i}" for i in range(len(centre))]

    def draw(batches):
        for pdf in batches:
            rows = [np.random.default_rng([seed, int(s)]).dirichlet(alpha) for s in pdf["id"]]
            out = pd.DataFrame(np.array(rows).reshape(-1, len(centre)), columns=names)
            out.insert(0, "sim", pdf["id"].to_numpy())
            yield out

    return spark.range(1, n + 1).mapInPandas(draw, "sim long, " + ", ".join(f"{c} double" for c in names))


def _in_row(means: DataFrame, weights: DataFrame, ids: Sequence[str], score: Column) -> DataFrame:
    """``means`` with ``_sims``, an array of (ids, score) in the order of ``ids``.

    The weight table has one row per simulation, a parameter of the method and
    not of the data; its size is checked where it becomes one row.
    """
    table = weights.agg(F.array_sort(F.collect_list(F.struct(*ids, *[c for c in weights.columns if c not in ids]))).alias("_w"))
    message = F.lit(f"more than {MAX_SIMULATIONS} simulations")
    table = table.select(F.when(F.size("_w") <= MAX_SIMULATIONS, F.col("_w")).otherwise(F.raise_error(message)).alias("_w"))
    # the right side is a single aggregate row
    return means.join(F.broadcast(table), F.lit(True)).withColumn("_sims", score).drop("_w")


def simulated_arrays(
    means: DataFrame, weights: DataFrame, ids: Sequence[str], unit: str = "District",
    components: Sequence[str] = tuple(COMPONENTS),
) -> DataFrame:
    """(unit, components..., _sims): every weight row applied to a unit inside its row.

    ``_sims`` holds (ids, score) in the order of ``ids``; a score is NULL where
    a component is.  The mean over time commutes with the linear index, so
    unit means suffice.  Nothing is shuffled.
    """
    names = [c for c in weights.columns if c not in ids]

    def score(w: Column) -> Column:
        total = None
        for c, name in zip(components, names):
            term = w[name] * F.col(c)
            total = term if total is None else total + term
        return F.struct(*[w[i].alias(i) for i in ids], total.alias("score"))

    return _in_row(means.select(unit, *components), weights, ids, F.transform("_w", score))


def simulated_scores(
    means: DataFrame, weights: DataFrame, ids: Sequence[str], unit: str = "District",
    components: Sequence[str] = tuple(COMPONENTS), output: str = "score",
) -> DataFrame:
    """(ids, unit, components..., score): ``simulated_arrays`` as rows, for operators that rank units within a simulation."""
    rows = simulated_arrays(means, weights, ids, unit, components).select(unit, *components, F.explode("_sims").alias("_s"))
    return rows.select(*[F.col(f"_s.{i}").alias(i) for i in ids], unit, *components, F.col("_s.score").alias(output))


def _ranked(means: DataFrame, weights: DataFrame, ids: Sequence[str], unit: str, baseline: str, digits: int) -> DataFrame:
    """Simulated and baseline ranks; scores are rounded so that equal sums tie."""
    base = durable(means)
    ranked = average_rank(base.withColumn("_base", F.round(baseline, digits)), "_base", output="base_rank")
    sims = simulated_scores(base, weights, ids, unit).withColumn("score", F.round("score", digits))
    out = average_rank(sims.select(*ids, unit, "score"), "score", ids, output="sim_rank")
    return out.join(ranked.select(unit, "base_rank"), unit)


def rank_correlations(
    means: DataFrame, weights: DataFrame, ids: Sequence[str], unit: str = "District",
    baseline: str = "Disaster_Risk_Score", digits: int = 9,
) -> DataFrame:
    """Spearman rho of each weighting against the baseline ranking."""
    return _ranked(means, weights, ids, unit, baseline, digits).groupBy(*ids).agg(
        F.corr("base_rank", "sim_rank").alias("rho"), F.count(F.lit(1)).alias("n_units")
    )


def knockout(means: DataFrame, unit: str = "District", baseline: str = "Disaster_Risk_Score") -> DataFrame:
    """Rank correlation after dropping each component, with its label."""
    weights = knockout_weights(means.sparkSession)
    rho = rank_correlations(means, weights, ["component"], unit, baseline)
    label = F.when(F.col("rho") > 0.95, "minimally").when(F.col("rho") > 0.85, "moderately").otherwise("substantially")
    return rho.withColumn("effect", label)


def weight_sweep(means: DataFrame, unit: str = "District", baseline: str = "Disaster_Risk_Score") -> DataFrame:
    """rho per component and multiplier, the component's minimum and first argmin."""
    rho = rank_correlations(
        means, sweep_weights(means.sparkSession), ["component", "step", "multiplier"], unit, baseline
    ).withColumn("rho", F.round("rho", 4))
    w = Window.partitionBy("component")  # 21 rows
    return rho.select(
        "component", "multiplier", "rho", F.min("rho").over(w).alias("min_rho"),
        F.min_by("multiplier", F.struct("rho", "step")).over(w).alias("most_sensitive_multiplier"),
    )


def random_weight_sensitivity(
    means: DataFrame, weights: DataFrame, unit: str = "District", baseline: str = "Disaster_Risk_Score",
    k: int = 10, digits: int = 9,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per simulation, per unit, overall) under random weights.

    Per simulation: rho and the share of the baseline top k that stays in the
    simulated top k.  Per unit: baseline rank, median simulated rank and its
    5/95 percentiles.
    """
    ranks = durable(_ranked(means, weights, ["sim"], unit, baseline, digits))
    # k rows per simulation: the rank filter is applied before the shuffle
    sides = []
    for rank in ("sim_rank", "base_rank"):
        w = Window.partitionBy("sim").orderBy(rank, unit)
        sides.append(ranks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("sim", unit))
    overlap = sides[0].join(sides[1], ["sim", unit]).groupBy("sim").agg(
        (F.count(F.lit(1)) / F.lit(float(k))).alias("top_k_overlap")
    )
    rho = ranks.groupBy("sim").agg(F.corr("base_rank", "sim_rank").alias("rho"))
    per_sim = rho.join(overlap, "sim", "left").withColumn("top_k_overlap", F.coalesce("top_k_overlap", F.lit(0.0)))
    # one value per simulation: bounded by the simulation count
    per_unit = ranks.groupBy(unit).agg(
        F.max("base_rank").alias("expert_rank"), F.percentile("sim_rank", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("q")
    ).select(
        unit, "expert_rank", F.col("q")[0].alias("median_rank"), F.col("q")[1].alias("rank_p5"), F.col("q")[2].alias("rank_p95")
    )
    overall = per_sim.agg(
        F.avg("rho").alias("mean_rho"), F.stddev_pop("rho").alias("std_rho"),
        F.avg("top_k_overlap").alias("top_k_stability"), F.count(F.lit(1)).alias("n_sims"),
    )
    return per_sim, per_unit, overall


# --- Monte Carlo index ------------------------------------------------------


def _place(values: str, size: Column, prob: float) -> Column:
    """Linear-interpolation quantile of a sorted array column; NULL if it is empty."""
    at = F.lit(prob) * (size - 1)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(size > 0, low + (high - low) * (at - F.floor(at)))


def mc_risk_index(means: DataFrame, weights: DataFrame, unit: str = "District") -> DataFrame:
    """Mean, median, population sd and percentiles of the score per unit.

    A unit's scores are one sorted array, as long as there are simulations, and
    everything is computed from it in the unit's row.
    """
    scores = F.array_sort(F.filter(F.transform("_sims", lambda s: s["score"]), lambda x: x.isNotNull()))
    rows = simulated_arrays(means, weights, ["sim"], unit).select(unit, scores.alias("_x"))
    n = F.size("_x")
    rows = rows.withColumn("mean_risk", divide(F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + x), n))
    squares = F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean_risk")) * (x - F.col("mean_risk")))
    levels = {"median_risk": 0.5, "ci_lower_2_5": 0.025, "ci_upper_97_5": 0.975, "ci_lower_5": 0.05, "ci_upper_95": 0.95}
    return rows.select(
        unit, "mean_risk", F.sqrt(divide(squares, n)).alias("std_risk"), *[_place("_x", n, q).alias(name) for name, q in levels.items()]
    )


def mc_weight_stats(weights: DataFrame, ids: Sequence[str] = ("sim",)) -> DataFrame:
    names = [c for c in weights.columns if c not in ids]
    wide = weights.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in names]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("weight"), F.col(c).alias("s")) for c in names])
    return wide.select(F.explode(rows).alias("e")).select("e.weight", "e.s.*")


def mc_convergence(
    means: DataFrame, row_counts: DataFrame, weights: DataFrame, unit: str = "District",
    checkpoints: Sequence[int] = (100, 200, 500, 1000), n_column: str = "n_rows",
) -> DataFrame:
    """Grand mean, sd across simulations and sd of unit means at each checkpoint.

    The index is linear, so sums over units and means over simulations commute
    with it: a simulation's grand mean is its weights applied to the mean
    components of all rows, and a unit's mean at a checkpoint is the mean
    weights applied to its components.  Neither needs a score per unit and
    simulation.  Units that lack a component take no part.  Checkpoints are
    distinct and none exceeds the number of simulations.
    """
    names = [c for c in weights.columns if c != "sim"]
    total_sims = weights.count()
    points = sorted({min(c, total_sims) for c in checkpoints})
    marks = F.filter(F.array(*[F.lit(p) for p in points]), lambda c: c >= F.col("sim"))
    marked = weights.select(*names, "sim", F.explode(marks).alias("n_iterations"))

    def index(values: Sequence[Column], factors: Sequence[Column]) -> Column:
        return sum((w * c for c, w in zip(values[1:], factors[1:])), factors[0] * values[0])

    units = durable(means.join(row_counts.select(unit, n_column), unit).select(*COMPONENTS, n_column).dropna(subset=list(COMPONENTS)))
    centre = units.agg(*[divide(F.sum(F.col(c) * F.col(n_column)), F.sum(n_column)).alias(f"_m{i}") for i, c in enumerate(COMPONENTS)])
    # the right side is a single aggregate row
    per_sim = marked.join(F.broadcast(centre), F.lit(True)).select(
        "n_iterations", index([F.col(f"_m{i}") for i in range(len(names))], [F.col(c) for c in names]).alias("m")
    )
    across = per_sim.groupBy("n_iterations").agg(F.avg("m").alias("grand_mean"), F.stddev_pop("m").alias("std_across_sims"))
    mean_weights = marked.groupBy("n_iterations").agg(*[F.avg(c).alias(c) for c in names])
    table = mean_weights.agg(F.collect_list(F.struct("n_iterations", *names)).alias("_w"))  # one entry per checkpoint
    at = units.join(F.broadcast(table), F.lit(True)).select(*COMPONENTS, F.explode("_w").alias("_w"))
    at = at.select("_w.n_iterations", index([F.col(c) for c in COMPONENTS], [F.col(f"_w.{c}") for c in names]).alias("m"))
    spread = at.groupBy("n_iterations").agg(F.stddev_pop("m").alias("std_of_unit_means"))
    return across.join(spread, "n_iterations")


def mc_rank_stability(means: DataFrame, weights: DataFrame, unit: str = "District", band: float = 5.0, digits: int = 9) -> DataFrame:
    """Share of simulations in which a unit's rank is within ``band`` of its median."""
    base = durable(means)
    sims = simulated_scores(base, weights, ["sim"], unit).withColumn("score", F.round("score", digits))
    ranked = durable(ordinal_rank(sims.select("sim", unit, "score"), ["sim"], "score", unit))
    medians = ranked.groupBy(unit).agg(F.percentile("rank", F.lit(0.5)).alias("median"))
    per_unit = ranked.join(medians, unit).groupBy(unit).agg(
        F.avg((F.abs(F.col("rank") - F.col("median")) <= band).cast("double")).alias("stability")
    )
    return per_unit.agg(
        F.avg("stability").alias("overall_stability"), F.min("stability").alias("min_stability"),
        F.max("stability").alias("max_stability"),
    )


def ordinal_rank(df: DataFrame, by: Sequence[str], value: str, unit: str) -> DataFrame:
    """Rank 1..n by descending value, ties by unit id.

    Ties are ranked inside their (by, value) cell, after the running count of
    larger values.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    run = running_totals(counts, value, {"_upto": "_ties"}, by, True)
    inside = F.row_number().over(Window.partitionBy(*by, value).orderBy(unit))
    return df.withColumn("_in", inside).join(run, by + [value]).withColumn(
        "rank", F.col("_upto") - F.col("_ties") + F.col("_in")
    ).drop("_in", "_upto", "_ties")


# --- cluster bootstrap ------------------------------------------------------

CI_LEVELS = (0.025, 0.975)


def _vector_sum(values: Column) -> Column:
    """Element-wise sum of array columns, combined map side."""
    return vector_to_array(Summarizer.sum(array_to_vector(values)))


def _times(vector: str, factor: str) -> Column:
    return F.transform(vector, lambda m: (m * F.col(factor)).cast("double"))


def _curve_sums(replicates: int):
    """Sums of the ROC and PR areas of each range, one row per range.

    Rows arrive by range; the first of a range holds [tp, fp, positives] before
    it, the others [n, positives] of a score, in descending order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tp = fp = positives = roc = pr = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([held], pa.int32()), pa.array([roc], pa.list_(pa.float64())), pa.array([pr], pa.list_(pa.float64()))],
                ["_range", "roc", "pr"],
            )

        for batch in batches:
            ranges = batch.column("_range").to_numpy()
            kinds = batch.column("kind").to_numpy()
            vectors, lists = batch.column("v"), np.cumsum([0, *batch.column("v").value_lengths().to_pylist()])
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (np.diff(ranges) != 0) | (kinds[1:] == 0)]) if len(ranges) else []
            for first, last in zip(starts, [*starts[1:], len(ranges)]):
                if kinds[first] == 0:
                    if held is not None:
                        yield row()
                    held = int(ranges[first])
                    tp, fp, positives = flat[lists[first] : lists[first + 1]].reshape(3, replicates).copy()
                    roc, pr = np.zeros(replicates), np.zeros(replicates)
                    first += 1
                # a few rows at a time, so that memory does not follow the batch
                for a in range(first, last, 256):
                    b = min(a + 256, last)
                    block = flat[lists[a] : lists[b]].reshape(b - a, 2, replicates)
                    pos, neg = block[:, 1], block[:, 0] - block[:, 1]
                    above, false = tp + np.cumsum(pos, axis=0), fp + np.cumsum(neg, axis=0)
                    before = above - pos
                    flagged, flagged_before = above + false, before + false - neg
                    precision = np.divide(above, flagged, out=np.ones_like(above), where=flagged > 0)
                    previous = np.divide(before, flagged_before, out=np.ones_like(above), where=flagged_before > 0)
                    step = np.divide(pos, positives, out=np.zeros_like(pos), where=positives > 0)
                    roc += (neg * (before + pos / 2.0)).sum(axis=0)
                    pr += (step * (precision + previous) / 2.0).sum(axis=0)
                    tp, fp = above[-1], false[-1]
        if held is not None:
            yield row()

    return run


def cluster_bootstrap_ci(
    df: DataFrame, unit: str = "unit", y: str = "y", p: str = "p", threshold: float = 0.5,
    n_replicates: int = 500, seed: int = 42,
) -> DataFrame:
    """95% interval of ROC-AUC, PR-AUC, recall, precision and F1.

    Whole units are resampled.  Rows are first reduced to a (unit, score)
    histogram, a unit's multiplicities are one vector with a place for each
    replicate, and vectors are summed per score with partial sums in the map
    tasks: no (replicate, score) row is shuffled.  The curves of all replicates
    are run together over ranges of scores, each beginning with the totals of
    the ranges above it.  Replicates with fewer than 10 rows or 2 positives
    are skipped.
    """
    reps = int(n_replicates)
    unit_hist = durable(metrics.score_histogram(df, y, p, by=[unit]))
    draws = draw_vectors(unit_hist, unit, reps, seed)
    ranges = _ranged(unit_hist.select("p").distinct(), ["p"])
    scaled = F.concat(_times("mult", "n"), _times("mult", "pos"))
    summed = unit_hist.join(draws, unit).groupBy("p").agg(_vector_sum(scaled).alias("v"))
    # the sums are whole numbers held as mean times weight
    hist = durable(summed.join(ranges, "p").select("_range", "p", F.transform("v", lambda x: F.rint(x)).alias("v")))

    flagged = F.when(F.col("p") >= F.lit(float(threshold)), F.col("v")).otherwise(F.array_repeat(F.lit(0.0), 2 * reps))
    totals = hist.groupBy("_range").agg(_vector_sum(F.concat("v", flagged)).alias("t"))
    parts = [F.slice("t", i * reps + 1, reps).alias(name) for i, name in enumerate(("n", "pos", "n_at", "pos_at"))]
    rows = totals.select("_range", F.posexplode(F.arrays_zip(*parts)).alias("rep", "t")).select(
        "_range", "rep", *[F.rint(f"t.{name}").alias(name) for name in ("n", "pos", "n_at", "pos_at")]
    )
    above = Window.partitionBy("rep").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole = Window.partitionBy("rep")
    rows = durable(rows.select(
        "_range", "rep", "n", "pos", "n_at", "pos_at", F.sum("pos").over(whole).alias("all"),
        F.coalesce(F.sum("pos").over(above), F.lit(0.0)).alias("tp"), F.coalesce(F.sum(F.col("n") - F.col("pos")).over(above), F.lit(0.0)).alias("fp"),
    ))
    ordered = F.array_sort(F.collect_list(F.struct("rep", "tp", "fp", "all")))
    heads = rows.groupBy("_range").agg(ordered.alias("x")).select(
        "_range", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("p"), F.concat("x.tp", "x.fp", "x.all").alias("v")
    )
    stream = heads.unionByName(hist.select("_range", F.lit(1).alias("kind"), F.col("p").cast("double").alias("p"), "v"))
    stream = stream.repartition("_range").sortWithinPartitions("_range", "kind", F.desc("p")).drop("p")
    areas = stream.mapInArrow(_curve_sums(reps), "_range int, roc array<double>, pr array<double>")
    areas = areas.select(F.posexplode(F.arrays_zip("roc", "pr")).alias("rep", "a")).groupBy("rep").agg(
        F.sum("a.roc").alias("roc"), F.sum("a.pr").alias("pr_auc")
    )
    points = rows.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "pos")], F.sum("pos_at").alias("tp"), F.sum(F.col("n_at") - F.col("pos_at")).alias("fp"))
    points = points.where("n >= 10 AND pos >= 2").withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("n") - F.col("pos") - F.col("fp"))
    names = ["roc_auc", "pr_auc", "recall", "precision", "f1_score"]
    rates = metrics.threshold_columns()
    result = points.join(areas, "rep").select(
        divide(F.col("roc"), F.col("pos") * (F.col("n") - F.col("pos"))).alias("roc_auc"), "pr_auc", *[rates[c].alias(c) for c in names[2:]]
    )
    return replicate_intervals(result, names)


def replicate_intervals(reps: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, lower, upper, n_replicates) from one row per replicate."""
    grid = F.array(*[F.lit(x) for x in CI_LEVELS])
    wide = reps.agg(F.count(F.lit(1)).alias("n_replicates"), *[F.percentile(c, grid).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c)[0].alias("lower"), F.col(c)[1].alias("upper"), F.col("n_replicates")) for c in columns]
    )
    return wide.select(F.explode(rows).alias("e")).select("e.*")


def bootstrap_r2_ci(
    df: DataFrame, unit: str = "unit", y: str = "y", y_hat: str = "y_hat", n_replicates: int = 500, seed: int = 42
) -> DataFrame:
    """95% interval of R2 under unit resampling.

    R2 depends on a unit only through four sums, so rows are reduced to one row
    per unit; a unit adds its sums times its vector of multiplicities.
    """
    t = F.col(y).cast("double")
    e = t - F.col(y_hat)
    sums = durable(
        df.groupBy(unit).agg(
            F.count(t).alias("n"), F.sum(e * e).alias("sse"), F.sum(t).alias("sy"), F.sum(t * t).alias("syy")
        )
    )
    names, reps = ["n", "sse", "sy", "syy"], int(n_replicates)
    scaled = [_times("mult", c) for c in names]
    vectors = sums.join(draw_vectors(sums, unit, reps, seed), unit).dropna(subset=names)
    total = vectors.agg(_vector_sum(F.concat(*scaled)).alias("t"))
    parts = [F.slice("t", i * reps + 1, reps).alias(c) for i, c in enumerate(names)]
    per = total.select(F.explode(F.arrays_zip(*parts)).alias("t")).select("t.*").withColumn("n", F.rint("n"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    result = per.where("n >= 10").select(F.when(sst > 0, 1.0 - divide(F.col("sse"), sst)).otherwise(0.0).alias("r_squared"))
    return replicate_intervals(result, ["r_squared"])


def prediction_distribution(df: DataFrame, p: str) -> DataFrame:
    """Mean, population sd, median and 2.5/97.5 percentiles of predictions."""
    q = exact_quantiles(df, [p], [0.5, 0.025, 0.975]).select("q")
    m = df.agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"))
    # both sides are single aggregate rows
    return m.join(F.broadcast(q), F.lit(True)).select(
        "mean", "std", F.col("q")[0].alias("median"), F.col("q")[1].alias("ci_2_5"), F.col("q")[2].alias("ci_97_5")
    )


def _dealt_join(rows: DataFrame, units: DataFrame, unit: str, n_replicates: int) -> DataFrame:
    """``rows`` with their units, in tasks that draw about ``DRAWN`` residuals each, however few bytes the rows are."""
    tasks = max(1, -(-count_rows(rows) * int(n_replicates) // DRAWN))
    return rows.repartition(tasks, unit).join(units.repartition(tasks, unit), unit)


def residual_bootstrap_intervals(
    df: DataFrame, key: str, unit: str = "unit", y: str = "y", y_hat: str = "y_hat",
    n_replicates: int = 500, seed: int = 42,
) -> DataFrame:
    """(key, y, y_hat, lower, upper): prediction interval per row.

    In each replicate a drawn unit's rows get residuals sampled with
    replacement from that unit; rows of units not drawn get residual 0.  The
    residuals of a unit (one per period of the panel) travel as an array to its
    rows, and the replicates are evaluated inside one expression per row, so
    no replicate x row table is ever shuffled.
    """
    rows = durable(
        df.select(F.col(key).alias("_key"), F.col(unit).alias("_unit"), F.col(y).cast("double").alias("_y"), F.col(y_hat).cast("double").alias("_fit"))
    )
    residuals = rows.groupBy("_unit").agg(
        F.array_sort(F.collect_list(F.struct("_key", (F.col("_y") - F.col("_fit")).alias("e")))).alias("_e")
    )
    drawn = drawn_replicates(rows, "_unit", n_replicates, seed, "_reps")
    per_unit = residuals.join(drawn, "_unit", "left").withColumn("_reps", F.coalesce("_reps", F.array().cast("array<int>")))
    reps = F.sequence(F.lit(1), F.lit(int(n_replicates)))
    hit = F.array_sort("_reps")
    picked = F.transform(
        hit, lambda r: F.element_at(F.col("_e"), (draw_index(F.size("_e"), seed, "residual", r, F.col("_key")) + 1).cast("int"))["e"]
    )
    zeros = F.array_repeat(F.lit(0.0), F.size(reps) - F.size(hit))
    values = F.array_sort(F.concat(picked, zeros))

    def quantile(q):
        pos = q * (n_replicates - 1)
        lo = int(pos)
        a = F.element_at(F.col("_v"), lo + 1)
        b = F.element_at(F.col("_v"), min(lo + 2, n_replicates))
        return a + (b - a) * F.lit(pos - lo)

    out = _dealt_join(rows, per_unit, "_unit", n_replicates).select("_key", "_y", "_fit", values.alias("_v"))
    return out.select(
        F.col("_key").alias(key), F.col("_y").alias("y"), F.col("_fit").alias("y_hat"),
        (F.col("_fit") + quantile(CI_LEVELS[0])).alias("lower"), (F.col("_fit") + quantile(CI_LEVELS[1])).alias("upper"),
    )


def residual_rank_intervals(
    df: DataFrame, key: str, unit: str = "unit", y: str = "y", y_hat: str = "y_hat",
    n_replicates: int = 500, seed: int = 42,
) -> DataFrame:
    """(key, y, y_hat, lower, upper): as ``residual_bootstrap_intervals``, for units of any size.

    A unit's residuals have slots in ascending order, so that sorted draws of
    slots are sorted draws of residuals: a row finds out by itself which slots
    its quantiles need, and only those (four a row, not one a replicate) are
    looked up by an equal join on (unit, slot).  No residuals travel in arrays,
    and lookups of one large unit spread over its slots.

    ``key`` is unique.  Rows without unit, ``y`` or ``y_hat`` take no part.
    Equal residuals share a value, so their order does not matter.
    """
    fit, truth = F.col(y_hat).cast("double"), F.col(y).cast("double")
    rows = durable(
        df.select(F.col(key).alias("_key"), F.col(unit).alias("_unit"), truth.alias("_y"), fit.alias("_fit"), (truth - fit).alias("_e"))
        .where("_unit IS NOT NULL AND _e IS NOT NULL")
    )
    ties = durable(rows.groupBy("_unit", "_e").agg(F.count(F.lit(1)).alias("_ties")))
    run = running_totals(ties, "_e", {"_upto": "_ties"}, ["_unit"])
    slots = run.select("_unit", "_e", F.explode(F.sequence(F.col("_upto") - F.col("_ties"), F.col("_upto") - 1)).alias("_slot"))
    sizes = ties.groupBy("_unit").agg(
        F.sum("_ties").alias("_n"), F.sum(F.when(F.col("_e") < 0, F.col("_ties")).otherwise(0)).alias("_negative")
    )
    drawn = drawn_replicates(sizes, "_unit", n_replicates, seed, "_reps")
    units = sizes.join(drawn, "_unit", "left").withColumn("_reps", F.coalesce("_reps", F.array().cast("array<int>")))
    picks = F.array_sort(F.transform("_reps", lambda r: draw_index(F.col("_n"), seed, "residual", r, F.col("_key"))))
    drawn_rows = _dealt_join(rows, units, "_unit", n_replicates).select("_key", "_unit", "_negative", picks.alias("_picks"))

    # replicates that miss the unit give residual 0, which stands between negative and other draws
    below, zeros = F.size(F.filter("_picks", lambda s: s < F.col("_negative"))), F.lit(int(n_replicates)) - F.size("_picks")

    def slot(rank: int) -> Column:
        at = F.when(F.lit(rank) < F.col("_below"), rank).when(F.lit(rank) >= F.col("_below") + F.col("_zeros"), F.lit(rank) - F.col("_zeros"))
        return F.when(at.isNotNull(), F.get("_picks", at))

    places = [q * (n_replicates - 1) for q in CI_LEVELS]
    ranks = [r for p in places for r in (int(p), min(int(p) + 1, n_replicates - 1))]
    asked = drawn_rows.withColumn("_below", below).withColumn("_zeros", zeros).select(
        "_key", "_unit", F.posexplode(F.array(*[slot(r) for r in ranks])).alias("_i", "_slot")
    ).where("_slot IS NOT NULL")
    found = asked.join(slots, ["_unit", "_slot"]).groupBy("_key").agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_e"))).alias(f"_e{i}") for i in range(len(ranks))]
    )

    def quantile(i: int) -> Column:
        a, b = F.coalesce(f"_e{2 * i}", F.lit(0.0)), F.coalesce(f"_e{2 * i + 1}", F.lit(0.0))
        return a + (b - a) * F.lit(places[i] - int(places[i]))

    return rows.join(found, "_key", "left").select(
        F.col("_key").alias(key), F.col("_y").alias("y"), F.col("_fit").alias("y_hat"),
        (F.col("_fit") + quantile(0)).alias("lower"), (F.col("_fit") + quantile(1)).alias("upper"),
    )


def interval_summary(intervals: DataFrame) -> DataFrame:
    """Coverage, mean and median width, mean prediction and mean truth."""
    held = durable(intervals)
    width = F.col("upper") - F.col("lower")
    median = exact_quantiles(held.select(width.alias("w")), ["w"], [0.5]).select(F.col("q")[0].alias("median_width"))
    stats = held.agg(
        F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"),
        F.avg(width).alias("mean_width"), F.avg("y_hat").alias("mean_prediction"), F.avg("y").alias("mean_true"),
    )
    return stats.join(F.broadcast(median), F.lit(True))


