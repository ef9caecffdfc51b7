"""Evaluation metrics of scored rows (y, p[, weight][, by]).

All curve metrics start from a score histogram: one row per distinct score
with its weight and positive weight.  Rows are combined map side, so the
shuffle carries distinct scores, not rows; running totals over the histogram
use ``ordering.running_totals``, which never sorts a large histogram in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide, ratio
from .ordering import exact_quantiles, running_totals


def score_histogram(
    df: DataFrame, y: str = "y", p: str = "p", weight: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by, p, n, pos): weight and positive weight per distinct score."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, p).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col(y) == 1, w).otherwise(w * 0)).alias("pos")
    ).withColumnRenamed(p, "p")


def cumulative_confusion(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """TP and FP when everything scored >= p is flagged, with class totals."""
    by = list(by)
    h = hist.withColumn("neg", F.col("n") - F.col("pos"))
    run = running_totals(h, "p", {"tp": "pos", "fp": "neg"}, by, descending=True)
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("total_pos"), (F.sum("n") - F.sum("pos")).alias("total_neg"))
    if by:
        return run.join(totals, by)
    # the right side is a single aggregate row
    return run.join(F.broadcast(totals), F.lit(True))


def roc_curve(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = cumulative_confusion(hist, by)
    return c.select(*by, F.col("p").alias("threshold"), ratio(F.col("fp"), F.col("total_neg")).alias("fpr"), ratio(F.col("tp"), F.col("total_pos")).alias("tpr"))


def pr_curve(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per distinct score, plus the point (recall 0, precision 1)."""
    by = list(by)
    c = cumulative_confusion(hist, by)
    points = c.select(
        *by, F.col("p").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("total_pos"), empty=1.0).alias("recall"),
    )
    keys = hist.select(*by).distinct() if by else hist.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    final = keys.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(final)


def curve_areas(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties half), trapezoid PR-AUC and average precision in one pass.

    Each histogram row knows its running totals and its own counts, so the
    previous curve point is the difference and no lag over the curve is needed.
    The PR curve starts at (recall 0, precision 1).
    """
    by = list(by)
    c = cumulative_confusion(hist, by)
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    neg = F.col("neg")
    p_total, n_total = F.col("total_pos"), F.col("total_neg")
    before = tp - pos
    flagged_before = before + fp - neg
    precision = divide(tp, tp + fp)
    previous = F.when(flagged_before > 0, divide(before, flagged_before)).otherwise(F.lit(1.0))
    step = divide(pos, p_total)
    return c.groupBy(*by).agg(
        divide(F.sum(neg * (before + pos / 2.0)), F.max(p_total).cast("double") * F.max(n_total)).alias("roc_auc"),
        F.sum(step * (precision + previous) / 2.0).alias("pr_auc"),
        F.sum(step * precision).alias("average_precision"),
    )


def roc_auc(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_areas(hist, by).select(*by, "roc_auc")


def confusion_counts(hist: DataFrame, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN at score >= threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged = F.col("p") >= t
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    zero = pos * 0
    return hist.groupBy(*by).agg(
        F.sum(F.when(flagged, pos).otherwise(zero)).alias("tp"), F.sum(F.when(flagged, neg).otherwise(zero)).alias("fp"),
        F.sum(F.when(flagged, zero).otherwise(pos)).alias("fn"), F.sum(F.when(flagged, zero).otherwise(neg)).alias("tn"),
    )


def threshold_columns() -> dict[str, Column]:
    """Metrics of a row holding tp, fp, fn, tn; 0 when a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2.0,
        "f1_score": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "f2_score": ratio(5.0 * precision * recall, 4.0 * precision + recall),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "false_discovery_rate": ratio(fp, tp + fp),
    }


def threshold_metrics(hist: DataFrame, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    return confusion_counts(hist, threshold, by).select("*", *[c.alias(n) for n, c in threshold_columns().items()])


def brier(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, null Brier pi (1 - pi), skill and its band."""
    p = F.col("p")
    pos, n = F.col("pos"), F.col("n")
    out = hist.groupBy(*by).agg(
        (F.sum(pos * (p - 1.0) * (p - 1.0) + (n - pos) * p * p) / F.sum("n")).alias("brier"),
        (F.sum("pos") / F.sum("n")).alias("prevalence"),
    )
    out = out.withColumn("brier_null", F.col("prevalence") * (1.0 - F.col("prevalence")))
    skill = F.when(F.col("brier_null") > 0, 1.0 - divide(F.col("brier"), F.col("brier_null"))).otherwise(0.0)
    return out.withColumn("brier_skill", skill).withColumn(
        "band",
        F.when(F.col("brier_skill") < 0.10, "weak (<0.10)").when(F.col("brier_skill") < 0.25, "marginal (0.10-0.25)")
        .otherwise("skillful (>=0.25)"),
    )


def bin_edges(n_bins: int = 10) -> list[float]:
    """Even edges of [0, 1] as the doubles i * (1 / n)."""
    return np.linspace(0.0, 1.0, n_bins + 1).tolist()


def _bin_of(p: Column, n_bins: int, right_closed: bool) -> Column:
    """Bin 0..n-1 by comparing with the edges.

    Right-closed bins are (lo, hi] with 0 in the first; otherwise [lo, hi),
    and a score of 1.0 falls in no bin (NULL).
    """
    edges = bin_edges(n_bins)
    out = None
    for i in range(n_bins):
        if right_closed:
            inside = p <= edges[i + 1]  # earlier bins took the smaller scores
        else:
            inside = (p >= edges[i]) & (p < edges[i + 1])
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def reliability_curve(hist: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and positive share per non-empty uniform bin (lo, hi]."""
    binned = hist.withColumn("bin", _bin_of(F.col("p"), n_bins, True)).where(F.col("bin").isNotNull())
    return binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("pos") / F.sum("n")).alias("fraction_positive"),
    )


def ece(hist: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over [lo, hi) bins; a score of 1.0 is in none."""
    by = list(by)
    binned = hist.withColumn("bin", _bin_of(F.col("p"), n_bins, False))
    bins = binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("sp"), F.sum("pos").alias("pos")
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("pos"))).otherwise(0.0)
    return bins.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def optimal_threshold(
    hist: DataFrame, target_recall: float = 0.75, by: Sequence[str] = ()
) -> DataFrame:
    """Threshold of highest precision among points with recall >= target.

    Equal precision gives the lowest threshold.  The end point (precision 1,
    recall 0) takes part only if no point reaches the target; it means 0.50.
    """
    by = list(by)
    curve = pr_curve(hist, by)
    ok = F.col("recall") >= target_recall
    low_first = F.coalesce(-F.col("threshold"), F.lit(float("-inf")))
    best = F.max_by(
        F.struct(F.coalesce(F.col("threshold"), F.lit(0.5)).alias("threshold"), "precision", "recall"),
        F.struct(ok, F.when(ok, F.col("precision")).otherwise(F.col("recall")), low_first),
    )
    out = curve.groupBy(*by) if by else curve
    return out.agg(best.alias("b")).select(*by, "b.threshold", "b.precision", "b.recall")


def _threshold_table(hist: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """TP, FP, FN and totals for every threshold.

    Each distinct score is mapped to the last threshold it passes (a bounded
    index), summed per index, and accumulated inside one array expression: no
    join of scores with thresholds.
    """
    by = list(by)
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = F.size(F.filter(grid, lambda t: t <= F.col("p")))
    per = hist.withColumn("k", passed).groupBy(*by, "k").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # at most len(thresholds) + 1 rows per group
    packed = per.groupBy(*by).agg(
        F.collect_list(F.struct("k", "pos", "n")).alias("cells"), F.sum("pos").alias("total_pos"), F.sum("n").alias("total")
    )
    idx = F.posexplode(grid).alias("i", "threshold")

    def above(field):
        return F.aggregate(
            F.filter("cells", lambda c: c["k"] > F.col("i")), F.lit(0.0), lambda a, c: a + c[field].cast("double")
        )

    return packed.select(*by, "cells", "total_pos", "total", idx).select(
        *by, "threshold", "total_pos", "total", above("pos").alias("tp"), (above("n") - above("pos")).alias("fp")
    )


def decision_thresholds() -> list[float]:
    """0.01 ... 0.98."""
    return np.arange(0.01, 0.99, 0.01).tolist()


def decision_curve(hist: DataFrame, thresholds: Sequence[float] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none."""
    t = _threshold_table(hist, thresholds or decision_thresholds(), by)
    odds = F.when(F.col("threshold") < 1.0, divide(F.col("threshold"), 1.0 - F.col("threshold")))
    prevalence = F.col("total_pos") / F.col("total")
    model = F.coalesce(F.col("tp") / F.col("total") - F.col("fp") / F.col("total") * odds, F.lit(0.0))
    treat_all = F.coalesce(prevalence - (1.0 - prevalence) * odds, F.lit(0.0))
    out = t.select(
        *by, "threshold", F.round(model, 6).alias("model_net_benefit"), F.round(treat_all, 6).alias("treat_all"),
        F.lit(0.0).alias("treat_none"), F.round(prevalence, 4).alias("prevalence"),
    )
    useful = (F.col("model_net_benefit") > F.col("treat_all")) & (F.col("model_net_benefit") > 0)
    return out.withColumn("is_useful", useful)


def useful_range(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last useful threshold and how many are useful."""
    t = F.when(F.col("is_useful"), F.col("threshold"))
    return curve.groupBy(*by).agg(
        F.round(F.min(t), 2).alias("min_threshold"), F.round(F.max(t), 2).alias("max_threshold"),
        F.count(t).alias("n_thresholds"), F.max("prevalence").alias("prevalence"),
    )


def cost_thresholds() -> list[float]:
    """0.05 ... 0.94."""
    return np.arange(0.05, 0.95, 0.01).tolist()


def cost_curve(
    hist: DataFrame, thresholds: Sequence[float] | None = None, cost_fp: float = 1.0, cost_fn: float = 100.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Expected cost per row at each threshold; the first minimum is flagged."""
    t = _threshold_table(hist, thresholds or cost_thresholds(), by)
    cost = (F.col("fp") * cost_fp + (F.col("total_pos") - F.col("tp")) * cost_fn) / F.col("total")
    out = t.select(*by, "threshold", F.round(cost, 4).alias("expected_cost"))
    # one row per threshold and group
    best = F.row_number().over(Window.partitionBy(*by).orderBy("expected_cost", "threshold")) == 1
    return out.withColumn("is_optimal", best)


def regression_metrics(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """MAE, RMSE, R2 (0 if constant y), MdAPE% on y > 0.1, mean and population sd of y."""
    t, e = F.col(y).cast("double"), (F.col(y) - F.col(y_hat)).cast("double")
    sums = df.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("sse"), (F.count(t) * F.var_pop(t)).alias("sst"),
        F.avg(t).alias("mean_y"), F.stddev_pop(t).alias("std_y"), F.count(t).alias("n"),
    )
    ape = df.where(t > 0.1).select(F.abs(e / t).alias("ape"))
    median = exact_quantiles(ape, ["ape"], [0.5]).select((F.col("q")[0] * 100.0).alias("mdape"))
    r2 = F.when(F.col("sst") > 0, 1.0 - divide(F.col("sse"), F.col("sst"))).otherwise(0.0)
    # both sides are single aggregate rows
    return sums.join(F.broadcast(median), F.lit(True), "left").select(
        "n", "mae", "rmse", r2.alias("r_squared"), F.coalesce("mdape", F.lit(0.0)).alias("mdape"), "mean_y", "std_y"
    )


def weighted_r2(df: DataFrame, y: str, y_hat: str, weight: str, by: Sequence[str]) -> DataFrame:
    """R2 per group from weighted sums, with the weighted row count."""
    w, t = F.col(weight).cast("double"), F.col(y).cast("double")
    e = t - F.col(y_hat)
    out = df.groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * e * e).alias("sse"), F.sum(w * t).alias("sy"), F.sum(w * t * t).alias("syy")
    )
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return out.select(*by, "n", F.when(sst > 0, 1.0 - divide(F.col("sse"), sst)).otherwise(0.0).alias("r_squared"))


def classification_report(
    hist: DataFrame, threshold: Column | float, by: Sequence[str] = ()
) -> DataFrame:
    """All threshold, curve and calibration metrics of one or more models."""
    by = list(by)
    parts = [
        threshold_metrics(hist, threshold, by),
        curve_areas(hist, by),
        brier(hist, by).select(*by, F.col("brier").alias("brier_score")),
        ece(hist, by=by),
    ]
    out = parts[0]
    for part in parts[1:]:
        # one row per model (or one row in all) on either side
        out = out.join(part, by) if by else out.join(F.broadcast(part), F.lit(True))
    return out


def select_model(
    report: DataFrame, model: str = "model", score: str = "pr_auc",
    preferred: str | None = None, rival: str | None = None, margin: float = 0.01,
) -> DataFrame:
    """Add ``is_winner``: best score, but ``preferred`` when it is within
    ``margin`` of ``rival``."""
    everything = Window.partitionBy()  # one row per model
    best = F.max_by(model, F.struct(F.col(score), F.col(model))).over(everything)
    if preferred and rival:
        a = F.max(F.when(F.col(model) == preferred, F.col(score))).over(everything)
        b = F.max(F.when(F.col(model) == rival, F.col(score))).over(everything)
        best = F.when(F.abs(a - b) <= margin, F.lit(preferred)).otherwise(best)
    return report.withColumn("is_winner", F.col(model) == best)


def calibration_comparison(
    df: DataFrame, y: str, before: str, after: str, n_bins: int = 10
) -> DataFrame:
    """Brier and ECE before and after recalibration, and the improvements."""
    frames = []
    for label, column in (("original", before), ("calibrated", after)):
        frames.append(df.select(F.lit(label).alias("version"), F.col(y).alias("y"), F.col(column).alias("p")))
    hist = score_histogram(frames[0].unionByName(frames[1]), by=["version"])
    both = brier(hist, ["version"]).select("version", "brier").join(ece(hist, n_bins, ["version"]), "version")
    pick = {
        f"{m}_{v}": F.max(F.when(F.col("version") == v, F.col(m))) for m in ("brier", "ece") for v in ("original", "calibrated")
    }
    wide = both.agg(*[c.alias(n) for n, c in pick.items()])
    return wide.select(
        "*",
        (F.col("brier_original") - F.col("brier_calibrated")).alias("brier_improvement"),
        (F.col("ece_original") - F.col("ece_calibrated")).alias("ece_improvement"),
    )
