"""Statistical tests on unit-level and series-level tables.

Each test reduces its input to group or cell sums with map-side combined
aggregations; the statistic is column arithmetic on those sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide, ratio
from ..functions.tails import normal_quantile, p_chi_square, p_f, p_normal, p_spearman
from ..sources.durable import durable
from .ordering import average_rank, exact_quantiles, running_totals
from .permute import permuted_cells


def _group_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"),
        F.var_pop(value).alias("vp"),
    )


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """F, degrees of freedom, sums of squares, eta squared and p."""
    g = _group_sums(df, group, value)
    grand = divide(F.sum(F.col("n") * F.col("m")), F.sum("n"))
    # between = sum n m^2 - N grand^2 is rewritten around the grand mean in a
    # second tiny aggregate to avoid cancellation.
    totals = g.agg(grand.alias("grand"), F.collect_list(F.struct("n", "m", "vp")).alias("groups"))
    ssb = F.aggregate("groups", F.lit(0.0), lambda a, x: a + x["n"] * (x["m"] - F.col("grand")) * (x["m"] - F.col("grand")))
    ssw = F.aggregate("groups", F.lit(0.0), lambda a, x: a + x["n"] * x["vp"])
    n = F.aggregate("groups", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    base = totals.select(ssb.alias("ss_between"), ssw.alias("ss_residual"), n.alias("n"), F.size("groups").alias("k"))
    stats = base.select(
        "n", F.col("k").alias("n_groups"), (F.col("k") - 1).alias("df_between"),
        (F.col("n") - F.col("k")).alias("df_residual"), "ss_between", "ss_residual",
    )
    f = divide(divide(F.col("ss_between"), F.col("df_between")), divide(F.col("ss_residual"), F.col("df_residual")))
    stats = stats.withColumn("f_statistic", f)
    return stats.withColumns(
        {
            "eta_squared": ratio(F.col("ss_between"), F.col("ss_between") + F.col("ss_residual")),
            "p_value": p_f(F.col("f_statistic"), F.col("df_between"), F.col("df_residual")),
        }
    )


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Equal-variance test: one-way F of absolute deviations from group medians."""
    medians = exact_quantiles(df, [value], [0.5], by=[group]).select(group, F.col("q")[0].alias("_median"))
    # equi-join on the group label; one row per group on the right
    deviations = df.join(medians, group).select(group, F.abs(F.col(value) - F.col("_median")).alias("_dev"))
    return anova_oneway(deviations, group, "_dev").withColumnRenamed("f_statistic", "w_statistic")


def anova_welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """Unequal-variance F over group moments."""
    g = _group_sums(df, group, value).withColumn("w", divide(F.col("n"), F.col("v")))
    t = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("w").alias("sw"),
        divide(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("mw"),
        F.collect_list(F.struct("n", "m", "w")).alias("groups"),
    )
    between = F.aggregate("groups", F.lit(0.0), lambda a, x: a + x["w"] * (x["m"] - F.col("mw")) * (x["m"] - F.col("mw")))
    lack = F.aggregate(
        "groups", F.lit(0.0),
        lambda a, x: a + divide((1 - x["w"] / F.col("sw")) * (1 - x["w"] / F.col("sw")), x["n"] - 1),
    )
    k = F.col("k")
    out = t.select(k, between.alias("between"), lack.alias("lack"))
    f = divide(divide(F.col("between"), k - 1), 1 + divide(2 * (k - 2) * F.col("lack"), k * k - 1))
    out = out.select(f.alias("f_statistic"), (k - 1).alias("df_num"), divide(k * k - 1, 3 * F.col("lack")).alias("df_denom"))
    return out.withColumn("p_value", p_f(F.col("f_statistic"), F.col("df_num"), F.col("df_denom")))


# --- contingency tables -----------------------------------------------------


def effect_label(v: Column) -> Column:
    return (
        F.when(v < 0.10, "negligible").when(v < 0.30, "small to moderate")
        .when(v < 0.50, "moderate to large").otherwise("large")
    )


def _cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Non-empty cells with their margins.  Sizes are label counts, not rows."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("_o"))
    everything = Window.partitionBy()  # one row per non-empty cell
    return n.select(
        row, column, "_o",
        F.sum("_o").over(Window.partitionBy(row)).alias("_r"),
        F.sum("_o").over(Window.partitionBy(column)).alias("_c"),
        F.sum("_o").over(everything).alias("_n"),
    )


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square, dof, expected-count diagnostics, Cramer's V and its label.

    chi2 = n (sum o^2 / (r c) - 1) needs only non-empty cells.  The expected
    counts of all cells follow from the margins.
    """
    cells = _cells(df, row, column)
    stat = cells.agg(
        F.max("_n").alias("n"),
        (F.max("_n") * (F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))) - 1)).alias("chi2"),
        F.collect_set(F.struct(F.col(row).alias("label"), F.col("_r").alias("m"))).alias("rows"),
        F.collect_set(F.struct(F.col(column).alias("label"), F.col("_c").alias("m"))).alias("cols"),
    )
    r, c = F.size("rows"), F.size("cols")
    expected = F.flatten(
        F.transform("rows", lambda x: F.transform("cols", lambda y: x["m"] * y["m"] / F.col("n")))
    )
    out = stat.select(
        "n", "chi2", ((r - 1) * (c - 1)).alias("dof"), F.least(r, c).alias("k"), expected.alias("e")
    )
    small = F.size(F.filter("e", lambda x: x < 5))
    out = out.select(
        F.col("n").alias("n_observations"), "chi2", "dof",
        F.array_min("e").alias("min_expected"),
        divide(F.lit(100.0) * small, F.size("e")).alias("pct_cells_below_5"),
        F.when(F.col("k") > 1, F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1)))).otherwise(0.0).alias("cramers_v"),
    )
    return out.withColumns(
        {"effect": effect_label(F.col("cramers_v")), "p_value": p_chi_square(F.col("chi2"), F.col("dof"))}
    )


def chi_square_permutation(
    df: DataFrame, unit: str, row: str, column: str, replicates: int = 9999, seed: int = 42, digits: int = 9
) -> DataFrame:
    """Permutation p of chi-square: categories are shuffled across units.

    Margins do not change under permutation, so each replicate needs only the
    sum of o^2 / (r c) over its cells.  Statistics are rounded to ``digits``
    before comparing, because equal tables may sum in a different order.
    """
    df = durable(df.select(unit, row, column))
    observed = _cells(df, row, column)
    margins_r = observed.groupBy(row).agg(F.max("_r").alias("_r"))
    margins_c = observed.groupBy(column).agg(F.max("_c").alias("_c"))
    obs = chi_square(df, row, column).select(
        F.round("chi2", digits).alias("chi2_observed"), F.col("n_observations").alias("n")
    ).first()
    cells = permuted_cells(df, unit, row, column, replicates, seed)
    # one row per row label / column label on the right-hand sides
    scored = cells.join(margins_r, row).join(margins_c, column)
    per_rep = scored.groupBy("rep").agg(
        F.round(F.lit(obs["n"]) * (F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))) - 1), digits).alias("chi2")
    )
    return per_rep.agg(
        F.lit(obs["chi2_observed"]).alias("chi2_observed"),
        F.count(F.lit(1)).alias("n_permutations"),
        F.count_if(F.col("chi2") >= F.lit(obs["chi2_observed"])).alias("n_as_large"),
    ).withColumn("p_value", (F.col("n_as_large") + 1) / (F.col("n_permutations") + 1))


# --- trend ------------------------------------------------------------------


def _series(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """One array of (t, x) per series, sorted by time.

    A series has one value per calendar period (years or months), so the array
    is bounded by the calendar, not by the data size; callers aggregate to one
    row per (series, period) first.
    """
    points = F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("x"))))
    return df.groupBy(*by).agg(points.alias("_p")).withColumn("n", F.size("_p"))


def _later(i) -> Column:
    return F.slice("_p", i + 2, F.size("_p"))


def pair_counts(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Rising, falling and tied pairs i < j per series.

    Counted inside one expression per series; pairs are never emitted as rows.
    """
    def count(compare):
        return F.aggregate(
            F.transform("_p", lambda a, i: F.size(F.filter(_later(i), lambda b: compare(a["x"], b["x"])))),
            F.lit(0).cast("bigint"), lambda acc, k: acc + k,
        )

    s = _series(df, by, time, value)
    return s.select(
        *by, "n",
        count(lambda a, b: b > a).alias("n_rising"),
        count(lambda a, b: b < a).alias("n_falling"),
        count(lambda a, b: b == a).alias("n_tied"),
        "_p",
    )


def mann_kendall(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """S, tau, tie-adjusted variance, z, two-sided p, direction and Sen slope."""
    counts = pair_counts(df, by, time, value)
    xs = F.transform("_p", lambda a: a["x"])
    tie_sizes = F.transform(F.array_distinct(xs), lambda u: F.size(F.filter(xs, lambda x: x == u)))
    tie_sum = F.aggregate(tie_sizes, F.lit(0.0), lambda acc, t: acc + t * (t - 1) * (2 * t + 5))
    n = F.col("n")
    out = counts.select(
        *by, "n", (F.col("n_rising") - F.col("n_falling")).alias("s"),
        ((n * (n - 1) * (2 * n + 5) - tie_sum) / F.lit(18.0)).alias("var_s"),
        _sen_slope().alias("sens_slope"),
    )
    s, sd = F.col("s"), F.sqrt("var_s")
    z = F.when((s > 0) & (F.col("var_s") > 0), divide(s - 1, sd)).when((s < 0) & (F.col("var_s") > 0), divide(s + 1, sd)).otherwise(0.0)
    return out.withColumns(
        {
            "tau": ratio(s, n * (n - 1) / 2),
            "z": z,
            "direction": F.when(s > 0, "increasing").when(s < 0, "decreasing").otherwise("no trend"),
        }
    ).withColumn("p_value", p_normal(F.col("z")))


def _sen_slope() -> Column:
    slopes = F.array_sort(
        F.flatten(
            F.transform("_p", lambda a, i: F.transform(_later(i), lambda b: divide(b["x"] - a["x"], b["t"] - a["t"])))
        )
    )
    m = F.size(slopes)
    low, high = F.floor((m + 1) / 2).cast("int"), F.floor((m + 2) / 2).cast("int")
    return F.when(m > 0, (F.element_at(slopes, low) + F.element_at(slopes, high)) / 2)


def sens_slope(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Median of the slopes between all pairs of a series."""
    return _series(df, by, time, value).select(*by, "n", _sen_slope().alias("sens_slope"))


# --- correlation and regression --------------------------------------------


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks, with its t-approximation p."""
    slim = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_rank(slim, "_x", output="_rx")
    ranked = average_rank(ranked, "_y", output="_ry")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))
    return out.withColumn("p_value", p_spearman(F.col("rho"), F.col("n")))


def _moment_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Count and cross-product matrix of (1, columns): p x p scalars."""
    names = ["_one", *columns]
    wide = df.select(F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in columns])
    row = wide.agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    ).first()
    size = len(names)
    m = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = row[f"{i}_{j}"]
    return int(round(m[0, 0])), m


def ols_cluster_robust(df: DataFrame, y: str, predictors: Sequence[str], cluster: str) -> DataFrame:
    """OLS with cluster-sandwich standard errors and normal p-values.

    Spark sums the cross products and the per-cluster scores; only p x p
    matrices reach the driver.  Predictors are centred and scaled before
    forming cross products so the small solve is well conditioned.
    """
    data = df.dropna(subset=[y, *predictors])
    centre = data.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(predictors)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(predictors)],
    ).first()
    means = [centre[f"m{i}"] for i in range(len(predictors))]
    sds = [centre[f"s{i}"] or 1.0 for i in range(len(predictors))]
    z = [f"_z{i}" for i in range(len(predictors))]
    std = data.select(
        cluster, F.col(y).cast("double").alias("_y"),
        *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(n) for c, m, s, n in zip(predictors, means, sds, z)],
    )
    n, m = _moment_matrix(std, [*z, "_y"])
    p = len(predictors) + 1
    xtx, xty, yty = m[:p, :p], m[:p, p], m[p, p]
    inv = np.linalg.inv(xtx)
    beta = inv @ xty

    fitted = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], z):
        fitted = fitted + F.lit(float(b)) * F.col(c)
    residual = F.col("_y") - fitted
    names = ["_one", *z]
    # score sums per cluster: partial sums combine map side, so a cluster with
    # a third of the rows costs no more than a small one
    scores = std.withColumn("_one", F.lit(1.0)).withColumn("_e", residual).groupBy(cluster).agg(
        *[F.sum(F.col("_e") * F.col(c)).alias(f"u{i}") for i, c in enumerate(names)],
        F.sum(F.col("_e") * F.col("_e")).alias("sse"),
    )
    meat_row = scores.agg(
        F.count(F.lit(1)).alias("g"), F.sum("sse").alias("sse"),
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"{i}_{j}") for i in range(p) for j in range(i, p)],
    ).first()
    meat = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            meat[i, j] = meat[j, i] = meat_row[f"{i}_{j}"]
    g, sse = meat_row["g"], meat_row["sse"]
    cov = inv @ meat @ inv * (g / (g - 1.0)) * ((n - 1.0) / (n - p))
    # back to the original scale
    back = np.eye(p)
    for i in range(1, p):
        back[i, i] = 1.0 / sds[i - 1]
        back[0, i] = -means[i - 1] / sds[i - 1]
    coef, cov = back @ beta, back @ cov @ back.T
    se = np.sqrt(np.diag(cov))
    sst = yty - m[0, p] ** 2 / n
    r2 = 1.0 - sse / sst
    wald = coef[1:] @ np.linalg.solve(cov[1:, 1:], coef[1:]) / (p - 1)
    spark = df.sparkSession
    rows = [
        (name, float(b), float(s), float(b / s), int(n), int(g), float(r2),
         float(1 - (1 - r2) * (n - 1) / (n - p)), float(wald), int(p - 1))
        for name, b, s in zip(["Intercept", *predictors], coef, se)
    ]
    out = spark.createDataFrame(
        rows,
        "term string, coefficient double, std_error double, z double, n bigint, n_clusters bigint, "
        "r_squared double, adj_r_squared double, f_statistic double, df_model bigint",
    )
    z975 = F.lit(normal_quantile(0.975))
    return out.withColumns(
        {
            "ci_lower": F.col("coefficient") - z975 * F.col("std_error"),
            "ci_upper": F.col("coefficient") + z975 * F.col("std_error"),
            "p_value": p_normal(F.col("z")),
        }
    )


def vif(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Variance inflation per predictor: diagonal of the inverse correlation matrix."""
    predictors = list(predictors)
    pairs = [(i, j) for i in range(len(predictors)) for j in range(i + 1, len(predictors))]
    data = df.dropna(subset=predictors)
    row = data.agg(*[F.corr(predictors[i], predictors[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(predictors))
    for i, j in pairs:
        r[i, j] = r[j, i] = row[f"{i}_{j}"]
    diagonal = np.diag(np.linalg.inv(r))
    return df.sparkSession.createDataFrame(
        [(c, float(d)) for c, d in zip(predictors, diagonal)], "predictor string, vif double"
    )


# --- residual diagnostics ---------------------------------------------------


def residual_shape(df: DataFrame, residual: Column) -> DataFrame:
    """Skewness, excess kurtosis (population) and the Jarque-Bera test."""
    out = df.select(residual.cast("double").alias("e")).agg(
        F.count("e").alias("n"), F.skewness("e").alias("skewness"), F.kurtosis("e").alias("kurtosis")
    )
    jb = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return out.withColumn("jarque_bera", jb).withColumn("p_value", p_chi_square(F.col("jarque_bera"), F.lit(2)))


def ks_normal(df: DataFrame, residual: Column) -> DataFrame:
    """Kolmogorov-Smirnov test of standardised residuals against N(0, 1)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    e = df.select(residual.cast("double").alias("e")).where("e IS NOT NULL")
    mean, sd = e.agg(F.avg("e"), F.stddev_samp("e")).first()
    return KolmogorovSmirnovTest.test(e.select(((F.col("e") - mean) / sd).alias("z")), "z", "norm", 0.0, 1.0)


# P of the corrected statistic, mean and deviation estimated (Stephens 1986):
# (from, constant, linear, quadratic, whether the exponential is 1 - p).
ANDERSON = (
    (0.6, 1.2937, -5.709, 0.0186, False),
    (0.34, 0.9177, -4.279, -1.38, False),
    (0.2, -8.318, 42.796, -59.938, True),
    (float("-inf"), -13.436, 101.14, -223.73, True),
)


def anderson_darling(df: DataFrame, residual: Column) -> DataFrame:
    """n, A squared, corrected A squared and p: normality with estimated mean and deviation.

    Value number i of n adds (2 i - 1) ln F + (2 (n - i) + 1) ln(1 - F).  Equal
    values are counted first and their numbers summed in closed form, so ranks
    are running totals over distinct values and nothing is sorted in one task.

    Nulls and NaN take no part.  Without spread the statistic is null; below
    eight values p is null, as the approximation starts there.
    """
    e = df.select(residual.cast("double").alias("e")).where("e IS NOT NULL AND NOT isnan(e)")
    counts = durable(e.groupBy("e").agg(F.count(F.lit(1)).alias("_ties")))
    n, total = counts.agg(F.coalesce(F.sum("_ties"), F.lit(0)), F.sum(F.col("e") * F.col("_ties"))).first()
    mean = total / n if n else 0.0
    square = counts.agg(F.sum(F.col("_ties") * F.pow(F.col("e") - F.lit(mean), F.lit(2.0)))).first()[0]
    sd = math.sqrt(square / (n - 1)) if n > 1 else 0.0
    z = (F.col("e") - F.lit(mean)) / F.lit(sd or 1.0)
    run = running_totals(counts, "e", {"_upto": "_ties"}).select(
        z.alias("_z"), F.col("_upto").cast("double").alias("_b"), (F.col("_upto") - F.col("_ties")).cast("double").alias("_a")
    ).withColumn("_tail", p_normal(F.col("_z")) / 2.0)
    near, far = F.log(F.greatest(F.col("_tail"), F.lit(1e-300))), F.log1p(-F.col("_tail"))
    low = F.when(F.col("_z") < 0, near).otherwise(far)
    high = F.when(F.col("_z") < 0, far).otherwise(near)
    up = F.col("_b") * F.col("_b") - F.col("_a") * F.col("_a")
    down = F.pow(F.lit(n) - F.col("_a"), F.lit(2.0)) - F.pow(F.lit(n) - F.col("_b"), F.lit(2.0))
    out = run.agg(F.sum(up * low + down * high).alias("_s")).select(
        F.lit(n).cast("long").alias("n"), (F.when(F.lit(sd > 0), -F.lit(n) - F.col("_s") / F.lit(float(max(n, 1))))).alias("a_squared")
    )
    corrected = F.col("a_squared") * F.lit(1.0 + 0.75 / max(n, 1) + 2.25 / max(n, 1) ** 2)
    a = F.when(F.col("a_corrected") > 13.0, 13.0).otherwise(F.col("a_corrected"))  # p is below 1e-25 there
    p = F.lit(None).cast("double")
    for start, constant, linear, quadratic, rest in reversed(ANDERSON):
        value = F.exp(F.lit(constant) + F.lit(linear) * a + F.lit(quadratic) * a * a)
        p = F.when(a >= F.lit(start), 1.0 - value if rest else value).otherwise(p)
    return out.withColumn("a_corrected", corrected).withColumn("p_value", F.when(F.lit(n >= 8), p))


def heteroscedasticity(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """Spearman correlation of the prediction with the absolute residual."""
    pairs = df.select(F.col(y_hat).alias("_fit"), F.abs(F.col(y) - F.col(y_hat)).alias("_abs"))
    return spearman(pairs, "_fit", "_abs")


def influence_count(df: DataFrame, y: str, y_hat: str, n_predictors: int = 30) -> DataFrame:
    """Rows whose approximate Cook distance exceeds 4 / n.

    (residual / RMSE)^2 / p > 4 / n; RMSE and n are two scalars of a first pass.
    """
    e = df.select((F.col(y) - F.col(y_hat)).cast("double").alias("e")).where("e IS NOT NULL")
    n, mse = e.agg(F.count("e"), F.avg(F.col("e") * F.col("e"))).first()
    scaled = F.col("e") / (F.sqrt(F.lit(mse or 0.0)) + F.lit(1e-10))
    over = (scaled * scaled) / F.lit(float(n_predictors)) > F.lit(4.0) / F.lit(float(max(n, 1)))
    out = e.agg(F.count("e").alias("n_observations"), F.count_if(over).alias("n_influential"))
    return out.withColumn("pct_influential", F.lit(100.0) * ratio(F.col("n_influential"), F.col("n_observations")))


def qq_points(df: DataFrame, residual: Column, points: int = 99) -> DataFrame:
    """Residual quantiles against normal quantiles on an even grid."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    e = df.select(residual.cast("double").alias("e"))
    grid = exact_quantiles(e, ["e"], probs)
    theory = F.array(*[F.lit(normal_quantile(p)) for p in probs])
    levels = F.array(*[F.lit(p) for p in probs])
    return grid.select(F.explode(F.arrays_zip(levels.alias("prob"), theory.alias("theoretical"), F.col("q").alias("sample"))).alias("r")).select("r.*")


def residual_percentiles(df: DataFrame, residual: Column) -> DataFrame:
    """p1, p5, p25, p50, p75, p95, p99 of the residual."""
    levels = [1, 5, 25, 50, 75, 95, 99]
    e = df.select(residual.cast("double").alias("e"))
    q = exact_quantiles(e, ["e"], [p / 100 for p in levels])
    return q.select(*[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(levels)])
