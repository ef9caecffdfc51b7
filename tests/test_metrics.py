import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import metrics as m
from panelscope.operators import uncertainty as unc

RNG = np.random.default_rng(5)


def frame(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


@pytest.fixture(scope="module")
def scored(spark):
    y = (RNG.uniform(size=500) < 0.15).astype(int)
    return frame(spark, y, np.clip(0.5 * y + RNG.uniform(0, 0.5, 500), 0, 1).round(3))


def test_perfect_constant_and_reverse(spark):
    y = [0] * 10 + [1] * 5
    area = lambda p: m.curve_areas(m.score_histogram(frame(spark, y, p))).first()
    assert area([0.1] * 10 + [0.9] * 5)["roc_auc"] == 1.0
    assert area([0.1] * 10 + [0.9] * 5)["pr_auc"] == pytest.approx(1.0)
    assert area([0.4] * 15)["roc_auc"] == 0.5
    assert area([0.9] * 10 + [0.1] * 5)["roc_auc"] == 0.0


def test_auc_equals_pair_share(spark, scored):
    rows = scored.collect()
    pos = np.array([r["p"] for r in rows if r["y"] == 1])
    neg = np.array([r["p"] for r in rows if r["y"] == 0])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert m.roc_auc(m.score_histogram(scored)).first()["roc_auc"] == pytest.approx(want)


def test_single_class_and_empty(spark):
    only = m.score_histogram(frame(spark, [0, 0], [0.2, 0.7]))
    assert m.curve_areas(only).first()["roc_auc"] is None
    row = m.threshold_metrics(only, 0.5).first()
    assert row["precision"] == 0.0 and row["recall"] == 0.0 and row["mcc"] == 0.0
    empty = m.score_histogram(spark.createDataFrame([], "y int, p double"))
    assert m.pr_curve(empty).count() == 0
    nulls = m.score_histogram(spark.createDataFrame([(None, 0.5), (1, None)], "y int, p double"))
    assert nulls.count() == 0


def test_score_of_one_is_in_no_calibration_bin(spark):
    hist = m.score_histogram(frame(spark, [0, 0], [1.0, 1.0]))
    assert m.ece(hist).first()["ece"] == 0.0
    assert m.reliability_curve(hist).first()["bin"] == 9
    edges = m.score_histogram(frame(spark, [1, 1, 1], [0.3, 0.6, 0.7]))
    want = sum(abs(p - 1) for p in (0.3, 0.6, 0.7)) / 3
    assert m.ece(edges).first()["ece"] == pytest.approx(want)


def test_threshold_rules(spark, scored):
    hist = m.score_histogram(scored)
    best = m.optimal_threshold(hist, 0.75).first()
    assert best["recall"] >= 0.75
    curve = m.pr_curve(hist).where("recall >= 0.75").toPandas()
    assert best["precision"] == pytest.approx(curve["precision"].max())
    assert m.optimal_threshold(hist, 0.0).first()["threshold"] is not None
    report = m.threshold_metrics(hist, 0.5).first()
    tp, fp, fn, tn = (report[c] for c in ("tp", "fp", "fn", "tn"))
    assert tp + fp + fn + tn == 500
    assert report["mcc"] == pytest.approx((tp * tn - fp * fn) / np.sqrt(float((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))


def test_decision_and_cost_curves(spark, scored):
    hist = m.score_histogram(scored)
    curve = m.decision_curve(hist)
    assert curve.count() == 98 and curve.where("treat_none <> 0").count() == 0
    assert m.useful_range(curve).first()["n_thresholds"] > 0
    best = lambda fn: m.cost_curve(hist, cost_fn=fn).where("is_optimal").first()["threshold"]
    assert m.cost_curve(hist).count() == 90 and best(100.0) <= best(1.0)


def test_curve_does_not_depend_on_ranges(scored, many_ranges):
    plain = m.curve_areas(m.score_histogram(scored)).first()
    with many_ranges():
        wide = m.curve_areas(m.score_histogram(scored)).first()
    assert [wide[i] for i in range(3)] == pytest.approx([plain[i] for i in range(3)])


def test_regression_metrics(spark):
    y = RNG.gamma(2, 100, 200)
    fit = y * RNG.uniform(0.5, 1.5, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, fit)], "y double, y_hat double")
    row = m.regression_metrics(df).first()
    assert row["r_squared"] == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["mdape"] == pytest.approx(100 * np.median(np.abs((y - fit) / y)))
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, y_hat double")
    row = m.regression_metrics(flat).first()
    assert row["r_squared"] == 0.0 and row["mdape"] == 0.0


def test_model_choice(spark):
    report = spark.createDataFrame([("rf", 0.500), ("boost", 0.509), ("lr", 0.4)], "model string, pr_auc double")
    pick = lambda r: m.select_model(r, preferred="rf", rival="boost").where("is_winner").first()["model"]
    assert pick(report) == "rf"
    assert pick(report.withColumn("pr_auc", F.when(F.col("model") == "boost", 0.6).otherwise(F.col("pr_auc")))) == "boost"


def components(spark):
    rows = [(f"D{i}", *[float(v) for v in RNG.uniform(10, 80, 4)]) for i in range(12)]
    from panelscope.schema import COMPONENTS, EXPERT_WEIGHTS
    from panelscope.operators.index import weighted_score

    df = spark.createDataFrame(rows, "District string, " + ", ".join(f"{c} double" for c in COMPONENTS))
    return df.withColumn("Disaster_Risk_Score", weighted_score(EXPERT_WEIGHTS))


def test_dirichlet_rows(spark):
    with pytest.raises(ValueError):
        unc.dirichlet_weights(spark, 10, [0.5, 0.4])
    w = unc.dirichlet_weights(spark, 400).toPandas()
    cols = ["w0", "w1", "w2", "w3"]
    assert np.allclose(w[cols].sum(axis=1), 1) and (w[cols] > 0).all().all()
    assert np.allclose(w[cols].mean(), [0.3, 0.25, 0.25, 0.2], atol=0.02)
    again = unc.dirichlet_weights(spark, 400).repartition(3).orderBy("sim").toPandas()
    assert np.array_equal(w.sort_values("sim")[cols].values, again[cols].values)
    tight = unc.dirichlet_weights(spark, 400, concentration=500).toPandas()
    assert (tight[cols].std() < w[cols].std()).all()


def test_monte_carlo(spark):
    means = components(spark)
    weights = unc.dirichlet_weights(spark, 150)
    out = unc.mc_risk_index(means, weights).toPandas()
    assert len(out) == 12 and (out["ci_lower_2_5"] <= out["ci_lower_5"]).all() and (out["ci_lower_5"] <= out["median_risk"]).all()
    stable = unc.mc_rank_stability(means, weights).first()
    assert 0 <= stable["min_stability"] <= stable["overall_stability"] <= stable["max_stability"] <= 1
    counts = means.select("District", F.lit(7).alias("n_rows"))
    points = [r["n_iterations"] for r in unc.mc_convergence(means, counts, weights).orderBy("n_iterations").collect()]
    assert points == [100, 150]


def test_knockout_and_sweep(spark):
    means = components(spark)
    assert unc.knockout(means).count() == 4
    sweep = unc.weight_sweep(means).toPandas()
    assert len(sweep) == 84
    assert np.allclose(sweep[sweep["multiplier"] == 1.0]["rho"], 1.0)


def test_bootstrap_intervals_bracket(spark, scored):
    df = scored.withColumn("unit", F.pmod(F.xxhash64("p", F.rand(1)), F.lit(25)))
    from panelscope.sources.durable import durable

    df = durable(df)
    ci = {r["metric"]: r for r in unc.cluster_bootstrap_ci(df, threshold=0.4, n_replicates=60).collect()}
    auc = m.roc_auc(m.score_histogram(df)).first()["roc_auc"]
    assert ci["roc_auc"]["lower"] <= auc <= ci["roc_auc"]["upper"]
    tiny = unc.cluster_bootstrap_ci(df.limit(5), n_replicates=5).collect()
    assert all(r["n_replicates"] == 0 for r in tiny)


def test_ordinal_rank_matches_window(spark, many_ranges):
    rows = [(s, f"u{i:03d}", float(RNG.integers(0, 20))) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "sim int, u string, score double")
    want = sorted((s, u, 1 + i) for s in range(3) for i, (_, u) in enumerate(sorted((-x, u) for t, u, x in rows if t == s)))
    with many_ranges():
        got = unc.ordinal_rank(df, ["sim"], "score", "u").select("sim", "u", "rank").collect()
    assert sorted(tuple(r) for r in got) == want
