"""Bootstrap by vectors and simulations inside the row, against brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelscope.operators import permute
from panelscope.operators import uncertainty as unc
from panelscope.schema import COMPONENTS

REPS = 40


def _areas(p, y, w):
    """ROC and PR area by walking the distinct scores in descending order."""
    pos_all, neg_all = (w * y).sum(), (w * (1 - y)).sum()
    tp = fp = roc = pr = 0.0
    for score in sorted(set(p), reverse=True):
        here = p == score
        pos, neg = (w * y)[here].sum(), (w * (1 - y))[here].sum()
        before = tp / (tp + fp) if tp + fp else 1.0
        roc += neg * (tp + pos / 2)
        tp, fp = tp + pos, fp + neg
        pr += pos / pos_all * ((tp / (tp + fp) if tp + fp else 1.0) + before) / 2
    return roc / (pos_all * neg_all), pr


def _scored(spark, rows=400, units=13):
    rng = np.random.default_rng(5)
    unit = np.where(rng.random(rows) < 0.34, 0, rng.integers(0, units, rows))  # one unit holds a third
    p = np.round(rng.random(rows), 2)
    y = (rng.random(rows) < 0.2 + 0.6 * p).astype(int)
    return spark.createDataFrame([(f"u{u}", int(t), float(s)) for u, t, s in zip(unit, y, p)], "unit string, y int, p double")


def _multiplicities(df):
    drawn = permute.cluster_draws(df, "unit", REPS, 42).collect()
    return {(r["unit"], r["rep"]): r["mult"] for r in drawn}


def test_draw_vectors_hold_the_draws(spark):
    df = _scored(spark)
    drawn = _multiplicities(df)
    vectors = {r["unit"]: r["mult"] for r in permute.draw_vectors(df, "unit", REPS, 42).collect()}
    assert {(u, i + 1): m for u, v in vectors.items() for i, m in enumerate(v) if m} == drawn
    assert all(len(v) == REPS for v in vectors.values())


def test_cluster_bootstrap_against_brute_force(spark, ranges):
    df = _scored(spark)
    drawn = _multiplicities(df)
    rows = df.collect()
    p, y = np.array([r["p"] for r in rows]), np.array([r["y"] for r in rows])
    found = {m: [] for m in ("roc_auc", "pr_auc", "recall", "precision", "f1_score")}
    for rep in range(1, REPS + 1):
        w = np.array([drawn.get((r["unit"], rep), 0) for r in rows], dtype=float)
        roc, pr = _areas(p, y, w)
        flagged = p >= 0.4
        tp, fp, fn = (w * y)[flagged].sum(), (w * (1 - y))[flagged].sum(), (w * y)[~flagged].sum()
        for name, value in zip(found, (roc, pr, tp / (tp + fn), tp / (tp + fp), 2 * tp / (2 * tp + fp + fn))):
            found[name].append(value)
    got = {r["metric"]: r for r in unc.cluster_bootstrap_ci(df, threshold=0.4, n_replicates=REPS).collect()}
    for name, values in found.items():
        assert got[name]["n_replicates"] == REPS
        assert (got[name]["lower"], got[name]["upper"]) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


def test_bootstrap_r2_against_brute_force(spark):
    df = _scored(spark).select("unit", (F.col("p") * 10 - 7).alias("y"), (F.col("y") * 5.0 - 4).alias("y_hat"))
    drawn, rows, values = _multiplicities(df), df.collect(), []
    y, fit = np.array([r["y"] for r in rows]), np.array([r["y_hat"] for r in rows])
    for rep in range(1, REPS + 1):
        w = np.array([drawn.get((r["unit"], rep), 0) for r in rows], dtype=float)
        values.append(1 - (w * (y - fit) ** 2).sum() / ((w * y * y).sum() - (w * y).sum() ** 2 / w.sum()))
    got = unc.bootstrap_r2_ci(df, n_replicates=REPS).first()
    assert (got["lower"], got["upper"]) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


def test_empty_tables(spark):
    df = _scored(spark).where("false")
    assert all(r["n_replicates"] == 0 and r["lower"] is None for r in unc.cluster_bootstrap_ci(df, n_replicates=5).collect())


def _means(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i}", *[float(x) for x in rng.random(4)]) for i in range(30)] + [("gap", None, 0.1, 0.2, 0.3)]
    return spark.createDataFrame(rows, "District string, " + ", ".join(f"`{c}` double" for c in COMPONENTS))


def test_simulations_in_the_row_against_numpy(spark):
    means, weights = _means(spark), unc.uniform_weights(spark, 300)
    w = np.array([list(r)[1:] for r in weights.orderBy("sim").collect()])
    got = {r["District"]: r for r in unc.mc_risk_index(means, weights).collect()}
    for row in means.collect():
        if row["District"] == "gap":
            assert got["gap"]["mean_risk"] is None and got["gap"]["median_risk"] is None
            continue
        scores = w @ np.array(list(row)[1:])
        r = got[row["District"]]
        expected = [scores.mean(), scores.std(), *np.quantile(scores, [0.5, 0.025, 0.975, 0.05, 0.95])]
        assert [r[c] for c in ("mean_risk", "std_risk", "median_risk", "ci_lower_2_5", "ci_upper_97_5", "ci_lower_5", "ci_upper_95")] == pytest.approx(expected)


def test_convergence_against_numpy(spark):
    means, weights = _means(spark), unc.uniform_weights(spark, 300)
    counts = means.select("District", (F.length("District") * 7).cast("bigint").alias("n_rows"))
    w = np.array([list(r)[1:] for r in weights.orderBy("sim").collect()])
    units = [r for r in means.collect() if r["District"] != "gap"]
    scores = w @ np.array([list(r)[1:] for r in units]).T
    n = np.array([7 * len(r["District"]) for r in units])
    got = {r["n_iterations"]: r for r in unc.mc_convergence(means, counts, weights).collect()}
    assert set(got) == {100, 200, 300}
    for k, r in got.items():
        grand = scores[:k] @ n / n.sum()
        expected = [grand.mean(), grand.std(), scores[:k].mean(axis=0).std()]
        assert [r["grand_mean"], r["std_across_sims"], r["std_of_unit_means"]] == pytest.approx(expected)


def test_too_many_simulations_are_refused(spark, monkeypatch):
    monkeypatch.setattr(unc, "MAX_SIMULATIONS", 10)
    with pytest.raises(PySparkException, match="simulations"):
        unc.mc_risk_index(_means(spark), unc.uniform_weights(spark, 11)).collect()


def test_simulations_are_not_shuffled(spark, capsys):
    unc.mc_risk_index(_means(spark), unc.uniform_weights(spark, 300)).explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "hashpartitioning" not in plan
