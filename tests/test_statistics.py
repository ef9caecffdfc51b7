import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelscope.functions import tails
from panelscope.functions.draws import Keys, uniform
from panelscope.operators import hypothesis as hyp
from panelscope.operators import permute, spatial
from panelscope.sources.durable import durable

RNG = np.random.default_rng(11)


def test_tail_probabilities(spark):
    df = spark.createDataFrame([(1.959963985, 3.841458821, 4.0, 95.0)], "z double, x double, a double, b double")
    row = df.select(
        tails.p_normal(F.col("z")), tails.p_chi_square(F.col("x"), F.lit(1)),
        tails.p_f(F.lit(2.467494), F.col("a"), F.col("b")), tails.p_t(F.lit(1.985251), F.col("b")),
        tails.p_chi_square(F.lit(18.307038), F.lit(10)), tails.p_normal(F.lit(None).cast("double")),
    ).first()
    assert row[:5] == pytest.approx([0.05] * 5, abs=2e-6) and row[5] is None
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)


def test_anova_and_levene_against_numpy(spark):
    pdf = pd.DataFrame({"g": RNG.integers(0, 4, 200), "x": RNG.normal(0, 1, 200)})
    pdf["x"] += pdf["g"] * 0.3
    df = spark.createDataFrame(pdf)

    def f_of(frame):
        groups = [v.values for _, v in frame.groupby("g")["x"]]
        grand = frame["x"].mean()
        ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in groups)
        ssw = sum(((v - v.mean()) ** 2).sum() for v in groups)
        return (ssb / 3) / (ssw / 196), ssb / (ssb + ssw)

    row = hyp.anova_oneway(df, "g", "x").first()
    f, eta = f_of(pdf)
    assert row["f_statistic"] == pytest.approx(f) and row["eta_squared"] == pytest.approx(eta)
    assert 0 < row["p_value"] < 1
    dev = pdf.assign(x=(pdf["x"] - pdf.groupby("g")["x"].transform("median")).abs())
    assert hyp.levene(df, "g", "x").first()["w_statistic"] == pytest.approx(f_of(dev)[0])
    welch = hyp.anova_welch(df, "g", "x").first()
    assert welch["df_num"] == 3 and 0 < welch["p_value"] < 1


def test_mann_kendall_against_pairs(spark):
    rows, want = [], {}
    for s in range(4):
        x = RNG.integers(0, 5, 11)
        rows += [(s, 2010 + i, float(v)) for i, v in enumerate(x)]
        pairs = [(x[j] - x[i], j - i) for i in range(11) for j in range(i + 1, 11)]
        want[s] = (sum(np.sign(p[0]) for p in pairs), np.median([a / b for a, b in pairs]))
    df = spark.createDataFrame(rows, "series int, t int, x double")
    by = hyp.mann_kendall(df, ["series"], "t", "x").collect()
    for r in by:
        assert r["s"] == want[r["series"]][0] and r["sens_slope"] == pytest.approx(want[r["series"]][1])
        assert 0 <= r["p_value"] <= 1


def test_short_series(spark):
    df = spark.createDataFrame([(1, 2010, 3.0)], "series int, t int, x double")
    row = hyp.mann_kendall(df, ["series"], "t", "x").first()
    assert row["s"] == 0 and row["sens_slope"] is None and row["direction"] == "no trend"


def test_ols_against_numpy(spark):
    n = 300
    pdf = pd.DataFrame({"g": RNG.integers(0, 20, n), "a": RNG.normal(50, 5, n), "b": RNG.uniform(0, 1, n)})
    pdf["y"] = 3 + 2 * pdf["a"] - 4 * pdf["b"] + RNG.normal(0, 1, n)
    x = np.column_stack([np.ones(n), pdf["a"], pdf["b"]])
    beta = np.linalg.solve(x.T @ x, x.T @ pdf["y"])
    e = pdf["y"] - x @ beta
    scores = pd.DataFrame(x * e.values[:, None]).groupby(pdf["g"]).sum().values
    inv = np.linalg.inv(x.T @ x)
    g = len(scores)
    cov = inv @ (scores.T @ scores) @ inv * (g / (g - 1)) * ((n - 1) / (n - 3))
    out = hyp.ols_cluster_robust(spark.createDataFrame(pdf), "y", ["a", "b"], "g").toPandas()
    assert np.allclose(out["coefficient"], beta) and np.allclose(out["std_error"], np.sqrt(np.diag(cov)))
    assert (out["ci_lower"] < out["ci_upper"]).all()


def test_chi_square_permutation(spark):
    rows = [(i, "r%d" % (i % 3), "c%d" % (i % 3 if i % 7 else 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "u int, r string, c string")
    strong = hyp.chi_square_permutation(df, "u", "r", "c", replicates=99).first()
    assert strong["p_value"] == pytest.approx(0.01)
    chi = hyp.chi_square(df, "r", "c").first()
    assert chi["cramers_v"] <= 1 and chi["dof"] == 4


def test_spearman_of_monotone_and_ties(spark):
    df = spark.createDataFrame([(float(i), float(i) ** 3) for i in range(50)], "x double, y double")
    assert hyp.spearman(df, "x", "y").first()["rho"] == pytest.approx(1.0)


@pytest.mark.parametrize("range_rows", [15, 100_000])
def test_permutation_is_a_shuffle(spark, range_rows):
    df = spark.createDataFrame([(i, i * 10) for i in range(80)], "u int, v int")
    out = permute.permuted_values(df, "u", "v", 5, seed=1, range_rows=range_rows).toPandas()
    assert len(out) == 400
    for _, part in out.groupby("rep"):
        assert sorted(part["v"]) == [i * 10 for i in range(80)] and part["u"].nunique() == 80
    plain = permute.permuted_values(df, "u", "v", 5, seed=1).toPandas()
    key = ["rep", "u"]
    assert out.sort_values(key).reset_index(drop=True).equals(plain.sort_values(key).reset_index(drop=True))


def test_array_draws_equal_the_column(spark):
    tails = [None, "", "a", "D_000017", "x" * 47, "x" * 48, "x" * 70, "é"]
    df = spark.createDataFrame(list(enumerate(tails)), "i int, u string")
    keys = Keys([b"" if t is None else f":{t}".encode() for t in tails])
    for rep in (1, 10, 9999):
        plain = [r["v"] for r in df.select("i", uniform(42, F.lit(rep), F.col("u")).alias("v")).orderBy("i").collect()]
        assert (keys.first_words(f"42:{rep}") / 2.0**32).tolist() == plain


def test_cells_of_held_units_equal_shuffled_rows(spark):
    rows = [(None if i == 4 else i, None if i % 11 == 0 else "r%d" % (i % 3), None if i % 13 == 0 else i % 4) for i in range(90)]
    df = spark.createDataFrame(rows, "u int, r string, c int")
    key = ["rep", "r", "c"]
    held, shuffled = (
        sorted(map(tuple, permute.permuted_cells(df, "u", "r", "c", 40, 3, n).collect()), key=str) for n in (1000, 10)
    )
    assert held == shuffled and sum(n for *_, n in held) == 90 * 40
    plan = permute.permuted_cells(df, "u", "r", "c", 40)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan  # no row per unit and replicate is sorted
    assert permute.permuted_cells(df, "u", "r", "c", 40).columns == [*key, "_o"]


def test_moran_permutations_of_held_units_equal_shuffled_rows(spark):
    pts = points("uniform")
    units = spark.createDataFrame(pts, "District int, Latitude double, Longitude double")
    edges = durable(spatial.knn_edges(units, 4))
    values = units.select("District", F.when(F.col("District") % 17 != 0, F.sin("District")).alias("v"))
    values = values.unionByName(values.where("District = 5")).where("District <> 9")  # one listed twice, one without value row
    held, shuffled = (spatial.morans_permutation(values, edges, "District", "v", 60, 7, held_units=n).first() for n in (1000, 0))
    assert held["n_permutations"] == 60 and held["n_as_large"] == shuffled["n_as_large"]
    assert list(held.asDict().values()) == pytest.approx(list(shuffled.asDict().values()), abs=1e-8)


def test_cluster_draws_have_n_units(spark):
    df = spark.createDataFrame([(i % 30,) for i in range(300)], "unit int")
    totals = permute.cluster_draws(df, "unit", 40).groupBy("rep").agg(F.sum("mult").alias("n")).collect()
    assert len(totals) == 40 and all(r["n"] == 30 for r in totals)


def points(kind):
    if kind == "uniform":
        p = RNG.uniform(0, 10, (120, 2))
    elif kind == "clustered":  # a third of all units in one tiny area, far outliers
        p = np.vstack([RNG.normal(0, 1e-3, (40, 2)), RNG.uniform(-50, 50, (77, 2)), [[500, 500], [-500, 400], [0, 999]]])
    elif kind == "lattice":
        p = np.array([(20 + 0.5 * (i // 10), 75 + 0.5 * (i % 10)) for i in range(100)])
    else:  # a third of all units on one point
        p = np.vstack([np.zeros((40, 2)), RNG.uniform(-5, 5, (80, 2))])
    return [(int(i), float(a), float(b)) for i, (a, b) in enumerate(p)]


@pytest.mark.parametrize("kind", ["uniform", "clustered", "lattice", "stacked"])
def test_knn_equals_brute_force(spark, kind):
    pts = points(kind)
    df = spark.createDataFrame(pts, "District int, Latitude double, Longitude double")
    got = {}
    for r in spatial.knn_edges(df, 5, cell_sites=8).collect():
        got.setdefault(r["District"], {})[r["rank"]] = r["neighbour"]
    for i, a, b in pts:
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), j) for j, x, y in pts if j != i)[:5]
        assert [got[i][k] for k in range(1, 6)] == [j for _, j in near]


def test_knn_few_units(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 5.0, 5.0)], "District int, Latitude double, Longitude double")
    assert spatial.knn_edges(df, 5).count() == 6


def test_moran_of_gradient_is_high(spark):
    pts = points("lattice")
    df = spark.createDataFrame([(i, a, b, a + b) for i, a, b in pts], "District int, Latitude double, Longitude double, x double")
    edges = spatial.knn_edges(df, 4)
    row = spatial.morans_permutation(df, edges, "District", "x", 99).first()
    assert 0.5 < row["morans_i"] < 1.5 and row["p_value"] == pytest.approx(0.01) and row["z_score"] > 5
    assert row["expected_i"] == pytest.approx(-1 / 99)


def test_residual_diagnostics(spark):
    y = RNG.normal(0, 2, 500)
    df = spark.createDataFrame([(float(v), 0.0) for v in y], "y double, y_hat double")
    e = F.col("y") - F.col("y_hat")
    shape = hyp.residual_shape(df, e).first()
    m2 = ((y - y.mean()) ** 2).mean()
    assert shape["skewness"] == pytest.approx(((y - y.mean()) ** 3).mean() / m2**1.5)
    inf = hyp.influence_count(df, "y", "y_hat").first()
    want = int((((y / (math.sqrt((y**2).mean()) + 1e-10)) ** 2) / 30 > 4 / 500).sum())
    assert inf["n_influential"] == want
    qq = hyp.qq_points(df, e, 9).orderBy("prob").collect()
    assert [r["sample"] for r in qq] == sorted(r["sample"] for r in qq) and len(qq) == 9


def test_anderson_darling_against_sorted_values(spark):
    for values in (RNG.normal(3, 2, 300), RNG.exponential(1, 300), RNG.integers(0, 6, 300).astype(float), RNG.normal(0, 1, 8)):
        e = np.sort(values)
        cdf = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in (e - e.mean()) / e.std(ddof=1)])
        i, n = np.arange(1, len(e) + 1), len(e)
        want = -n - ((2 * i - 1) * (np.log(cdf) + np.log1p(-cdf[::-1]))).sum() / n
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "e double")
        row = hyp.anderson_darling(df, F.col("e")).first()
        assert row["n"] == n and row["a_squared"] == pytest.approx(want, abs=1e-7) and 0 <= row["p_value"] <= 1


def test_anderson_darling_levels(spark, ranges):
    def p(values):
        return hyp.anderson_darling(spark.createDataFrame([(float(v),) for v in values], "e double"), F.col("e")).first()

    grid = [tails.normal_quantile((i + 0.5) / 200) for i in range(200)]
    assert p(grid)["p_value"] > 0.99 and p(np.exp(grid))["p_value"] < 1e-6
    assert p([1.0] * 20)["a_squared"] is None and p([1.0] * 20)["p_value"] is None
    assert p([1.0, 2.0, 4.0])["p_value"] is None and p([])["n"] == 0


def test_residual_rank_intervals_against_brute_force(spark, ranges):
    import hashlib

    from panelscope.operators import uncertainty as unc

    reps, seed = 40, 7
    rows = [(k, "hot" if k % 3 else f"u{k % 15}", float(RNG.integers(-3, 4)), float(RNG.integers(0, 3)) / 2) for k in range(150)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, "hot", None, 1.0)], "k long, unit string, y double, f double")
    draws = permute.cluster_draws(df.where("unit IS NOT NULL"), "unit", reps, seed).collect()
    hit = {(r["rep"], r["unit"]) for r in draws}
    got = {r["k"]: r for r in unc.residual_rank_intervals(df, "k", y_hat="f", n_replicates=reps, seed=seed).collect()}
    assert len(got) == 150
    for k, unit, y, f in rows:
        pool = sorted(a - b for _, u, a, b in rows if u == unit)
        values = []
        for r in range(1, reps + 1):
            u = int(hashlib.md5(f"{seed}:residual:{r}:{k}".encode()).hexdigest()[:8], 16) / 2**32
            values.append(pool[int(u * len(pool))] if (r, unit) in hit else 0.0)
        low, high = np.quantile(values, [0.025, 0.975])
        assert (got[k]["lower"], got[k]["upper"]) == pytest.approx((f + low, f + high), abs=1e-9)
