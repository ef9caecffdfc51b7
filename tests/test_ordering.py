"""Range-wise results must equal brute force, ties and hot values included."""

import numpy as np
import pandas as pd
import pytest

from panelscope.operators.ordering import average_rank, exact_quantiles, row_numbers, running_totals

RNG = np.random.default_rng(3)


def skewed(n=900):
    """A third of all rows share one value; the rest mixes ties and reals."""
    hot = np.full(n // 3, 5.0)
    ties = RNG.integers(0, 10, n // 3).astype(float)
    reals = np.round(RNG.normal(5, 3, n - 2 * (n // 3)), 6)
    return np.concatenate([hot, ties, reals])


@pytest.mark.usefixtures("ranges")
@pytest.mark.parametrize("descending", [True, False])
def test_average_rank_matches_pandas(spark, descending):
    pdf = pd.DataFrame({"id": range(900), "v": skewed()})
    out = average_rank(spark.createDataFrame(pdf), "v", descending=descending).toPandas()
    want = pdf.set_index("id")["v"].rank(ascending=not descending)
    got = out.set_index("id")["rank"].sort_index()
    assert np.allclose(got, want)


@pytest.mark.usefixtures("ranges")
def test_running_totals_by_group(spark):
    pdf = pd.DataFrame({"g": RNG.integers(0, 3, 600), "v": RNG.permutation(600).astype(float), "n": RNG.integers(1, 9, 600)})
    out = running_totals(spark.createDataFrame(pdf), "v", {"run": "n"}, ["g"]).toPandas()
    want = pdf.sort_values("v").groupby("g")["n"].cumsum()
    got = out.set_index("v")["run"].sort_index()
    assert (got.values == want.loc[pdf.sort_values("v").index].values).all()


@pytest.mark.usefixtures("ranges")
def test_row_numbers_strings(spark):
    keys = [f"D_{i:06d}" for i in RNG.permutation(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = row_numbers(df, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1, 501))


@pytest.mark.usefixtures("ranges")
def test_exact_quantiles_grouped(spark):
    values = skewed()
    pdf = pd.DataFrame({"g": ["a"] * 700 + ["b"] * 200, "v": RNG.permutation(values)})
    probs = [0.0, 0.25, 0.333, 0.5, 0.9, 1.0]
    out = exact_quantiles(spark.createDataFrame(pdf), ["v"], probs, by=["g"]).collect()
    for row in out:
        want = pdf[pdf.g == row["g"]]["v"].quantile(probs).values
        assert np.allclose(row["q"], want), (row["g"], row["q"], want)
    assert len(out) == 2


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, ["v"], [0.5]).first()["q"] is None
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert exact_quantiles(nulls, ["v"], [0.5]).first()["q"] is None


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_from_brackets(spark, accuracy):
    """Sketches that cannot tell all values apart still give exact quantiles."""
    pdf = pd.DataFrame({"g": RNG.integers(0, 3, 6000), "v": RNG.permutation(skewed(6000)), "w": RNG.normal(size=6000)})
    pdf.loc[::7, "w"] = None
    probs = [0.5, 0.001, 0.25, 0.25, 0.26, 0.999, 0.0, 1.0]
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(7)
    for row in exact_quantiles(df, ["v", "w"], probs, accuracy=accuracy).collect():
        assert np.allclose(row["q"], pdf[row["column"]].quantile(probs).values)
    for row in exact_quantiles(df, ["v", "w"], probs, ["g"], accuracy).collect():
        assert np.allclose(row["q"], pdf[pdf.g == row["g"]][row["column"]].quantile(probs).values)


def test_a_wrong_bracket_is_noticed(spark, monkeypatch):
    from panelscope.operators import ordering

    real = ordering.F.percentile_approx
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda c, e, a: real(c, [x / 3 for x in e], a))
    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS v")
    assert exact_quantiles(df, ["v"], [0.5, 0.9], accuracy=50).first()["q"] == pytest.approx([2499.5, 4499.1])


@pytest.mark.usefixtures("ranges")
def test_null_values_and_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", None), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["v"], [0.5, 1.0], by=["g"]).collect()}
    assert got == {None: [2.0, 3.0], "a": None, "b": [2.0, 2.0]}
    ranks = {(r["g"], r["v"]): r["rank"] for r in average_rank(df, "v", ["g"], descending=False).collect()}
    assert ranks[(None, 1.0)] == 1 and ranks[(None, 3.0)] == 2 and ranks[("b", 2.0)] == 2
    several = {r["column"]: r["q"] for r in exact_quantiles(df.selectExpr("v", "v * 2 AS w"), ["v", "w"], [0.0]).collect()}
    assert several == {"v": [1.0], "w": [2.0]}
