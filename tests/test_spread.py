"""Steps that multiply the rows of small tables run in many tasks."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.operators import clusters, panel, permute, spatial, uncertainty
from panelscope.sources.durable import spread


def test_rows_of_one_file_are_dealt_before_they_are_multiplied(spark):
    one = spark.range(4000).coalesce(1)
    assert spread(one, 100).rdd.getNumPartitions() == 1
    assert permute.replicates(one, 500).rdd.getNumPartitions() == 4
    rows = spread(one, 100, made_rows=1000)
    assert rows.rdd.getNumPartitions() == 400 and rows.agg(F.sum("id"), F.count("id")).first() == (3999 * 2000, 4000)


def test_zero_rows_of_the_panel_are_made_in_many_tasks(spark):
    units = spark.range(20_000).coalesce(1).withColumnRenamed("id", "u")
    days = [(7, dt.date(2000, 1, 1), 1), (7, dt.date(2008, 4, 1), 2)]
    facts = spark.createDataFrame(days, "u bigint, p date, n bigint")
    summed = panel.panel_complete_sums(facts, units, "u", "p", {"n": F.col("n")})
    assert "RoundRobinPartitioning(4)" in summed._jdf.queryExecution().executedPlan().toString()
    assert summed.agg(F.count("n"), F.sum("n")).first() == (2_000_000, 3)
    full = panel.panel_complete(facts, units, "u", "p", {"n": 0})
    assert full.agg(F.count("n"), F.sum("n")).first() == (2_000_000, 3)


def test_sums_of_the_panel_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(panel, "TASK_ROWS", 10, raising=False)
    days = [(u, dt.date(2000, 1 + m, 1), u + m) for u in range(40) for m in range(3)]
    facts = spark.createDataFrame([*days, *days, (None, dt.date(2000, 1, 1), 5)], "u bigint, p date, n bigint")
    units = facts.where("u IS NOT NULL").select("u").distinct()
    summed = panel.panel_complete_sums(facts, units, "u", "p", {"n": F.col("n")})
    assert summed.rdd.getNumPartitions() == 37  # 241 rows and 120 zero rows
    assert sorted(summed.where("u IS NOT NULL").collect()) == sorted((u, d, 2 * n) for u, d, n in days)
    assert summed.where("u IS NULL").first()["n"] == 5


def _brute(x, labels):
    gaps, labels, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.array(labels), []
    for i, own in enumerate(labels):
        mean = {c: gaps[i][labels == c].sum() / ((labels == c).sum() - (c == own)) for c in set(labels.tolist())}
        a, b = mean[own], min(m for c, m in mean.items() if c != own)
        out.append((b - a) / max(a, b))
    return np.mean(out)


@pytest.mark.parametrize("block_rows", [7, 64, 2048])
def test_silhouettes_of_several_labellings_share_their_distances(spark, block_rows):
    x = np.random.default_rng(1).normal(size=(150, 2))
    rows = [(f"u{i}", "abc"[i % 3], i % 2, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "u string, c string, k int, a double, b double")
    found = clusters.silhouettes(df, "u", ["c", "k"], ["a", "b"], block_rows).orderBy("l").collect()
    assert [r["n_units"] for r in found] == [150, 150]
    assert [r["silhouette"] for r in found] == pytest.approx([_brute(x, [r[i] for r in rows]) for i in (1, 2)])
    assert clusters.silhouette(df.limit(0), "u", "c", ["a", "b"]).first() == (None, 0)


def test_cells_of_the_panel_are_dealt_before_they_are_summed(spark):
    units = spark.range(50).withColumnRenamed("id", "u")
    facts = spark.range(3000).select((F.col("id") % 50).alias("u"), F.lit(dt.date(2000, 1, 1)).alias("p"), F.lit(1).alias("n"))
    plan = panel.panel_complete_sums(facts, units, "u", "p", {"n": F.col("n")})._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("hashpartitioning(u")  # no sums below the shuffle


def test_pairs_of_sites_are_dealt_over_tasks(spark, monkeypatch):
    plans, plain = [], spatial.durable

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(spatial, "durable", kept)
    monkeypatch.setattr(spatial, "MADE_ROWS", 1000)
    rng = np.random.default_rng(3)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (200, 2)))]
    edges = spatial.knn_edges(spark.createDataFrame(points, "District int, Latitude double, Longitude double"), 4)
    assert edges.count() == 800
    assert any(re.search(r"RepartitionByExpression \[ca#\w+, co#\w+\], 9\b", p) for p in plans)  # about 9 x 5 x 200 pairs


def test_draws_go_to_their_unit_in_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.createDataFrame([(i % 30,) for i in range(300)], "unit int")
    brute = {}
    for r in permute.cluster_draws(df, "unit", 40).collect():
        brute.setdefault(r["unit"], set()).add(r["rep"])
    monkeypatch.setattr(permute, "MADE_ROWS", 100)
    lists = permute.drawn_replicates(df, "unit", 40)
    assert {r["unit"]: set(r["reps"]) for r in lists.collect()} == brute
    assert "hashpartitioning(_index#" in (plan := lists._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan


def test_rows_draw_their_residuals_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(uncertainty, "DRAWN", 1000)
    df = spark.createDataFrame([(f"k{i}", i % 20, float(i % 7), 1.0) for i in range(200)], "k string, unit int, y double, y_hat double")
    for intervals in (uncertainty.residual_bootstrap_intervals, uncertainty.residual_rank_intervals):
        out = intervals(df, "k", n_replicates=50)
        assert out._jdf.queryExecution().executedPlan().toString().count(", 10), REPARTITION_BY_NUM") >= 2
        assert out.count() == 200
