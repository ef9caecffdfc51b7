"""Nearest-neighbour edges and spatial autocorrelation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide
from ..sources.durable import MADE_ROWS, count_rows, durable, with_rows
from .ordering import row_numbers
from .permute import HELD_UNITS, held_replicates, permuted_values

# A grid cell may hold this many sites before the grid is refined.
CELL_SITES = 64


def knn_edges(
    units: DataFrame, k: int, unit: str = "District", lat: str = "Latitude", lon: str = "Longitude",
    cell_sites: int = CELL_SITES,
) -> DataFrame:
    """(unit, neighbour, d2, rank): k nearest units by Euclidean (lat, lon).

    Ties are broken by unit id and a unit is never its own neighbour.  Units on
    one point share a site, and a site needs only its k + 1 smallest ids: that
    is all any unit can need, so crowded points do not multiply pairs.  Sites
    are bucketed on a grid refined until the fullest cell is small, and joined
    to the 3 x 3 block around their cell.  A site is settled once its farthest
    kept distance cannot be beaten from outside the block; the rest repeat on a
    grid twice as coarse, so the result is exact.
    """
    points = durable(units.select(F.col(unit).alias("u"), F.col(lat).alias("a"), F.col(lon).alias("o")))
    keep = k + 1
    firsts = points.withColumn("r", F.row_number().over(Window.partitionBy("a", "o").orderBy("u")))
    sites = durable(
        firsts.where(F.col("r") <= keep).groupBy("a", "o").agg(F.array_sort(F.collect_list("u")).alias("ids"))
    )
    low_a, high_a, low_o, high_o, n_sites = sites.agg(
        F.min("a"), F.max("a"), F.min("o"), F.max("o"), F.count(F.lit(1))
    ).first()
    if not n_sites:
        return points.selectExpr(f"u AS `{unit}`", "u AS neighbour", "0D AS d2", "1 AS rank").limit(0)
    width = max(high_a - low_a, high_o - low_o, 1e-9)
    side = width / max(1.0, math.sqrt(n_sites / keep))

    def cell(prefix=""):
        return [
            F.floor((F.col(f"{prefix}a") - low_a) / side).alias("ca"),
            F.floor((F.col(f"{prefix}o") - low_o) / side).alias("co"),
        ]

    while True:  # refine until the fullest cell is small
        fullest = sites.select(*cell()).groupBy("ca", "co").count().agg(F.max("count")).first()[0]
        if fullest <= max(cell_sites, 4 * keep) or side < width * 1e-6:
            break
        side /= 2.0

    block = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    found, waiting = None, with_rows(sites.select("a", "o"), n_sites)
    while True:
        whole = side >= width  # the block covers every site
        # pairs of sites spread evenly; a task makes about MADE_ROWS of them
        pairs_made = count_rows(waiting) * n_sites * min(1.0, 9.0 * (side / width) ** 2)
        tasks = max(1, math.ceil(pairs_made / MADE_ROWS))
        grid = sites.select("a", "o", "ids", *cell()).repartition(tasks, "ca", "co")
        asking = (
            waiting.select(F.col("a").alias("sa"), F.col("o").alias("so"))
            .select("sa", "so", *cell("s"))
            .withColumn("d", F.explode(block))
            .select("sa", "so", (F.col("ca") + F.col("d.i")).alias("ca"), (F.col("co") + F.col("d.j")).alias("co"))
            .repartition(tasks, "ca", "co")
        )
        da, do = F.col("a") - F.col("sa"), F.col("o") - F.col("so")
        pairs = asking.join(grid, ["ca", "co"]).select("sa", "so", (da * da + do * do).alias("d2"), F.explode("ids").alias("v"))
        nearest = Window.partitionBy("sa", "so").orderBy("d2", "v")
        top = pairs.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= keep)
        near = top.groupBy("sa", "so").agg(
            F.array_sort(F.collect_list(F.struct("d2", "v"))).alias("near"), F.max("d2").alias("far")
        )
        edge_a = F.floor((F.col("sa") - low_a) / side)
        edge_o = F.floor((F.col("so") - low_o) / side)
        border = F.least(
            F.col("sa") - (low_a + (edge_a - 1) * side), low_a + (edge_a + 2) * side - F.col("sa"),
            F.col("so") - (low_o + (edge_o - 1) * side), low_o + (edge_o + 2) * side - F.col("so"),
        )
        if not whole:
            near = near.where((F.size("near") == keep) & (F.col("far") < border * border))
        done = durable(near.select(F.col("sa").alias("a"), F.col("so").alias("o"), "near"))
        found = done if found is None else found.unionByName(done)
        waiting = durable(waiting.join(done.select("a", "o"), ["a", "o"], "left_anti"))
        if whole or not count_rows(waiting):
            break
        side *= 2.0
    others = F.slice(F.filter("near", lambda e: e["v"] != F.col("u")), 1, k)
    return points.join(found, ["a", "o"]).select("u", F.posexplode(others).alias("pos", "e")).select(
        F.col("u").alias(unit), F.col("e.v").alias("neighbour"), F.col("e.d2").alias("d2"), (F.col("pos") + 1).alias("rank")
    )


def _moran_terms(values: DataFrame, edges: DataFrame, unit: str, value: str, by: list[str]) -> DataFrame:
    """Sum of z_i z_j over directed edges per ``by`` (row weights 1/k later)."""
    left = values.select(*by, F.col(unit).alias("_i"), F.col(value).alias("_zi"))
    right = values.select(*by, F.col(unit).alias("_j"), F.col(value).alias("_zj"))
    e = edges.select(F.col(unit).alias("_i"), F.col("neighbour").alias("_j"), "_w")
    return left.join(e, "_i").join(right, by + ["_j"]).groupBy(*by).agg(
        F.sum(F.col("_w") * F.col("_zi") * F.col("_zj")).alias("cross"), F.sum("_w").alias("s0")
    )


def _held_terms(values: DataFrame, edges: DataFrame, unit: str, value: str, n_permutations: int, seed: int) -> DataFrame:
    """``_moran_terms`` of every permutation, summed by tasks that hold the units with their neighbours' numbers."""
    numbered = durable(row_numbers(values.select(F.col(unit).alias("_u"), F.col(value).cast("double").alias("_z")), "_u", "_i"))
    number = numbered.select(F.col("_u").alias("_to"), (F.col("_i") - 1).cast("int").alias("_j"))
    e = edges.select(F.col(unit).alias("_from"), F.col("neighbour").alias("_to"), "_w").join(number, "_to")
    near = e.groupBy("_from").agg(F.collect_list("_j").alias("_js"), F.max("_w").alias("_w"))  # one weight per unit
    linked = numbered.join(near, numbered["_u"] == near["_from"], "left").select("_u", "_i", "_z", "_js", "_w")

    def terms(held: pa.Table, orders) -> pa.Table:
        js = held.column("_js").combine_chunks()
        sizes = np.nan_to_num(js.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        source, target = np.repeat(np.arange(len(sizes)), sizes), js.flatten().to_numpy()
        w = held.column("_w").to_numpy()[source]
        z = held.column("_z").fill_null(0.0).to_numpy()  # a null adds nothing to a sum
        out = []
        for rep, order in orders if len(source) else ():
            placed = np.empty(len(z))
            placed[order] = z
            out.append((rep, float((w * placed[source] * placed[target]).sum())))
        return pa.table({
            "rep": pa.array([r for r, _ in out], pa.int32()), "cross": pa.array([c for _, c in out], pa.float64()),
            "s0": pa.array([float(w.sum())] * len(out), pa.float64()),
        })

    linked = durable(linked)
    return held_replicates(linked, "_u", n_permutations, seed, terms, "rep int, cross double, s0 double")


def _weighted(edges: DataFrame, unit: str) -> DataFrame:
    degree = Window.partitionBy(unit)  # k rows per unit
    return edges.withColumn("_w", F.lit(1.0) / F.count(F.lit(1)).over(degree))


def morans_i(values: DataFrame, edges: DataFrame, unit: str, value: str) -> DataFrame:
    """I = (n / S0) sum w z z / sum z^2 with row-standardised weights."""
    mean, n, ss = values.agg(F.avg(value), F.count(value), F.count(value) * F.var_pop(value)).first()
    centred = values.select(unit, (F.col(value) - F.lit(mean)).alias("_z"))
    terms = _moran_terms(centred, _weighted(edges, unit), unit, "_z", [])
    i = divide(F.lit(float(n)) * F.col("cross"), F.col("s0") * F.lit(ss)) if ss else F.lit(0.0)
    return terms.select(
        i.alias("morans_i"), F.lit(-1.0 / (n - 1) if n > 1 else None).cast("double").alias("expected_i"), F.lit(n).cast("bigint").alias("n_units")
    )


def morans_permutation(
    values: DataFrame, edges: DataFrame, unit: str, value: str, n_permutations: int = 999, seed: int = 42, digits: int = 9,
    held_units: int = HELD_UNITS,
) -> DataFrame:
    """Observed I, permutation z and two-sided p = (c + 1) / (B + 1)."""
    observed = durable(morans_i(values, edges, unit, value)).first()
    mean, n, ss = values.agg(F.avg(value), F.count(value), F.count(value) * F.var_pop(value)).first()
    centred = durable(values.select(unit, (F.col(value) - F.lit(mean)).alias("_z")))
    n_units = count_rows(centred)
    weighted = _weighted(edges, unit)
    if n_units > held_units:
        terms = _moran_terms(permuted_values(centred, unit, "_z", n_permutations, seed), weighted, unit, "_z", ["rep"])
    else:
        terms = _held_terms(centred, weighted, unit, "_z", n_permutations, seed)
    per_rep = terms.select(F.round(divide(F.lit(float(n)) * F.col("cross"), F.col("s0") * F.lit(ss or 0.0)), digits).alias("i"))
    obs = F.lit(round(observed["morans_i"], digits) if observed["morans_i"] is not None else None).cast("double")
    out = per_rep.agg(
        F.count(F.lit(1)).alias("n_permutations"),
        F.avg("i").alias("mean_i"), F.stddev_pop("i").alias("sd_i"),
        F.count_if(F.abs("i") >= F.abs(obs)).alias("n_as_large"),
    )
    return out.select(
        obs.alias("morans_i"), F.lit(observed["expected_i"]).alias("expected_i"), "n_permutations", "n_as_large",
        F.when(F.col("sd_i") > 0, divide(obs - F.col("mean_i"), F.col("sd_i"))).otherwise(0.0).alias("z_score"),
        ((F.col("n_as_large") + 1) / (F.col("n_permutations") + 1)).alias("p_value"),
    )


def unit_residuals(df: DataFrame, unit: str, y: str, p: str, lat: str, lon: str, period: str) -> DataFrame:
    """Mean residual y - p and first coordinates per unit."""
    return df.groupBy(unit).agg(
        F.avg(F.col(y) - F.col(p)).alias("residual"),
        F.min_by(lat, period).alias(lat), F.min_by(lon, period).alias(lon),
    )
