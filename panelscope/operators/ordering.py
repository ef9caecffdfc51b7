"""Exact running totals, ranks, row numbers and quantiles at any size.

A window without PARTITION BY sends every row to one task.  Here rows are
dealt into value ranges by ``repartitionByRange`` on the whole key, which never
splits a tie and follows the data's own distribution; each range is processed
by its own task and ranges are stitched together with their totals.  Ties are
counted before they are dealt, so one frequent value is one row.  The plan is
the same at every size: the number of ranges is Spark's own
(``spark.sql.shuffle.partitions``, merged by AQE where they are small).
Quantiles need no ranges: a sketch brackets the wanted positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import durable

ACCURACY = 10_000  # of the sketch: its ranks are off by at most one row in so many
_BEFORE = (Window.unboundedPreceding, -1)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition on ``keys`` in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_range``, rising with ``keys``; equal keys share a range.

    The table is written, so that every later pass sees the same ranges.
    """
    return durable(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))


def running_totals(
    df: DataFrame, value: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add inclusive running sums ``{output: input}`` in order of ``value``.

    ``df`` holds one row per (``by``, ``value``).
    """
    by = list(by)
    ranged = _ranged(df, [*by, value])

    def ordered(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = Window.partitionBy(*by, "_range").orderBy(ordered(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(src).over(inside).alias(out) for out, src in sums.items()])
    # one row per range and group
    ranges = Window.partitionBy(*by).orderBy(ordered("_range")).rowsBetween(*_BEFORE)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(src).alias(out) for out, src in sums.items()])
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(out).over(ranges), F.lit(0)).alias(out) for out in sums])
    joined = local.alias("a").join(offsets.alias("b"), _same("a", "b", [*by, "_range"]))
    return joined.select(
        *[F.col(f"a.`{c}`") for c in df.columns], *[(F.col(f"a.{out}") + F.col(f"b.{out}")).alias(out) for out in sums]
    )


def average_rank(
    df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = True, output: str = "rank"
) -> DataFrame:
    """Add the rank of ``value`` within ``by``; ties share their mean rank."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running_totals(counts, value, {"_upto": "_ties"}, by, descending)
    ranks = ranked.select(*by, value, (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)).alias(output))
    return df.alias("a").join(ranks.alias("b"), _same("a", "b", [*by, value])).select("a.*", F.col(f"b.`{output}`"))


def row_numbers(df: DataFrame, key: str, output: str = "row_number", start: int = 1) -> DataFrame:
    """Number rows by a unique ``key`` in ascending order."""
    ranged = _ranged(df, [key])
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(*_BEFORE))  # one row per range
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    number = F.col("_local") + F.col("_before") + (start - 1)
    return ranged.withColumn("_local", inside).join(offsets, "_range").select(*df.columns, number.cast("bigint").alias(output))


def _bracket_key(value: Column, lows: Sequence[Column], highs: Sequence[Column]) -> Column:
    """(at, outside): the value itself inside a bracket, else the end of the last bracket below it.

    Keys sort like the values, and all values between two brackets share one.
    """
    inside = reduce(lambda a, b: a | b, [(value >= low) & (value <= high) for low, high in zip(lows, highs)])
    below = F.when(value > highs[-1], highs[-1])
    for high in reversed(highs[:-1]):
        below = below.when(value > high, high)
    return F.struct(F.when(inside, value).otherwise(below).alias("at"), (~inside).alias("outside"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """Linear-interpolation quantiles: rows (``by``, column, q array<double>).

    Two scans, all columns, groups and probabilities together.  The first
    makes a quantile sketch, whose bounded rank error gives a bracket around
    every wanted value.  The second counts: a value inside a bracket is its
    own key, all others between two brackets are one key, so what is shuffled
    is the few values near the wanted positions.  A position that falls
    outside its bracket is noticed and all brackets are opened; the result is
    exact either way.  NULLs are left out; q is NULL for a group without
    values.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    group, ordered = [*by, "column"], sorted(set(probs))
    margin = 2.0 / accuracy
    ends = [[max(0.0, p - margin) for p in ordered], [min(1.0, p + margin) for p in ordered]]
    values = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    sketches = [
        F.struct(F.count(v).alias("n"), *[F.percentile_approx(v, e, accuracy).alias(name) for name, e in zip(("low", "high"), ends)])
        .alias(f"_b{i}")
        for i, v in enumerate(F.col(f"_v{i}") for i in range(len(columns)))
    ]
    stats = durable((values.groupBy(*by) if by else values).agg(*sketches))
    if by:
        rows = values.alias("a").join(stats.alias("b"), _same("a", "b", by)).select("a.*", *[f"b._b{i}" for i in range(len(columns))])
        field = lambda i, name, k: F.col(f"_b{i}")[name][k]
        many = lambda i: F.col(f"_b{i}.n") > accuracy
    else:
        rows, row = values, stats.first()
        field = lambda i, name, k: F.lit(row[f"_b{i}"][name][k] if row[f"_b{i}"]["n"] else None).cast("double")
        many = lambda i: F.lit(row[f"_b{i}"]["n"] > accuracy)

    def edge(i: int, name: str, k: int) -> Column:
        """A bracket's end; open where the sketch cannot tell neighbours apart."""
        return F.when(many(i), field(i, name, k)).otherwise(float("-inf") if name == "low" else float("nan"))  # NaN sorts last

    def keys(open_: bool) -> Column:
        pairs = []
        for i, c in enumerate(columns):
            lows, highs = [[edge(i, name, k) for k in range(len(ordered))] for name in ("low", "high")]
            key = _bracket_key(F.col(f"_v{i}"), [F.lit(float("-inf"))] if open_ else lows, [F.lit(float("nan"))] if open_ else highs)
            pairs.append(F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.lit(c).alias("column"), key.alias("key"))))
        return F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("_pair")

    places = []
    for k, p in enumerate(ordered):
        for side, place in enumerate((F.floor(F.lit(p) * F.col("_last")), F.ceil(F.lit(p) * F.col("_last")))):
            places.append(F.struct(F.lit(k).alias("i"), F.lit(side).alias("side"), place.alias("place")))

    def select(open_: bool) -> DataFrame:
        counts = rows.select(*by, keys(open_)).groupBy(*by, "_pair.column", "_pair.key").agg(F.count(F.lit(1)).alias("_n"))
        whole = Window.partitionBy(*group)  # the keys of a column: brackets are narrow, so few
        before = F.coalesce(F.sum("_n").over(whole.orderBy("key").rowsBetween(*_BEFORE)), F.lit(0))
        ranked = counts.select(*group, "key", "_n", before.alias("_low"), (F.sum("_n").over(whole) - 1).alias("_last"))
        wanted = F.filter(F.array(*places), lambda s: (s["place"] >= F.col("_low")) & (s["place"] < F.col("_low") + F.col("_n")))
        hits = ranked.select(*group, "key", "_last", F.explode(wanted).alias("_slot"))
        found = hits.groupBy(*group, F.col("_slot.i").alias("_i")).agg(
            F.max("_last").alias("_last"), F.max("key.outside").alias("_outside"),
            F.max(F.when(F.col("_slot.side") == 0, F.col("key.at"))).alias("_a"),
            F.max(F.when(F.col("_slot.side") == 1, F.col("key.at"))).alias("_b"),
        )
        place = F.element_at(F.array(*[F.lit(p) for p in ordered]), F.col("_i") + 1) * F.col("_last")
        value = F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))
        return durable(found.groupBy(*group).agg(
            F.map_from_entries(F.collect_list(F.struct("_i", value.alias("_q")))).alias("_all"), F.max("_outside").alias("_outside")
        ))

    found = select(False)
    if not found.where("_outside").isEmpty():
        found = select(True)
    asked = stats.select(*by, F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return asked.alias("a").join(found.alias("b"), _same("a", "b", group), "left").select(
        "a.*", F.when(F.col("b._all").isNotNull(), F.array(*[F.col("b._all")[ordered.index(p)] for p in probs])).alias("q")
    )


def quantile_values(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Fitted quantiles of one column as driver scalars (parameters)."""
    row = exact_quantiles(df, [column], probs).first()
    return [None] * len(probs) if row is None or row["q"] is None else list(row["q"])
