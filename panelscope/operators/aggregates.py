"""Grouped summaries of panels and small derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide
from .ordering import exact_quantiles


def unit_means(df: DataFrame, columns: Sequence[str], unit: str = "District", extra: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(unit, *extra).agg(*[F.avg(c).alias(c) for c in columns])


def unit_profile(df: DataFrame, columns: dict[str, str], unit: str = "District", flag: str = "Disaster_Occurred") -> DataFrame:
    """Means (input -> output), event total and event rate per unit."""
    return df.groupBy(unit).agg(
        *[F.avg(c).alias(o) for c, o in columns.items()],
        F.sum(flag).alias("Total_Events"),
        F.avg(flag).alias("Event_Rate"),
    )


def events_per(df: DataFrame, by: Sequence[str], flag: str = "Disaster_Occurred") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(flag).alias("n_events"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), column)


def compound_rates(
    df: DataFrame, flag: str = "Compound_Event", kind: str = "Disaster_Type", group: str = "Region"
) -> DataFrame:
    """Overall rate, counts by dominant type and rates by group, one scan.

    Rows are aggregated to (group, type) before the three summaries.
    """
    cells = df.groupBy(group, kind).agg(
        F.sum(F.col(flag)).alias("n_flag"), F.count(F.lit(1)).alias("n_rows")
    )
    sets = cells.groupingSets(
        [[], [F.col(kind)], [F.col(group)]], F.col(kind), F.col(group)
    ).agg(
        F.grouping(kind).alias("g_kind"), F.grouping(group).alias("g_group"),
        F.sum("n_flag").alias("n_flag"), F.sum("n_rows").alias("n_rows"),
    )
    by_kind, by_group = F.col("g_kind") == 0, F.col("g_group") == 0
    return sets.where(~by_kind | (F.col("n_flag") > 0)).select(
        F.when(by_kind, "type").when(by_group, "region").otherwise("overall").alias("level"),
        F.when(by_kind, F.col(kind)).when(by_group, F.col(group)).otherwise("all").alias("label"),
        F.col("n_flag").cast("bigint").alias("n_compound"),
        F.round(F.col("n_flag") / F.col("n_rows"), 4).alias("rate"),
    )


def modal_category(df: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """Most frequent category per group; ties give the smallest label.

    Counts combine map side; the winner is chosen by ``min_by`` over counts.
    """
    counts = df.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(
        F.min_by(category, F.struct(-F.col("_n"), F.col(category))).alias(category)
    )


def crosstab(df: DataFrame, row: str, column: str, labels: Sequence[str]) -> DataFrame:
    """Wide zero-filled counts with the given column labels."""
    counts = df.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in labels]
    )
    return counts


def crosstab_long(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) including the empty cells.

    Row and column labels are dimensions; empty cells come from exploding the
    collected label set per row label (label count, not data, sized).
    """
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    per_row = counts.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("_m"))
    labels = [r[0] for r in counts.select(column).distinct().orderBy(column).collect()]
    return per_row.withColumn(column, F.explode(F.array(*[F.lit(v) for v in labels]))).select(
        row, column, F.coalesce(F.col("_m")[F.col(column)], F.lit(0)).alias("n")
    )


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long Pearson matrix from one aggregation (p x p output)."""
    columns = list(columns)
    wide = df.agg(
        *[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    )
    entries = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            value = F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")
            entries.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("corr")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def split_summary(df: DataFrame, split: str, target: str) -> DataFrame:
    """Rows, share of usable rows and positive rate per split, and the rows without target."""
    per = df.groupBy(split).agg(
        F.count(target).alias("n_rows"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        F.count_if(F.col(target).isNull()).alias("dropped_rows"),
    )
    everything = Window.partitionBy()  # one row per split
    return per.select(
        split, "n_rows",
        divide(F.lit(100.0) * F.col("n_rows"), F.sum("n_rows").over(everything)).alias("percentage"),
        "positive_rate", "dropped_rows",
    )


def cluster_summary(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_units"), *[F.round(F.avg(c), 3).alias(c) for c in columns]
    )


def five_number_by_flag(df: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Box-plot numbers per flag value: quartiles and data-bound whiskers.

    Quartiles are exact and small in number, so they travel as literals into
    the second pass that finds the whiskers.
    """
    quartiles = {
        (r[flag], r["column"]): r["q"] for r in exact_quantiles(df, columns, [0.25, 0.5, 0.75], by=[flag]).collect()
    }
    flags = sorted({k[0] for k in quartiles if k[0] is not None})

    def bound(c, side):
        chain = None
        for f in flags:
            q = quartiles.get((f, c))
            if not q:
                continue
            width = 1.5 * (q[2] - q[0])
            value = F.lit(q[0] - width if side == "low" else q[2] + width)
            chain = F.when(F.col(flag) == f, value) if chain is None else chain.when(F.col(flag) == f, value)
        return chain

    aggs = []
    for i, c in enumerate(columns):
        inside = (F.col(c) >= bound(c, "low")) & (F.col(c) <= bound(c, "high"))
        aggs += [
            F.min(F.when(inside, F.col(c))).alias(f"low_{i}"),
            F.max(F.when(inside, F.col(c))).alias(f"high_{i}"),
        ]
    wide = df.where(F.col(flag).isNotNull()).groupBy(flag).agg(*aggs)
    entries = []
    for i, c in enumerate(columns):
        pick = [F.lit(None).cast("double")] * 3
        for f in flags:
            q = quartiles.get((f, c))
            if q:
                pick = [F.when(F.col(flag) == f, F.lit(q[k])).otherwise(pick[k]) for k in range(3)]
        entries.append(
            F.struct(
                F.lit(c).alias("variable"), F.col(f"low_{i}").alias("whisker_low"),
                pick[0].alias("q25"), pick[1].alias("median"), pick[2].alias("q75"),
                F.col(f"high_{i}").alias("whisker_high"),
            )
        )
    return wide.select(flag, F.explode(F.array(*entries)).alias("e")).select(flag, "e.*")


def first_value_by_unit(df: DataFrame, columns: Sequence[str], unit: str = "District", period: str = "Event_Date") -> DataFrame:
    return df.groupBy(unit).agg(*[F.min_by(c, period).alias(c) for c in columns])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (2 n_c) per class and neg / max(1, pos)."""
    everything = Window.partitionBy()  # one row per class
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = F.sum("n_class").over(everything)
    positives = F.sum(F.when(F.col(label) == 1, F.col("n_class")).otherwise(0)).over(everything)
    return counts.select(
        label, "n_class",
        (total / (F.lit(2.0) * F.col("n_class"))).alias("weight"),
        ((total - positives) / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )


def join_typology(
    df: DataFrame, typology: DataFrame | None, unit: str = "District",
    columns: Sequence[str] = ("Cluster", "Cluster_Label", "Policy_Quadrant"),
) -> DataFrame:
    """Left join of unit labels; -1 / 'Unknown' where no label exists.

    A plain equi-join: broadcast below the auto-broadcast size, shuffled beyond.
    """
    def fallback(c):
        return F.lit(-1) if c == "Cluster" else F.lit("Unknown")

    if typology is None:
        return df.withColumns({c: fallback(c) for c in columns})
    joined = df.join(typology.select(unit, *columns), unit, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), fallback(c)) for c in columns})


def top_k(df: DataFrame, k: int, value: str, tie: str, descending: bool = True) -> DataFrame:
    """k rows by value, ties by id: per-task heaps, no global sort."""
    return df.orderBy(F.col(value).desc() if descending else F.col(value).asc(), F.col(tie)).limit(k)
