"""Panel assembly: densification, balance, keys and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..schema import CLIPPED_COLUMNS
from ..sources.durable import count_rows, known_rows, spread, with_rows

# Rows that one task sums, about as many as a task of 60 times sf0.1 with 24 partitions.
TASK_ROWS = 2_000_000


def _n_months(span) -> int:
    return (span["hi"].year - span["lo"].year) * 12 + span["hi"].month - span["lo"].month + 1


def panel_complete(
    facts: DataFrame,
    units: DataFrame,
    unit: str,
    period: str,
    fills: dict[str, object],
) -> DataFrame:
    """Balanced unit x month panel.

    Every unit gets one row per month between the first and last observed
    month; absent cells take the value in ``fills``.  The month list is
    expanded per unit with ``explode``, so no cross join is planned.  Check
    the facts with ``duplicate_keys`` first: duplicates would be kept.
    """
    span = facts.agg(F.min(period).alias("lo"), F.max(period).alias("hi")).first()
    if span["lo"] is None:
        return units.select(unit).limit(0).withColumn(period, F.lit(None).cast("date")).join(
            facts, [unit, period], "left"
        )
    months = F.sequence(F.lit(span["lo"]), F.lit(span["hi"]), F.expr("interval 1 month"))
    spine = spread(units.select(unit).distinct(), _n_months(span)).withColumn(period, F.explode(months))
    joined = spine.join(facts, [unit, period], "left")
    return joined.select(
        unit,
        period,
        *[
            F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
            for c in facts.columns
            if c not in (unit, period)
        ],
    )


def panel_complete_sums(
    facts: DataFrame, units: DataFrame, unit: str, period: str, sums: dict[str, object]
) -> DataFrame:
    """Aggregate row-level facts to a balanced panel in one shuffle.

    Zero-valued spine rows are unioned to the facts and both are summed by
    (unit, period); absent cells come out as zero without a join.  The units
    are dealt over tasks first, as each makes a row per month.  The rows are
    dealt by cell before they are summed: a task that reads a file meets about
    as many cells as rows, so sums made there would only fill its memory.  A
    large unit spreads over its months.  Tasks grow in number with the rows
    where the session's number would give them more than ``TASK_ROWS``.
    ``sums`` maps output names to column expressions over ``facts``.
    """
    span = facts.agg(F.min(period).alias("lo"), F.max(period).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    n_rows = span["n"]
    rows = facts.select(unit, period, *[c.alias(n) for n, c in sums.items()])
    if span["lo"] is not None:
        months = F.sequence(F.lit(span["lo"]), F.lit(span["hi"]), F.expr("interval 1 month"))
        types = dict(rows.dtypes)
        # a unit listed twice would only add zeros
        listed = units.select(unit)
        listed = with_rows(listed, count_rows(listed))
        n_rows += known_rows(listed) * _n_months(span)
        spine = spread(listed, _n_months(span)).select(
            unit,
            F.explode(months).alias(period),
            *[F.lit(0).cast(types[n]).alias(n) for n in sums],
        )
        rows = rows.unionByName(spine)
    tasks = -(-n_rows // TASK_ROWS)
    more = tasks > int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, unit, period) if more else rows.repartition(unit, period)
    return dealt.groupBy(unit, period).agg(*[F.sum(n).alias(n) for n in sums])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def panel_balance(df: DataFrame, unit: str, period: str, flag: str) -> DataFrame:
    """N units, T periods, rows, balance flag and prevalence.

    Distinct counts go through (unit) and (period) aggregates that combine map
    side, so a unit with a third of the rows is no bottleneck.
    """
    return df.agg(
        F.count_distinct(unit).alias("n_units"),
        F.count_distinct(period).alias("n_periods"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(flag).alias("prevalence"),
    ).withColumn("is_balanced", F.col("n_units") * F.col("n_periods") == F.col("n_rows"))


def clean_panel(
    df: DataFrame, date_column: str = "Event_Date", clipped: Sequence[str] = tuple(CLIPPED_COLUMNS)
) -> DataFrame:
    """Cast the date, drop exact duplicate rows, clip impacts at zero.

    Ordering belongs to the sink: see ``sort_panel``.
    """
    present = [c for c in clipped if c in df.columns]
    typed = df.withColumn(date_column, F.to_date(date_column)).dropDuplicates()
    types = dict(typed.dtypes)
    return typed.withColumns({c: clip(F.col(c), low=F.lit(0).cast(types[c])) for c in present})


def sort_panel(df: DataFrame, keys: Sequence[str] = ("Year", "Month", "District")) -> DataFrame:
    """Global order for a sink; a range-partitioned sort, not a single task."""
    return df.orderBy(*keys)


def distinct_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order`` (deterministic keep-first).

    ``min_by`` combines map side, so a key with very many rows is no hot task.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(first).select("_row.*")
