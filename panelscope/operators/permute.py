"""Permutations and cluster-bootstrap draws as tables.

Everything is derived from keyed uniforms, so replicates are rows: no driver
loop, no per-replicate job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import Keys, draw_index, uniform
from ..sources.durable import MADE_ROWS, count_rows, durable, spread, with_rows
from .ordering import row_numbers

# Units whose positions one task sorts.
RANGE_ROWS = 200_000
# Units that a task holds while it shuffles them for its replicates, and the shuffled values it makes.
HELD_UNITS = 1_000_000
HELD_SLOTS = 64_000_000


def replicates(df: DataFrame, n: int, column: str = "rep") -> DataFrame:
    """Each row once per replicate 1..n (explode, no join); the rows are dealt over tasks first."""
    return spread(df, int(n)).withColumn(column, F.explode(F.sequence(F.lit(1), F.lit(int(n)))))


def permuted_values(
    df: DataFrame, unit: str, value: str, n_replicates: int, seed: int = 42,
    keep: Sequence[str] = (), range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(rep, unit, keep..., value): values shuffled across units per replicate.

    A replicate orders units by a keyed uniform; the unit at position i takes
    the value of unit number i.  Positions are exact row numbers.  When a
    replicate has more units than one task should sort, positions are computed
    in equal-width ranges of the uniform, which are balanced by construction.
    """
    numbered = durable(row_numbers(df.select(unit, value, *keep), unit, "_i"))
    rows = count_rows(numbered)
    # only (rep, uniform, number) is shuffled and sorted; numbers follow unit order
    slots = replicates(with_rows(numbered.select("_i", unit), rows), n_replicates).select(
        F.col("rep"), F.col("_i").cast("int" if rows < 2**31 else "bigint").alias("_i"), uniform(seed, F.col("rep"), F.col(unit)).alias("_u")
    )
    pieces = 1 if rows <= range_rows else 2 * -(-rows // range_rows)
    if pieces == 1:
        w = Window.partitionBy("rep").orderBy("_u", "_i")
        placed = slots.select("rep", "_i", F.row_number().over(w).alias("_pos"))
    else:
        tagged = slots.withColumn("_range", F.floor(F.col("_u") * pieces))
        before = Window.partitionBy("rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = tagged.groupBy("rep", "_range").agg(F.count(F.lit(1)).alias("_rows")).select(
            "rep", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
        )
        w = Window.partitionBy("rep", "_range").orderBy("_u", "_i")
        placed = (
            tagged.withColumn("_local", F.row_number().over(w)).join(offsets, ["rep", "_range"])
            .select("rep", "_i", (F.col("_local") + F.col("_before")).alias("_pos"))
        )
    values = numbered.select(F.col("_i").alias("_pos"), value)
    return placed.join(numbered.select("_i", unit, *keep), "_i").join(values, "_pos").select("rep", unit, *keep, value)


def held_replicates(numbered: DataFrame, unit: str, n_replicates: int, seed: int, terms, schema: str) -> DataFrame:
    """Rows that ``terms(table, orders)`` makes, where tasks hold the units and share the replicates.

    ``numbered`` has at most ``HELD_UNITS`` rows with numbers ``_i`` from 1.
    Its rows travel to every block of replicates, so that a task needs no row
    per unit and replicate: ``table`` is in order of ``_i``, and ``orders``
    are the permutations of ``permuted_values`` as (rep, numbers by position).
    """
    rows, reps = count_rows(numbered), int(n_replicates)
    slots = rows * reps
    blocks = min(reps, max(1, -(-slots // HELD_SLOTS), min(32, -(-slots // 1_000_000))))
    tail = F.coalesce(F.concat(F.lit(":"), F.col(unit).cast("string")), F.lit("")).cast("binary")
    travelling = spread(with_rows(numbered.withColumn("_tail", tail).drop(unit), rows), blocks)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        block = table.column("_block")[0].as_py()
        keys = Keys(table.column("_tail").to_pylist())
        return terms(table, keys.orders(seed, range(block + 1, reps + 1, blocks)))

    copies = travelling.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return copies.repartitionByRange(blocks, "_block").groupBy("_block").applyInArrow(run, schema)


def permuted_cells(
    df: DataFrame, unit: str, row: str, column: str, n_replicates: int, seed: int = 42, held_units: int = HELD_UNITS
) -> DataFrame:
    """(rep, row, column, _o): non-empty cell counts after ``permuted_values`` of ``column``."""
    table = durable(df.select(unit, row, column))
    if count_rows(table) > held_units:
        shuffled = permuted_values(table, unit, column, n_replicates, seed, keep=[row])
        return shuffled.groupBy("rep", row, column).agg(F.count(F.lit(1)).alias("_o"))
    types = dict(table.dtypes)
    numbered = durable(row_numbers(table.select(F.col(unit).alias("_u"), F.col(row).alias("_r"), F.col(column).alias("_c")), "_u", "_i"))

    def terms(held: pa.Table, orders) -> pa.Table:
        (r, rows), (c, columns) = (_coded(held.column(n)) for n in ("_r", "_c"))
        out = {"rep": [], "cell": [], "_o": []}
        for rep, order in orders:
            counts = np.bincount(r[order] * len(columns) + c, minlength=len(rows) * len(columns))
            cell = np.flatnonzero(counts)
            out["rep"].append(np.full(len(cell), rep, np.int32))
            out["cell"].append(cell)
            out["_o"].append(counts[cell])
        rep, cell, n = (np.concatenate(v) for v in out.values())
        return pa.table({
            "rep": pa.array(rep, pa.int32()), "_r": rows.take(pa.array(cell // len(columns))),
            "_c": columns.take(pa.array(cell % len(columns))), "_o": pa.array(n, pa.int64()),
        })

    cells = held_replicates(numbered, "_u", n_replicates, seed, terms, f"rep int, _r {types[row]}, _c {types[column]}, _o bigint")
    return cells.select("rep", F.col("_r").alias(row), F.col("_c").alias(column), "_o")


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(codes, labels); null is a label."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _drawn(units: DataFrame, unit: str, n_replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Numbered units, and (rep, number) of the unit that each slot of each replicate takes."""
    distinct = durable(units.select(unit).distinct())
    n = count_rows(distinct)
    numbered = durable(row_numbers(distinct, unit, "_index", start=0))
    slots = replicates(with_rows(numbered.select(F.col("_index").alias("_slot")), n), n_replicates)
    return numbered, slots.select("rep", draw_index(n, seed, F.col("rep"), F.col("_slot")).alias("_index"))


def cluster_draws(units: DataFrame, unit: str, n_replicates: int, seed: int = 42) -> DataFrame:
    """(rep, unit, mult): n units drawn with replacement per replicate.

    Slot i of replicate r takes unit number floor(u(r, i) * n).  Multiplicity
    is carried as a weight; rows are never copied.
    """
    numbered, drawn = _drawn(units, unit, n_replicates, seed)
    mult = drawn.groupBy("rep", "_index").agg(F.count(F.lit(1)).alias("mult"))
    return mult.join(numbered, "_index").select("rep", unit, "mult")


def drawn_replicates(units: DataFrame, unit: str, n_replicates: int, seed: int = 42, output: str = "reps") -> DataFrame:
    """(unit, reps): the replicates of ``cluster_draws`` that draw a unit, each once, as an array.

    Units that no replicate draws are left out.  Draws go straight to their
    unit, dealt over tasks of about ``MADE_ROWS`` draws each.
    """
    numbered, drawn = _drawn(units, unit, n_replicates, seed)
    tasks = max(1, -(-count_rows(numbered) * int(n_replicates) // MADE_ROWS))
    lists = drawn.repartition(tasks, "_index").groupBy("_index").agg(F.collect_set("rep").alias(output))
    return lists.join(numbered, "_index").select(unit, output)


def draw_vectors(units: DataFrame, unit: str, n_replicates: int, seed: int = 42) -> DataFrame:
    """(unit, mult): ``cluster_draws`` with one array per unit, place r - 1 for replicate r.

    Units that no replicate draws are left out.  A unit is drawn about once a
    replicate, so its list of draws is about as long as its vector.
    """
    numbered, drawn = _drawn(units, unit, n_replicates, seed)
    size = int(n_replicates)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                reps = part.column("reps")
                row = np.repeat(np.arange(part.num_rows), reps.value_lengths().to_numpy())
                mult = np.bincount(row * size + reps.flatten().to_numpy() - 1, minlength=part.num_rows * size)
                offsets = pa.array(np.arange(part.num_rows + 1) * size, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("_index"), pa.ListArray.from_arrays(offsets, pa.array(mult, pa.int64()))], ["_index", "mult"])

    lists = drawn.groupBy("_index").agg(F.collect_list("rep").alias("reps"))
    return lists.mapInArrow(dense, "_index bigint, mult array<bigint>").join(numbered, "_index").select(unit, "mult")


def weighted_replicates(rows: DataFrame, draws: DataFrame, unit: str) -> DataFrame:
    """Rows of drawn units once per replicate, with ``mult`` as weight."""
    return rows.join(draws, unit)
