"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Documents of a source are taken in
proportion to their words: the expected copies of a document are
min(cap, c x words), with c such that the expected words are the target. The
whole part of them is taken for certain; the fraction p is the probability of
one more copy, and these come from an order sample: documents are ranked by

    random odds / inclusion odds = (u / (1 - u)) / (p / (1 - p))

and taken in that order while they fit the words that are left. The size of the
sample is fixed in words, not in documents. Where the next document is longer
than what is left, the order goes on once more among the documents that are
not. The document that closes the gap is the one of the others whose size comes
nearest to the words still missing, or none.

No source is sorted in one task: ranks r are cut into about sqrt(rows) slots of
r / (1 + r), words are summed by (source, slot) with partial sums in the map
tasks, and only the slot in which the target is reached is ordered. That slot
lies near r = 1, where a document has a density of 4 p (1 - p), one at most, so
it holds at most about one slot's even share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.words import WORD
from panelscope.sources.durable import count_rows, durable

SHARE = 1.5  # words of the mix, as a multiple of all words
CAP = 2  # most copies of a document
WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
SEED = "mix"
SCALE = 2.0**52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*labels) -> Column:
    """A number in (0, 1) with 52 bits, keyed by the labels; nulls count as empty."""
    key = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in labels])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(SCALE)


def source_targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP, weights=WEIGHTS) -> DataFrame:
    """source, source_size, weight, target from one row (source, source_size) per source.

    Targets share ``share`` times all words by weight; a target stops at
    ``cap`` times its source's words and what is above goes to the others by
    weight, until none is above. That fixed point fills sources in the order
    of cap / weight; the windows below run over one row per source, the
    categories of the mix, not over documents. Without any word all targets
    are 0.
    """
    if share > cap:
        raise ValueError("the mix cannot hold more words than the capped sources have")
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    first = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = first.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    table = sizes.select("source", "source_size", weight.alias("weight"))
    table = table.withColumn("limit", F.col("source_size") * float(cap))
    table = table.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level at the first source that it does not fill holds for all sources from there on
    table = table.withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    table = table.withColumn("level", F.min_by("level", F.when(F.col("open"), F.col("limit") / F.col("weight"))).over(everything))
    return table.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))).alias("target"))


def inclusion_rates(sizes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """source, rate: the c of min(cap, c x words), from one row (source, size, n) per distinct size of a source.

    The largest documents reach the cap first. With them set aside, c is what is
    left of the target over the sum of squares of the other sizes; it is right
    for the largest size that does not reach the cap with it. No rate where the
    target takes all documents ``cap`` times. Sums are whole numbers of 38
    digits, so their order does not matter; the window runs over distinct
    sizes, which the longest text bounds, not over documents.
    """
    words = (F.col("n").cast("decimal(19,0)") * F.col("size").cast("decimal(10,0)")).cast("decimal(38,0)")
    squares = (words.cast("decimal(28,0)") * F.col("size").cast("decimal(10,0)")).cast("decimal(38,0)")
    table = sizes.filter("size > 0").select("source", "size", words.alias("words"), squares.alias("squares"))
    down = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    up = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    table = table.select("source", "size", F.coalesce(F.sum("words").over(down).cast("double"), F.lit(0.0)).alias("capped"), F.sum("squares").over(up).cast("double").alias("rest"))
    table = table.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "target", "source_size")
    table = table.withColumn("rate", (F.col("target") - F.lit(float(cap)) * F.col("capped")) / F.col("rest"))
    fits = (F.col("rate") * F.col("size") <= float(cap)) & (F.col("target") < F.col("source_size") * float(cap))
    return table.filter(fits).groupBy("source").agg(F.max_by("rate", "size").alias("rate"))


ORDER = ("rank", "doc_id", "size", "at")


def _same(a: str, b: str) -> Column:
    return F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))


def _cut(rows: DataFrame) -> DataFrame:
    """source, edge, last, reached: how far the rows of a source go in order before they exceed its ``left`` words.

    The slots below ``edge`` are taken, and of that slot the rows up to
    ``last``; all rows where ``edge`` is null. ``reached`` counts their words.
    """
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    sums = durable(sums.withColumn("through", F.sum("words").over(W.partitionBy("source").orderBy("slot"))))
    over = F.col("through") > F.col("left")
    edges = sums.groupBy("source").agg(F.min(F.when(over, F.col("slot"))).alias("edge"), F.max("through").alias("all"), F.min(F.when(over, F.col("through") - F.col("words"))).alias("before"))
    edges = durable(edges)
    order = W.partitionBy("source").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.alias("a").join(edges.alias("b"), _same("source", "source") & (F.col("a.slot") == F.col("b.edge"))).select("a.*", "before")
    inside = inside.withColumn("through", F.col("before") + F.sum("size").over(order)).filter("through <= left")
    last = inside.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("last"), F.max("through").alias("reached"))
    return durable(edges.alias("a").join(last.alias("b"), _same("source", "source"), "left").select("a.source", "edge", "last", F.coalesce("reached", "before", "all").alias("reached")))


def _upto(edge: str, last: str) -> Column:
    """Whether a cut takes the row."""
    at_edge = (F.col("slot") == F.col(edge)) & F.coalesce(F.struct(*ORDER) <= F.col(last), F.lit(False))
    return F.col(edge).isNull() | (F.col("slot") < F.col(edge)) | at_edge


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, cap: int = CAP, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, expected: one row per row of ``docs``.

    ``expected`` is the document's expected number of copies. A null text has
    size 0; documents without words are not taken, unless their source is
    taken whole ``cap`` times. A null source is a
    source of its own, last in order. Repeated rows are documents of their own
    that share one random number, taken in the order of the written table; one
    of them may close the gap. Columns other than key, source and text are
    ignored, whatever their names. An empty table gives an empty result.
    """
    u = uniform(seed, F.col(key))
    base = durable(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), u.alias("u"), F.monotonically_increasing_id().alias("at")))
    slots = max(16, math.isqrt(count_rows(base)))
    sizes = durable(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = durable(source_targets(totals, share, cap, weights).select("source", "source_size", "target"))
    rates = inclusion_rates(sizes, targets, cap)
    targets = targets.alias("a").join(rates.alias("b"), _same("source", "source"), "left").select("a.*", "b.rate")
    whole = F.col("rate").isNull() & (F.col("target") > 0)  # no rate: the source is taken whole
    expected = F.when(whole, float(cap)).otherwise(F.least(F.lit(float(cap)), F.coalesce("rate", F.lit(0.0)) * F.col("size")))
    sure = F.floor(expected)
    certain = sizes.alias("a").join(targets.alias("b"), _same("source", "source")).groupBy("a.source").agg(F.sum(sure * F.col("n") * F.col("size")).alias("certain"))
    targets = durable(targets.alias("a").join(certain.alias("b"), _same("source", "source")).select("a.*", (F.col("target") - F.col("certain")).alias("left")))

    rows = base.alias("a").join(targets.alias("b"), _same("source", "source")).select("a.*", "source_size", "target", "left", expected.alias("expected"), sure.alias("sure"))
    p = F.col("expected") - F.col("sure")
    rows = rows.withColumn("rank", F.when(p > 0, F.col("u") / (1 - F.col("u")) / (p / (1 - p))))
    rows = rows.withColumn("slot", F.floor(F.col("rank") / (1 + F.col("rank")) * slots))
    drawn = rows.filter("rank is not null").select("source", "slot", *ORDER, "left")
    first = _cut(drawn)
    drawn = drawn.alias("a").join(first.alias("b"), _same("source", "source")).select("a.*", "edge", "last", "reached")
    passed = drawn.filter(~_upto("edge", "last")).withColumn("left", F.col("left") - F.col("reached")).drop("edge", "last", "reached")
    second = _cut(passed.filter("size <= left")).select("source", F.col("edge").alias("edge2"), F.col("last").alias("last2"), F.col("reached").alias("reached2"))
    cuts = durable(first.alias("a").join(second.alias("b"), _same("source", "source"), "left").select("a.*", "edge2", "last2", "reached2"))
    in_second = F.col("reached2").isNotNull() & (F.col("size") <= F.col("left")) & _upto("edge2", "last2")
    rest = passed.alias("a").join(cuts.alias("b"), _same("source", "source")).select("a.*", "edge2", "last2", "reached2")
    gap = F.col("left") - F.coalesce("reached2", F.lit(0))
    rest = rest.filter(~in_second).withColumn("off", F.abs(gap - F.col("size"))).filter(F.col("off") < gap)
    closing = rest.groupBy("source").agg(F.min(F.struct("off", *ORDER)).alias("close")).select("source", F.col("close.at").alias("close"))
    cuts = durable(cuts.alias("a").join(closing.alias("b"), _same("source", "source"), "left").select("a.*", "close"))

    result = rows.alias("a").join(cuts.alias("b"), _same("source", "source"), "left").select("a.*", *[f"b.{c}" for c in cuts.columns if c != "source"])
    result = result.withColumn("first", _upto("edge", "last")).withColumn("left", F.col("left") - F.col("reached"))
    closes = F.coalesce(F.col("at") == F.col("close"), F.lit(False))  # one row, whatever others equal it
    extra = F.when(F.col("rank").isNull(), 0).otherwise((F.col("first") | in_second | closes).cast("int"))
    copies = (F.col("sure") + extra).cast("long")
    return result.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "expected")
