"""Connected components of a table of links, by alternating large-star and small-star rounds.

Links stay in the shared folder; the driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.sources.durable import durable


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root from links (u, v): root is the smallest node that can be reached. Nodes without a link are absent."""
    ends = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = durable(links.filter("u != v").select(*ends("u", "v")).distinct())
    state = _state(links)
    while state[0]:
        both = links.select("u", "v").union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        links = durable(small.filter("u != v").distinct())
        if state == (state := _state(links)):
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
