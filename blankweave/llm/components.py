"""Connected components of a table of links, by alternating large and small stars.

Each round is a few joins and grouped minima that combine before the shuffle; each
round's links are written to the shared folder, so the lineage stays short and a lost
executor costs one round at most. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b) the smallest node it reaches, itself included.

    Links from a node to itself and repeated links change nothing; nulls link nothing.
    """
    pairs = links.where("a is not null and b is not null and a <> b")
    now = shared.cut(pairs.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links")
    before, state = None, _state(now)
    while state[0] and state != before:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).union(now.select(F.col("low"), F.col("high")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = (
            large.join(lowest, "high")
            .select(F.explode(F.array(F.struct("high", F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))).alias("l"))
            .select("l.*").where("high <> low").distinct()
        )
        after = shared.cut(small, "links")
        shared.drop_cut(now)
        now, before, state = after, state, _state(after)
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        now.select(F.col("low"), F.col("low")).distinct()
    )
