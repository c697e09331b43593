"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """node, top: the smallest node of its component, for every node of ``links(a, b)``.

    Each round hangs every neighbour on the smallest one in reach, first those above a node, then those below; the stars meet after a number
    of rounds that follows the logarithm of a component's size. Minima are combined before the shuffle, so a hub of many links is no hot task.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        above = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(below.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("top")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("top")).distinct())
        before = now
