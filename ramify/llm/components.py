"""Connected components over links of any number, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """(a long, b long), in any direction, to (node, root): root is the least node that can be reached. Roots and
    nodes without links have no row.

    A star round takes the least neighbour of each node by partial sums and joins it back to the links. The least neighbours are
    written first: both sides of the join are then plain exchanges, and adaptive execution splits a node with very many links;
    an aggregation right under a join it would not. No list of links is collected. Each round is written to the shared
    folder; the rounds grow with the logarithm of the longest chain.
    """
    at = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at, before = table(at, "links"), None
    while (now := _state(at)) != before and now[0]:
        before = now
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = table(large, "large")
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        at = table(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
