"""Reductions: scalar sums by tree level, and element-wise sums of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_sum(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.sum(value).alias("total"))


def leaf_sums(df: DataFrame, position: Column, value: Column, depth: int) -> DataFrame:
    """Partial sums of the 2**depth leaves that hold positions alike modulo their number: one pass, one row a leaf and task."""
    return df.groupBy(F.pmod(position, F.lit(1 << depth)).alias("node")).agg(F.sum(value).alias("total"))


def sums_by_level(df: DataFrame, position: Column, value: Column, depth: int) -> DataFrame:
    """The sums of all nodes of the tree, levels 0 to depth: upper levels add up the leaves, not the rows again."""
    leaves = leaf_sums(df, position, value, depth)
    at = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "node", "total")
    node = F.pmod("node", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")))
    return at.groupBy("level", node.alias("node")).agg(F.sum("total").alias("total"))


def combine_to_level(df: DataFrame, position: Column, value: Column, level: int) -> DataFrame:
    """Combining stops at a level: its 2**level partial results."""
    return leaf_sums(df, position, value, level)


def add_padded(a: Column, b: Column) -> Column:
    """Element by element; the shorter vector counts as ending in zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def vector_sum(df: DataFrame, vector: str) -> DataFrame:
    """The element-wise sum of all vectors: (pos, total), pos from 0. Partial sums by position before the exchange."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("total"))
