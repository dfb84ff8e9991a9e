"""Linear recursion: Fibonacci numbers, their call trees and what memoizing them saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fibonacci(n: Column) -> Column:
    """fib(0) = 0, fib(1) = 1, exact up to fib(180); folded in the row, without a join."""
    wide = "decimal(38,0)"
    start = F.struct(F.lit(0).cast(wide).alias("a"), F.lit(1).cast(wide).alias("b"))
    steps = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, lambda at, _: F.struct(at["b"].alias("a"), (at["a"] + at["b"]).cast(wide).alias("b")))["a"]


def call_tree(spark: SparkSession, n: int) -> DataFrame:
    """The calls of naive fib(n) as a table (level, value, calls): how often each value is called at each level.

    A call at level l with value n - l - k took k steps of two among l, of which there are C(l, k) ways, for a
    value of 1 too; a zero has only a two above it. Calls alike are one row, so the table has some n * n rows for its exponential
    tree, each found by itself.
    """
    if n <= 1:
        return spark.range(1).select(F.lit(0).alias("level"), F.lit(n).alias("value"), F.lit(1).cast("long").alias("calls"))
    cells = spark.range(n + 1).select(F.col("id").alias("level"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("value"))
    zero = (F.col("value") == 0).cast("long")  # only a two has a zero under it, and that by a step of two
    cells = cells.select("level", "value", (F.col("level") - zero).alias("m"), (n - F.col("value") - F.col("level") - zero).alias("k")).where("k >= 0 AND k <= m")
    steps = F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("long"), F.col("k"))).otherwise(F.array().cast("array<bigint>"))
    ways = F.aggregate(steps, F.lit(1).cast("long"), lambda c, i: F.call_function("div", c * (F.col("m") - F.col("k") + i), i))
    return cells.select(F.col("level").cast("int").alias("level"), F.col("value").cast("int").alias("value"), ways.alias("calls"))


def leaf_sum(tree: DataFrame) -> DataFrame:
    """One row: the number of leaf calls, and the sum of their values, which is fib(n)."""
    leaves = tree.where("value <= 1")
    return leaves.agg(F.sum("calls").alias("leaves"), F.sum(F.col("calls") * F.col("value")).alias("total"))


def memo_savings(tree: DataFrame) -> DataFrame:
    """One row: calls of the naive tree, calls with memoized values (each value is divided once), and the difference."""
    made = tree.agg(F.sum("calls").alias("calls"), F.countDistinct("value").alias("n"), F.countDistinct(F.when(F.col("value") > 1, F.col("value"))).alias("inner"))
    return made.select("calls", (2 * F.col("inner") + 1).alias("memoized"), (F.col("calls") - 2 * F.col("inner") - 1).alias("saved"))
