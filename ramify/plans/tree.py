"""Recursion trees as tables, without recursion: each node's path is in its number, as in a heap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "[0,1]"


def depth_of(n: int, threshold: int) -> int:
    """Levels below the root until every range has at most threshold elements."""
    depth = 0
    while n > threshold:
        n, depth = (n + 1) // 2, depth + 1
    return depth


def midpoint(low: Column, high: Column) -> Column:
    return low + F.floor((high - low) / 2)


def range_tree(spark: SparkSession, n: int, threshold: int) -> DataFrame:
    """The nodes that halving [0, n - 1] makes until ranges have at most threshold elements.

    problem_id, parent_id, level, child_idx (0: right half, 1: left half), from_idx, to_idx, is_leaf. A node's heap number has
    its path in binary: the ranges are folded along it in parallel, for all nodes at once. No node for n = 0.
    """
    if threshold < 1:
        raise ValueError("a range can't be divided below one element")
    depth = depth_of(n, threshold)
    heap = spark.range(1, 1 << depth + 1 if n else 1).select(F.col("id").alias("heap"))
    level = (F.length(F.bin("heap")) - 1).cast("int")
    path = F.when(F.col("level") > 0, F.split(F.substring(F.bin("heap"), 2, 64), "")).otherwise(F.array().cast("array<string>"))
    nodes = heap.select("heap", level.alias("level")).select("level", F.filter(path, lambda b: b != "").alias("path"))

    def step(at: Column, bit: Column) -> Column:
        low, high = at["low"], at["high"]
        mid = midpoint(low, high)
        size = high - low + 1
        return F.struct(F.when(bit == "0", mid + 1).otherwise(low).alias("low"), F.when(bit == "0", high).otherwise(mid).alias("high"), (at["alive"] & (size > threshold)).alias("alive"))

    start = F.struct(F.lit(0).cast("long").alias("low"), F.lit(n - 1).cast("long").alias("high"), F.lit(True).alias("alive"))
    found = nodes.select("level", "path", F.aggregate("path", start, step).alias("at")).where("at.alive")
    label = lambda bits: F.concat(F.lit(ROOT), F.array_join(F.transform(bits, lambda b: F.concat(F.lit("["), b, F.lit(",2]"))), ""))
    parent = F.when(F.col("level") > 0, label(F.slice("path", 1, F.greatest(F.col("level") - 1, F.lit(0)))))
    return found.select(label(F.col("path")).alias("problem_id"), parent.alias("parent_id"), "level", F.when(F.col("level") > 0, F.element_at("path", -1).cast("int")).alias("child_idx"), F.col("at.low").alias("from_idx"), F.col("at.high").alias("to_idx"), (F.col("at.high") - F.col("at.low") + 1 <= threshold).alias("is_leaf"))


def range_label(low: Column, high: Column) -> Column:
    """A range by its bounds, a single element by itself."""
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("x", low.cast("string"), high.cast("string")))


def fanout_counts(tree: DataFrame) -> DataFrame:
    """For each level, divided nodes, tasks that they invoke (all children but one each) and those that a parent becomes: its
    last child. Children are counted from the tree."""
    children = tree.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("problem_id")).agg(F.count("*").alias("children"))
    inner = tree.where(~F.col("is_leaf")).join(children, "problem_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return inner.groupBy("level").agg(F.count("*").alias("fanouts"), F.sum(F.col("children") - 1).alias("invoked"), F.count_if(F.col("children") > 0).alias("becomes"))


def at_level(tree: DataFrame, level: int) -> DataFrame:
    """The nodes that get their input at a level: those of that level, and leaves above it."""
    return tree.where((F.col("level") == level) | F.col("is_leaf") & (F.col("level") < level))


def with_leaf(tree: DataFrame, rows: DataFrame, position: str) -> DataFrame:
    """rows with the problem_id, from_idx and to_idx of the leaf that holds their position."""
    return with_node(tree.where("is_leaf"), rows, position)


def with_node(nodes: DataFrame, rows: DataFrame, position: str) -> DataFrame:
    """rows with the problem_id, from_idx and to_idx of the one of these nodes, whose ranges are disjoint, that holds them.

    Positions are divided by the least size to get an equi-join key; a node spans a few such cells.
    """
    leaves = nodes.select("problem_id", "from_idx", "to_idx")
    width = leaves.agg(F.min(F.col("to_idx") - F.col("from_idx") + 1)).first()[0] or 1
    cells = leaves.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("from_idx") / width), F.floor(F.col("to_idx") / width))))
    own = rows.withColumn("__cell", F.floor(F.col(position) / width))
    return own.join(cells, "__cell").where(F.col(position).between(F.col("from_idx"), F.col("to_idx"))).drop("__cell")


def slices(tree: DataFrame, rows: DataFrame, position: str, value: str, level: int | None = None) -> DataFrame:
    """For each leaf, or each node that gets its input at a level, the rows of its range: n, first and last value, sum."""
    met = with_node(tree.where("is_leaf") if level is None else at_level(tree, level), rows.select(F.col(position).alias("__pos"), F.col(value).alias("__value")), "__pos")
    return met.groupBy("problem_id", "from_idx", "to_idx").agg(F.count("*").alias("n"), F.min_by("__value", "__pos").alias("first_value"), F.max_by("__value", "__pos").alias("last_value"), F.sum("__value").alias("total"))
