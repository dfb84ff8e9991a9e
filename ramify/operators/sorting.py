"""Global and run-wise sorting, merging, and steps of quicksort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import ranked


def sort_global(df: DataFrame, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """The total order as a column; order must end in a unique tie-breaker."""
    return ranked(df, [], order, rank, "sort")


def sort_runs(df: DataFrame, run: str, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """The order within each run; a run as large as the table is split over tasks like any other rows."""
    return ranked(df, [run], order, rank, "runs")


def merge_runs(runs: list[DataFrame], order: list[Column | str], rank: str = "rank", run: str | None = None) -> DataFrame:
    """One order over several sorted runs, in all or within each value of run: a range exchange takes the place of pairwise merging."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    return ranked(merged, [run] if run else [], order, rank, "merge")


def merge_bounds(runs: DataFrame, parent: Column, low: str, high: str) -> DataFrame:
    """From the bounds of runs those of their parents: the least low and the greatest high."""
    return runs.groupBy(parent.alias("parent")).agg(F.min(low).alias(low), F.max(high).alias(high))


def sort_array(a: Column) -> Column:
    """A leaf's array sorted."""
    return F.array_sort(a)


def merge_arrays(a: Column, b: Column) -> Column:
    """Two sorted arrays merged."""
    return F.array_sort(F.concat(a, b))


def quicksort_step(df: DataFrame, value: str, position: str) -> DataFrame:
    """One partition step about the value at the last position: values not above it go left.

    One row: pivot_value, split (its 0-based place in order of the step), n_left ([from, split - 1]), n_right ([split, to], pivot
    included), max_left (of all values that go left), min_right (of the rest). An empty table gives no row.
    """
    pivot = df.agg(F.max_by(value, position)).scalar()
    low = F.col(value) <= F.col("pivot_value")
    out = df.select(value, pivot.alias("pivot_value")).agg(F.max("pivot_value").alias("pivot_value"), F.count("*").alias("n"), F.count_if(low).alias("low"), F.max(F.when(low, F.col(value))).alias("max_left"), F.min(F.when(~low, F.col(value))).alias("min_right"))
    return out.where("n > 0").select("pivot_value", (F.col("low") - 1).alias("split"), (F.col("low") - 1).alias("n_left"), (F.col("n") - F.col("low") + 1).alias("n_right"), "max_left", "min_right")


def quicksort_array(a: Column) -> Column:
    """Values not above the last one, without it, then the last one, then the rest: one step on an array."""
    pivot = F.element_at(a, -1)
    rest = F.slice(a, 1, F.size(a) - 1)
    return F.when(F.size(a) > 1, F.concat(F.filter(rest, lambda x: x <= pivot), F.array(pivot), F.filter(rest, lambda x: x > pivot))).otherwise(a)


def verify(sorted_: DataFrame, rank: str, value: str) -> DataFrame:
    """One row: rows, and neighbours by rank that are out of order or don't follow without a gap.

    Neighbours are met by an equi-join on rank, so that no window holds all rows.
    """
    after = sorted_.select((F.col(rank) - 1).alias("__rank"), F.col(value).alias("__next"))
    both = sorted_.select(rank, value).join(after, F.col(rank) == F.col("__rank"), "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("__next") < F.col(value)).alias("out_of_order"), (F.count("*") - F.count("__rank") - 1).alias("gaps"))


def differences(got: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows of either side, rows that only one side has, and values that differ."""
    a = got.select(*keys, F.col(value).alias("__a"), F.lit(1).alias("__got"))
    b = expected.select(*keys, F.col(value).alias("__b"), F.lit(1).alias("__expected"))
    both = a.join(b, keys, "full")
    here, there = F.col("__got").isNotNull(), F.col("__expected").isNotNull()
    return both.agg(F.count("*").alias("n"), F.count_if(~here).alias("missing"), F.count_if(~there).alias("surplus"), F.count_if(here & there & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("differ"))


def window_rank(df: DataFrame, run: str, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """For runs that are known to be small: the plain window."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("long"))
