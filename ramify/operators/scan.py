"""Ordered prefix scans in two steps: within ranges, and over the totals of ranges.

This is divide and conquer for what SQL writes as a window without, or with few, partition keys: such a window would sort a
whole key in one task. Here a range exchange on (keys, order) splits hot keys too; the totals are one row for each key
and range that share rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import partitions, written

RANGE = "__range"

#: How values are put together, by name: the aggregate, and the same for two values, of which either may be null.
KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def _with_totals(local: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of local beside what lies below their range, by range and keys. Without keys that is one row a range."""
    on = F.col(RANGE) == F.col("__of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return local.join(totals if keys else F.broadcast(totals), on)


def _below(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def prefix(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, Column], name: str = "scan", kinds: dict[str, str] | None = None, before: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each entry of values, the sum of the expression, or what kinds names for it, over the rows of the same keys up
    to and including this one, or, for the names in before, up to the one before it.

    Rows of equal order are taken in any sequence, so order should end in a unique column. An empty table stays empty.
    """
    how = {k: KINDS[(kinds or {}).get(k, "sum")] for k in values}
    own = df.withColumns({f"__add_{k}": v for k, v in values.items()})
    ranged = own.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn(RANGE, F.spark_partition_id())
    ranged = written(ranged, name)
    totals = ranged.groupBy(*keys, RANGE).agg(*(how[k][0](f"__add_{k}").alias(f"__sum_{k}") for k in values))
    totals = totals.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col(RANGE).alias("__of"), *(how[k][0](f"__sum_{k}").over(_below(keys)).alias(f"__below_{k}") for k in values))
    within = Window.partitionBy(RANGE, *keys).orderBy(*order)
    up_to = {k: within.rowsBetween(Window.unboundedPreceding, -1 if k in before else 0) for k in values}
    local = ranged.withColumns({k: how[k][0](f"__add_{k}").over(up_to[k]) for k in values})
    return _with_totals(local, totals, keys).select(*df.columns, *(how[k][1](F.col(k), F.col(f"__below_{k}")).alias(k) for k in values))


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank", name: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row among those of its keys.

    One exchange, by range: a row's number in its sorted range is written with it, so places are differences of numbers.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = written(ranged.withColumn("__id", F.monotonically_increasing_id()), name).withColumn(RANGE, F.shiftright("__id", 33))
    totals = ranged.groupBy(*keys, RANGE).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    totals = totals.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col(RANGE).alias("__of"), "__first", F.coalesce(F.sum("__n").over(_below(keys)), F.lit(0)).alias("__before"))
    return _with_totals(ranged, totals, keys).select(*df.columns, (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias(rank))
