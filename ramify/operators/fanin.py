"""N-way fan-in: the last caller of a group goes on, with what the others have left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_combines(calls: DataFrame, key: str, order: list[str], result: Column) -> DataFrame:
    """For each fan-in of two callers or more: n, the last caller's own result and the others' in order of arrival, as text.

    A fan-in holds its callers' results, as many as the fan-in was made for, so it is collected as a list.
    """
    entry = F.struct(*order, result.alias("result"))
    found = calls.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("all")).where(F.size("all") > 1)
    others = F.transform(F.slice("all", 1, F.size("all") - 1), lambda x: x["result"].cast("string"))
    return found.select(key, F.size("all").cast("long").alias("n"), F.element_at("all", -1)["result"].alias("own"), F.array_join(others, ",").alias("others"))


def siblings(calls: DataFrame, key: str, rank: str, value: str) -> DataFrame:
    """Pairs of a two-way fan-in met by label: rank 2k - 1 with rank 2k of the same key."""
    left = calls.where(F.col(rank) % 2 == 1).select(key, ((F.col(rank) + 1) / 2).cast("long").alias("pair"), F.col(value).alias("first_value"))
    right = calls.where(F.col(rank) % 2 == 0).select(key, (F.col(rank) / 2).cast("long").alias("pair"), F.col(value).alias("second_value"))
    return left.join(right, [key, "pair"])


def received(calls: DataFrame, key: str, order: list[str], result: Column) -> DataFrame:
    """What the last child of a fan-out, which becomes its parent, is sent by the others: a row for each (key, sender, result).

    sender and receiver are structs of order. The receiver is found by an aggregation, so no child list is held.
    """
    own = calls.select(key, F.struct(*order).alias("sender"), result.alias("result"))
    last = calls.groupBy(key).agg(F.max(F.struct(*order)).alias("receiver"))
    return own.join(last, key).where(F.col("sender") < F.col("receiver"))
