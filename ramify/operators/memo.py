"""Memoization by promise and delivery, replayed over an ordered log.

The first promise of a label computes; a later one before the delivery waits and is restarted by it; after it, the value is
there. A label's delivery is one row, found by an aggregation, so a label with a third of the log is no window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import prefix
from .trials import micros


def deliveries(log: DataFrame, label: str, ts: str, event: str, takes_us: Column) -> DataFrame:
    """For each label the first promise and when its value is delivered, in microseconds."""
    first = log.groupBy(label).agg(F.min(F.struct(micros(F.col(ts)).alias("at"), F.col(event).alias("event"), takes_us.alias("takes"))).alias("first"))
    return first.select(label, F.col("first.event").alias("computes"), (F.col("first.at") + F.col("first.takes")).alias("delivered_us"))


def outcomes(log: DataFrame, label: str, ts: str, event: str, takes_us: Column) -> DataFrame:
    """For each promise: compute, wait or hit."""
    both = log.select(event, label, micros(F.col(ts)).alias("promised_us")).join(deliveries(log, label, ts, event, takes_us), label)
    what = F.when(F.col(event) == F.col("computes"), "compute").when(F.col("promised_us") < F.col("delivered_us"), "wait").otherwise("hit")
    return both.select(event, label, what.alias("outcome"), "promised_us", "delivered_us")


def restarts(log: DataFrame, label: str, ts: str, event: str, takes_us: Column) -> DataFrame:
    """For each label with waiters how many its delivery restarts, and how long they waited in all."""
    waits = outcomes(log, label, ts, event, takes_us).where("outcome = 'wait'")
    return waits.groupBy(label).agg(F.count("*").alias("restarted"), F.sum(F.col("delivered_us") - F.col("promised_us")).alias("waited_us"))


def put_previous(log: DataFrame, label: str, ts: str, event: str, value: Column) -> DataFrame:
    """Get-and-put on a map: each put gives the value that the label had before, null at first. Puts are met by rank."""
    numbered = prefix(log.select(event, label, ts, value.alias("value")), [label], [ts, event], {"k": F.lit(1).cast("long")}, "puts")
    before = numbered.select(F.col(label).alias("__label"), (F.col("k") + 1).alias("__k"), F.col("value").alias("previous"))
    return numbered.join(before, F.col(label).eqNullSafe(F.col("__label")) & (F.col("k") == F.col("__k")), "left").select(event, label, "value", "previous")


def membership(added: DataFrame, removed: DataFrame, name: str) -> DataFrame:
    """Each added name once, and whether it is also removed: a semi join and an anti join. Null names are equal to none."""
    names = added.select(name).distinct()
    kept = names.join(removed.select(name), name, "left_anti").withColumn("removed", F.lit(False))
    return names.join(removed.select(name), name, "left_semi").withColumn("removed", F.lit(True)).unionByName(kept)


def live_names(log: DataFrame, name: str, ts: str, event: str, sign: Column) -> DataFrame:
    """How often each name is live after each add (+1) or remove (-1); more than 1 or less than 0 breaks the pairing rules."""
    return prefix(log.withColumn("sign", sign), [name], [ts, event], {"live": sign.cast("long")}, "names").select(event, name, "sign", "live", ((F.col("live") > 1) | (F.col("live") < 0)).alias("violation"))


def violations(log: DataFrame, label: str, ts: str, event: str, delivers: Column) -> DataFrame:
    """Deliveries that break the protocol: of a label that nobody has promised, or that has been delivered before. Null else.

    delivers: whether a message is a delivery; the others are promises.
    """
    at = log.select(event, label, ts, delivers.alias("delivers"))
    at = prefix(at, [label], [ts, event], {"promised": (~F.col("delivers")).cast("long"), "delivered": F.col("delivers").cast("long")}, "protocol")
    why = F.when(F.col("promised") == 0, "unknown label").when(F.col("delivered") > 1, "double delivery")
    return at.where("delivers").select(event, label, "promised", "delivered", why.alias("violation"))
