"""Barriers, semaphores, buffers and channels, replayed over an ordered log: when each call would have gone on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import prefix, ranked


def generations(log: DataFrame, name: list[str], ts: str, event: str, n: int) -> DataFrame:
    """log with the number of each call among those of its name, its generation of n calls, how many of it arrived, and the last."""
    at = ranked(log, name, [ts, event], "call", "barrier").withColumn("generation", F.floor((F.col("call") - 1) / n))
    done = at.groupBy(*name, "generation").agg(F.count("*").alias("arrived"), F.max(ts).alias("last"))
    return at.join(done, [*name, "generation"])


def barrier(log: DataFrame, name: list[str], ts: str, event: str, n: int) -> DataFrame:
    """For each call its generation and when the n-th call of it releases all; null for an incomplete generation."""
    return generations(log, name, ts, event, n).select(event, *name, "generation", F.when(F.col("arrived") == n, F.col("last")).alias("released"))


def permits(log: DataFrame, name: list[str], ts: str, event: str, sign: Column, initial: int) -> DataFrame:
    """The permits after each call, P being -1 and V +1, and how many calls wait when they are below zero."""
    if initial < 0:
        raise ValueError("a semaphore can't start below zero")
    at = prefix(log, name, [ts, event], {"sum": sign.cast("long")}, "permits")
    return at.withColumn("permits", F.col("sum") + initial).withColumn("waiters", F.greatest(F.lit(0).cast("long"), -F.col("permits"))).drop("sum")


def with_both(log: DataFrame, kind: Column) -> DataFrame:
    """A log in which each VP is a V and, right after it, a P: kind 'V' or 'P', and step, the order of the two."""
    steps = F.when(F.col("kind") == "VP", F.array(F.lit("V"), F.lit("P"))).otherwise(F.array("kind"))
    others = [c for c in log.columns if c not in ("kind", "step")]
    return log.withColumn("kind", kind).select(*others, F.posexplode(steps).alias("step", "kind"))


def semaphore_waits(log: DataFrame, name: list[str], ts: str, event: str, kind: Column, initial: int, order: tuple[str, ...] = ()) -> DataFrame:
    """For each P (kind 'P') the number of V ('V') that lets it go on, first come first served, and when; null for never.

    The k-th P needs no V if k <= initial, else the V of number k - initial.
    """
    at = ranked(log.withColumn("kind", kind), [*name, "kind"], [ts, event, *order], "k", "semaphore")
    p = at.where("kind = 'P'").select(event, *name, ts, "k", (F.col("k") - initial).alias("needs"))
    v = at.where("kind = 'V'").select(*name, F.col("k").alias("needs"), F.col(ts).alias("__freed"))
    met = p.join(v, [*name, "needs"], "left")
    goes = F.when(F.col("needs") <= 0, F.col(ts)).when(F.col("__freed").isNotNull(), F.greatest(ts, "__freed"))
    return met.select(event, *name, "k", F.greatest(F.lit(0).cast("long"), "needs").alias("needs"), goes.alias("goes_on"))


def _calls(log: DataFrame, name: list[str], ts: str, event: str, kind: Column) -> DataFrame:
    """The k-th deposit ('D') of a buffer beside its k-th withdrawal ('W')."""
    at = ranked(log.withColumn("kind", kind), [*name, "kind"], [ts, event], "k", "buffer")
    d = at.where("kind = 'D'").select(*name, "k", F.col(event).alias("deposit"), F.col(ts).alias("offered"))
    w = at.where("kind = 'W'").select(*name, "k", F.col(event).alias("withdrawal"), F.col(ts).alias("asked"))
    return d.join(w, [*name, "k"], "full")


def buffer(log: DataFrame, name: list[str], ts: str, event: str, kind: Column) -> DataFrame:
    """An unbounded first-in-first-out buffer: the k-th withdrawal gets the k-th deposit when both are there; null for never."""
    both = F.col("offered").isNotNull() & F.col("asked").isNotNull()
    return _calls(log, name, ts, event, kind).select(*name, "k", "deposit", "withdrawal", F.when(both, F.greatest("offered", "asked")).alias("passed"))


def bounded_buffer(log: DataFrame, name: list[str], ts: str, event: str, kind: Column, capacity: int) -> DataFrame:
    """A buffer of that capacity: when the k-th deposit and the k-th withdrawal go through; null for never.

    D(k) = max(offered(k), W(k - n)) and W(k) = max(asked(k), D(k)), so W(k) is the greatest of offered and asked over k,
    k - n, k - 2n, ...: a running maximum in each of n classes, in which a missing call blocks all that follow.
    """
    if capacity < 1:
        raise ValueError("a buffer holds at least one value")
    at = _calls(log, name, ts, event, kind).withColumn("lane", F.col("k") % capacity)
    at = at.withColumn("there", (F.col("offered").isNotNull() & F.col("asked").isNotNull()).cast("int"))
    passed = F.greatest("offered", "asked")
    so_far = {"whole": F.col("there"), "last": passed, "whole_before": F.col("there"), "last_before": passed}
    at = prefix(at, [*name, "lane"], ["k"], so_far, "lanes", {"whole": "min", "last": "max", "whole_before": "min", "last_before": "max"}, ("whole_before", "last_before"))
    freed = F.when(F.col("whole_before") == 1, F.col("last_before"))
    deposited = F.when(F.col("offered").isNull(), F.lit(None)).when(F.col("k") <= capacity, F.col("offered")).when(freed.isNotNull(), F.greatest("offered", freed))
    return at.select(*name, "k", "deposit", "withdrawal", deposited.alias("deposited"), F.when(F.col("whole") == 1, F.col("last")).alias("withdrawn"))


def bichannel(log: DataFrame, name: list[str], direction: str, ts: str, event: str, kind: Column) -> DataFrame:
    """Two channels, one for each direction, each holding one value."""
    return bounded_buffer(log, [*name, direction], ts, event, kind, capacity=1)
