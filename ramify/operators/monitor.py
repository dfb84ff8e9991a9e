"""Condition variables of a monitor, replayed over an ordered log of the calls made inside it.

A signal wakes the caller that has waited longest; without one it is lost. The woken caller has the monitor at once, and the
signaller comes back after it, before any new caller: signal and urgent wait.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import prefix


def conditions(log: DataFrame, name: list[str], ts: str, event: str, waits: Column, exits: Column) -> DataFrame:
    """For each call on a condition: waiting, how many wait after it; met, the signal that wakes a wait, or the wait that a signal
    wakes, null for none; resumed, when a caller goes on in the monitor, null for never; urgent, whether it was queued for re-entry.

    waits: whether a call waits; the others signal. exits: whether a signaller leaves the monitor with its signal, so that it
    doesn't come back. A null in either counts as false. An empty log gives an empty result.

    With s the waits less the signals so far and m the least s so far, or 0, s - m callers wait: a signal that lowers m is one
    that is lost. So the k-th signal that is not lost wakes the k-th wait, and no queue is held for a name.
    """
    own = log.select(event, *name, ts, F.coalesce(waits, F.lit(False)).alias("waits"), F.coalesce(exits, F.lit(False)).alias("exits"))
    own = prefix(own, name, [ts, event], {"sum": F.when(F.col("waits"), 1).otherwise(-1).cast("long")}, "conditions")
    own = prefix(own, name, [ts, event], {"least": F.col("sum"), "before": F.col("sum")}, "lost", {"least": "min", "before": "min"}, ("before",))
    floor, before = (F.least(F.lit(0).cast("long"), F.coalesce(c, F.lit(0).cast("long"))) for c in ("least", "before"))
    own = own.withColumns({"waiting": F.col("sum") - floor, "wakes": ~F.col("waits") & (floor == before)})
    own = prefix(own, name, [ts, event], {"nth_wait": F.col("waits").cast("long"), "nth_wake": F.col("wakes").cast("long")}, "woken")
    own = own.withColumn("k", F.when(F.col("waits"), F.col("nth_wait")).when(F.col("wakes"), F.col("nth_wake")))
    other = own.where("k IS NOT NULL").select(*name, "k", (~F.col("waits")).alias("waits"), F.col(event).alias("met"), F.col(ts).alias("__at"))
    resumed = F.when(F.col("waits"), F.col("__at")).when(~F.col("exits"), F.col(ts))
    met = own.join(other, [*name, "k", "waits"], "left")
    return met.select(event, *name, "waits", "waiting", "met", resumed.alias("resumed"), (F.col("wakes") & ~F.col("exits")).alias("urgent"))
