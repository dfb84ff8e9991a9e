"""Calls to named synchronization objects, replayed over an ordered log: which objects are made, what each call is answered,
and whose caller starts again.

A create names a class; the other calls name a method of a barrier, are synchronous or not, and may try: a try_ call that
would wait is answered at once that it blocks, so that its caller can end, and is then carried out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_try
from .scan import prefix
from .sync import generations

#: Class names that a create may have, and those of them whose objects can be made.
ASKED = ("barrier", "Barrier", "semaphore", "Semaphore", "bounded_buffer", "BoundedBuffer", "fanin", "FanIn")
MADE = ("Barrier", "BoundedBuffer", "FanIn")


def create_status(cls: Column) -> Column:
    """What a create comes to: created, no source, or invalid class. A null class is invalid."""
    return F.when(cls.isin(*MADE), "created").when(cls.isin(*ASKED), "no source").otherwise("invalid class")


def barrier_calls(log: DataFrame, name: list[str], ts: str, event: str, cls: Column, method: Column, waits: Column, n: int) -> DataFrame:
    """For each call its reply, when its caller has it, and when its caller is started again; null for never.

    cls: the class of a create, null for other calls. waits: whether the caller waits for an answer (synchronous). A call
    counts only if an object of its name was created before it. The n-th call of a generation releases all; it alone does
    not block. Replies: unknown object; none, to asynchronous calls; blocking, to try_ calls that block, at once; state, to
    all others, when they are released. Callers that don't wait are started again when a call of theirs that blocked is released.
    """
    at = log.withColumns({"__create": cls.isNotNull(), "__made": (create_status(cls) == "created").cast("long"), "__try": is_try(method), "__waits": waits})
    at = prefix(at, name, [ts, event], {"objects": F.col("__made")}, "objects").where("NOT __create")
    known = generations(at.where("objects > 0"), name, ts, event, n)
    blocks = (F.col("call") - 1) % n < n - 1
    released = F.when(F.col("arrived") == n, F.col("last"))
    told = F.col("__waits") & F.col("__try") & blocks
    reply = F.when(~F.col("__waits"), "none").when(told, "blocking").otherwise("state")
    answered = F.when(told, F.col(ts)).when(F.col("__waits"), released)
    restarted = F.when(blocks & (told | ~F.col("__waits")), released)
    found = known.select(event, *name, reply.alias("reply"), answered.alias("answered"), restarted.alias("restarted"))
    refused = at.where("objects = 0").select(event, *name, F.lit("unknown object").alias("reply"), F.col(ts).alias("answered"), F.lit(None).cast(log.schema[ts].dataType).alias("restarted"))
    return found.unionByName(refused)
