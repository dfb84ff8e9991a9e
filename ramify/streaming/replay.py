"""Coordination objects over Structured Streaming: state by object name, in order of arrival within a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import fresh

FANIN = "name string, event_id long, arrived long, combines boolean, others string"
BARRIER = "name string, event_id long, generation long, released timestamp"
BUFFER = "name string, k long, deposit long, withdrawal long, passed timestamp"
PERMITS = "name string, event_id long, permits long, waiters long"


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")


def fanin(stream: DataFrame, n: int) -> DataFrame:
    """(name, event_id, ts, result): each call as it arrives; the n-th gets the others' results. A fan-in serves once: calls
    after its n-th neither combine nor are kept. State: up to n results."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, results = state.get if state.exists else (0, [])
        results, rows = list(results), []
        for r in _ordered(frames).itertuples():
            count += 1
            last = count == n
            rows.append((key[0], r.event_id, count, last, ",".join(results) if last else None))
            if count < n:
                results.append(str(r.result))
        state.update((count, results if count < n else []))
        yield pd.DataFrame(rows, columns=["name", "event_id", "arrived", "combines", "others"])

    return stream.groupBy("name").applyInPandasWithState(step, FANIN, "count long, results array<string>", "append", GroupStateTimeout.NoTimeout)


def barrier(stream: DataFrame, n: int) -> DataFrame:
    """(name, event_id, ts): the calls of each generation as its n-th arrives. State: the calls that wait, fewer than n."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, waiting = state.get if state.exists else (0, [])
        waiting, rows = list(waiting), []
        for r in _ordered(frames).itertuples():
            waiting.append(int(r.event_id))
            if len(waiting) == n:
                rows.extend((key[0], e, generation, r.ts) for e in waiting)
                waiting, generation = [], generation + 1
        state.update((generation, waiting))
        if rows:
            yield pd.DataFrame(rows, columns=["name", "event_id", "generation", "released"])

    return stream.groupBy("name").applyInPandasWithState(step, BARRIER, "generation long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def semaphore(stream: DataFrame, initial: int) -> DataFrame:
    """(name, event_id, ts, sign): the permits after each P (-1) and V (+1). State: one number."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (at,) = state.get if state.exists else (initial,)
        rows = []
        for r in _ordered(frames).itertuples():
            at += int(r.sign)
            rows.append((key[0], r.event_id, at, max(0, -at)))
        state.update((at,))
        yield pd.DataFrame(rows, columns=["name", "event_id", "permits", "waiters"])

    return stream.groupBy("name").applyInPandasWithState(step, PERMITS, "permits long", "append", GroupStateTimeout.NoTimeout)


def buffer(stream: DataFrame) -> DataFrame:
    """(name, event_id, ts, kind): the k-th deposit ('D') of a name with its k-th withdrawal ('W'), when both are there. State: the
    calls of the one kind that wait for the other."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, kind, waiting, since = state.get if state.exists else (0, "", [], [])
        at = _ordered(frames)
        calls = {k: list(zip(x["event_id"].tolist(), x["ts"].tolist(), strict=True)) for k, x in at.groupby("kind")}
        held = [(int(e), pd.Timestamp(t, unit="us")) for e, t in zip(waiting, since, strict=True)]
        d, w = ((held if kind == k else []) + calls.get(k, []) for k in ("D", "W"))
        n = min(len(d), len(w))
        rows = [(key[0], done + i + 1, a[0], b[0], max(a[1], b[1])) for i, (a, b) in enumerate(zip(d[:n], w[:n], strict=True))]
        left, kind = (d[n:], "D") if len(d) > n else (w[n:], "W")
        state.update((done + n, kind, [int(e) for e, _ in left], [t.value // 1000 for _, t in left]))
        if rows:
            yield pd.DataFrame(rows, columns=["name", "k", "deposit", "withdrawal", "passed"])

    return stream.groupBy("name").applyInPandasWithState(step, BUFFER, "done long, kind string, waiting array<long>, since array<long>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, into a table in the shared folder, and reads the table."""
    spark: SparkSession = stream.sparkSession
    at = fresh(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
