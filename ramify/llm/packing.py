"""Documents packed into as few sequences as possible by bin completion over the histogram of their lengths.

Lengths are at most the capacity, so however many documents there are, the search sees a count for each length: the driver
holds capacity numbers, and the plan it makes is a list of runs that is bounded by the capacity too. Pieces get their place
in a distributed rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_bpe, default_path
from .common import arrow_schema, id_in, id_out, partitions, per_batch, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: A plan: for each kind of sequence, the lengths in it and how many such sequences there are.
Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The greatest of three bounds: what all lengths add up to; that of Martello and Toth: for each k, lengths over capacity - k
    stand alone and the rest must hold what is at least k; that of Fekete and Schepers: for each k, a length counts as
    floor((k + 1) length / capacity) / k, or as it is where that is a whole number before the floor, and so none of a sequence
    counts as more than one. With k = 3, say, no more than three lengths over a quarter share a sequence."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    arr = np.zeros(capacity + 2, np.int64)
    for s, n in counts.items():
        arr[s] = n
    sizes = np.arange(capacity + 2)
    number, total = np.cumsum(arr), np.cumsum(arr * sizes)
    k, half = np.arange(1, capacity // 2 + 1), capacity // 2
    alone, many = number[capacity] - number[capacity - k], number[capacity - k] - number[half]
    room = many * capacity - (total[capacity - k] - total[half])  # that the lengths over half leave beside them
    rest = np.maximum(0, total[half] - total[k - 1] - room)
    best = max(best, int((alone + many - (-rest // capacity)).max(initial=0)))
    for k in range(1, 33):
        steps, over = np.divmod((k + 1) * sizes, capacity)
        best = max(best, -int(-(arr * np.where(over == 0, k * sizes, capacity * steps)).sum() // (k * capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit over decreasing lengths; sequences filled alike are one entry, so its steps don't follow the documents."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted: the rooms left by open sequences

    def put(room: int, own: tuple[int, ...], n: int) -> None:
        if room not in open_:
            rooms.insert(bisect_right(rooms, room), room)
            open_[room] = []
        open_[room].append((own, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                if left % each:
                    put(capacity - left % each * size, (size,) * (left % each), 1)
                break
            room = rooms[at]
            own, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // size, left)
            used = min(n, left // each)
            put(room - each * size, own + (size,) * each, used)
            if n > used:
                put(room, own, n - used)
            left -= used * each
    return [x for entries in open_.values() for x in entries]


def fillings(room: int, sizes: list[int], counts: dict[int, int], most: int = 64) -> list[tuple[int, ...]]:
    """Undominated ways to fill room, least waste first.

    A single length that fills it exactly dominates all others. Else no way is kept where a free length fits into the waste,
    or may take the place of a shorter one that it has: the last length is always the longest that fits. Not all such ways are
    found: lengths after the third are each the longest that fits, no way is sought after 40 * most lengths tried, and the
    `most` of least waste are kept.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    if counts.get(room, 0):
        return [(room,)]
    tried = 0

    def grow(left: int, own: tuple[int, ...], top: int) -> bool:
        nonlocal tried
        i = bisect_right(sizes, min(left, top)) - 1
        any_fits = False
        while i >= 0 and tried < 40 * most:
            s = sizes[i]
            if counts[s] > own.count(s):
                tried += 1
                any_fits = True
                if grow(left - s, (*own, s), s):
                    return True
                if len(own) >= 3:
                    break
            i -= 1
        if not any_fits:
            free = bisect_right(sizes, left)
            if not any(counts[s] > own.count(s) for s in sizes[max(0, free - len(own) - 2) : free]):
                replaced = any(counts[y] > own.count(y) for x in set(own) for y in sizes[bisect_right(sizes, x) : bisect_right(sizes, x + left)])
                if not replaced:
                    found.append((left, own))
                    return left == 0
        return False

    grow(room, (), room)
    return [own for _, own in sorted(found, key=lambda x: (x[0], len(x[1])))[:most]] or [()]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 4_000) -> tuple[Plan, int]:
    """The best plan found and a lower bound on the number of sequences.

    Depth first: fill around the largest length left, a filling as often as the counts allow. A branch ends when its waste
    rules out fewer sequences than the incumbent, which is best fit at first. The search ends at the bound or after so many
    nodes, a parameter; the incumbent is then the result, with all documents in it. As no filling is taken fewer times than the
    counts allow, and fillings() doesn't find them all, a result above the bound is not shown to be the least.
    """
    counts = {s: n for s, n in counts.items() if n}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    used = lambda plan: sum(n for _, n in plan)
    total = sum(s * n for s, n in counts.items())
    left, sizes = dict(counts), sorted(counts)
    plan: Plan = []
    waste, seen = 0, 0
    stack: list[Iterator[tuple[tuple[int, ...], int]]] = []

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        top = sizes[-1]
        left[top] -= 1
        ways = fillings(capacity - top, sizes, left)
        left[top] += 1
        for way in ways:
            own = (top, *way)
            yield own, min(left[s] // own.count(s) for s in set(own))

    def take(own: tuple[int, ...], n: int, sign: int) -> None:
        nonlocal waste
        waste += sign * n * (capacity - sum(own))
        for s in own:
            before = left[s]
            left[s] -= sign * n
            if not left[s]:
                sizes.pop(bisect_right(sizes, s) - 1)
            elif not before:
                sizes.insert(bisect_right(sizes, s), s)

    if used(best) > bound:
        stack.append(choices())
    while stack and seen < nodes and used(best) > bound:
        own, n = next(stack[-1], ((), 0))
        if not own:
            stack.pop()
            if plan:
                take(*plan.pop(), -1)
            continue
        seen += 1
        take(own, n, 1)
        plan.append((own, n))
        if not sizes:
            if used(plan) < used(best):
                best = list(plan)
            take(*plan.pop(), -1)
        elif waste > (used(best) - 1) * capacity - total or seen % 16 == 0 and used(plan) + lower_bound({s: left[s] for s in sizes}, capacity) >= used(best):
            take(*plan.pop(), -1)
        else:
            stack.append(choices())
    return best, bound


def runs(plan: Plan) -> dict[str, np.ndarray]:
    """Where pieces go by length and rank: rows (length, first rank, first sequence, offset), sorted; each run ends where the next begins."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for own, n in plan:
        at = 0
        for s in own:
            rows.append((s, rank.get(s, 0), sequence, at))
            rank[s] = rank.get(s, 0) + n
            at += s
        sequence += n
    cols = zip(*sorted(rows), strict=True) if rows else ((),) * 4
    return dict(zip(("length", "rank", "sequence", "offset"), (np.array(c, np.int64) for c in cols), strict=True))


def pieces_of(docs: DataFrame, key: str, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """The token pieces of each row: texts over the capacity are cut so that all pieces but the first are full."""
    schema = arrow_schema(PIECES)

    def make():
        bpe, end = byte_bpe(path), np.array([end_id], "<u4")

        def work(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((bpe.ids(x or ""), end)).tobytes()
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                rows.extend((doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
            return dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    return docs.select(id_in(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(per_batch(make, schema), PIECES)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds only end_id. Null, tied and repeated ids: each row of docs is packed for
    itself. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = table(pieces_of(docs, key, text, path or default_path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    at = runs(bin_completion(counts, capacity)[0])
    order = at["length"] * (1 << 44) + at["rank"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    below = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    below = below.withColumn("below", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(below, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.coalesce("below", F.lit(0))).alias("rank"))
    schema = arrow_schema(PLACED)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = np.searchsorted(order, length * (1 << 44) + rank, "right") - 1
            return dict(zip(schema.names[:5], batch.columns[:5], strict=True)) | {"sequence_id": at["sequence"][run] + rank - at["rank"][run], "offset": at["offset"][run]}

        return work

    return ranked.mapInArrow(per_batch(make, schema), PLACED).withColumn("doc_id", id_out("doc_id"))
