"""Shards of near equal bytes by histogram sort.

The sort key is (hash of the text, id): equal texts are neighbours, and a shard boundary falls inside such a group only
where the tolerance leaves no other place. Rounds of probes count the exact bytes below candidate boundaries over all
partitions; the driver sees one row of sums a cell between probes, never rows of the table. One exchange follows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, id_in, id_out, partitions, per_batch, table

KEY_LOW = -(2**63)
CELL = "cell long, n long, bytes long, min_h long, max_h long, min_d long, max_d long"


@dataclass
class Cell:
    """The rows from key low up to key high, which is not included, as pairs of hash and id."""

    low: tuple[int, int]
    high: tuple[int, int]
    n: int = 0
    size: int = 0
    first: tuple[int, int] | None = None  # bounds of the keys found; ids only hold within a single hash
    last: tuple[int, int] | None = None

    def probes(self, n: int) -> list[tuple[int, int]]:
        """Up to n boundaries within the cell, over the span that its rows fill. Ids count only once a single hash is left."""
        (h0, d0), (h1, d1) = self.first, self.last
        if h0 != h1:
            steps = {h0 + 1 + (h1 - h0 - 1) * i // max(n - 1, 1) for i in range(n)}
            return sorted((h, KEY_LOW) for h in steps if self.low < (h, KEY_LOW) < self.high)
        steps = {d0 + 1 + (d1 - d0 - 1) * i // max(n - 1, 1) for i in range(n)} if d1 > d0 else set()
        ends = {(h0, KEY_LOW), (h0 + 1, KEY_LOW)}  # first try to keep the group of equal texts whole
        return sorted(p for p in ends | {(h0, d) for d in steps} if self.low < p < self.high)

    def single(self) -> bool:
        return self.n == 0 or self.first == self.last


def cell_of(h: np.ndarray, d: np.ndarray, probe_h: np.ndarray, probe_d: np.ndarray) -> np.ndarray:
    """For each key, how many probes are not above it."""
    left, right = np.searchsorted(probe_h, h, "left"), np.searchsorted(probe_h, h, "right")
    for lo in np.unique(left[left < right]):  # probes within one hash
        own = (left == lo) & (left < right)
        hi = right[own][0]
        right[own] = lo + np.searchsorted(probe_d[lo:hi], d[own], "right")
    return right


def arrays(probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)


def count(keys: DataFrame, probes: list[tuple[int, int]]) -> list[Cell]:
    """The cells between probes with exact rows and bytes: partial sums in each batch, then one row a cell."""
    at, schema = arrays(probes), arrow_schema(CELL)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            h, d, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cell = cell_of(h, d, *at)
            order = np.lexsort((d, h, cell))
            cell, h, d, size = cell[order], h[order], d[order], size[order]
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            end = np.r_[start[1:], len(cell)]
            return {"cell": cell[start], "n": end - start, "bytes": np.add.reduceat(size, start), "min_h": h[start], "max_h": h[end - 1], "min_d": np.minimum.reduceat(d, start), "max_d": np.maximum.reduceat(d, start)}

        return work

    rows = keys.select("h", "doc_id", "size").mapInArrow(per_batch(make, schema), CELL).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("min_h").alias("min_h"), F.max("max_h").alias("max_h"), F.min("min_d").alias("min_d"), F.max("max_d").alias("max_d")).collect()
    top = (2**63, KEY_LOW)
    edges = [(KEY_LOW, KEY_LOW), *probes, top]
    cells = [Cell(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    for r in rows:
        c = cells[r.cell]
        c.n, c.size, c.first, c.last = r.n, r.bytes, (r.min_h, r.min_d), (r.max_h, r.max_d)
    return cells


def boundaries(keys: DataFrame, shards: int, tolerance: float, probes_each: int) -> tuple[list[Cell], list[int]]:
    """Cells in key order, and the index of the first cell of each shard but the first."""
    spread = max(shards * probes_each, 4 * partitions(keys.sparkSession))
    probes = [(KEY_LOW + 2**64 * i // spread, KEY_LOW) for i in range(1, spread)]
    while True:
        cells = count(keys, probes)
        total, rows = sum(c.size for c in cells), sum(c.n for c in cells)
        slack, heavy = tolerance * total / shards, max(1000, 4 * rows // spread)
        below = np.cumsum([0, *(c.size for c in cells)])
        more: set[tuple[int, int]] = set()
        cuts = []
        for k in range(1, shards):
            aim = total * k / shards
            best = int(np.argmin(np.abs(below - aim)))
            cuts.append(best)
            if abs(below[best] - aim) > slack:
                inside = cells[min(int(np.searchsorted(below, aim, "right")) - 1, len(cells) - 1)]
                if not inside.single():
                    more.update(inside.probes(probes_each))
        for c in cells:  # a cell is sorted by one task: even out those that hold a large group
            if c.n > heavy and not c.single():
                more.update(c.probes(min(probes_each, 2 * c.n // heavy + 2)))
        if not (more := more - set(probes)):
            return cells, cuts
        probes = sorted({*probes, *more})


def shard_by_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, overhead: int = 8, tolerance: float = 0.002, probes_each: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes plus overhead), text_crc32, law, shard, slot, grown_shard (null).

    Shard sizes differ from the mean by tolerance times the mean for each boundary, or by the row at the boundary.
    Null text: size is overhead alone, crc32 that of no bytes. A null id sorts before all others. Rows alike in id and text
    are each placed and take neighbouring slots. An empty table gives an empty result. Other columns are not read.
    """
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    keys = table(docs.select(F.xxhash64(raw).alias("h"), id_in(key).alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32")), "shard-keys")
    cells, cuts = boundaries(keys, shards, tolerance, probes_each)
    at = arrays([c.low for c in cells[1:]])
    shard = np.searchsorted(np.array(cuts, np.int64), np.arange(len(cells)), "right").astype(np.int32)
    rows_below = np.cumsum([0, *(c.n for c in cells)])[:-1]
    base = rows_below - rows_below[np.searchsorted(shard, shard)]
    ddl = "h long, doc_id long, size long, text_crc32 long, cell long, shard int, base long"
    schema = arrow_schema(ddl)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            cell = cell_of(batch.column(0).to_numpy(), batch.column(1).to_numpy(), *at)
            return dict(zip(schema.names[:4], batch.columns, strict=True)) | {"cell": cell, "shard": shard[cell], "base": base[cell]}

        return work

    placed = keys.mapInArrow(per_batch(make, schema), ddl)
    slot = F.col("base") + F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id")) - 1
    return placed.select(id_out("doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
