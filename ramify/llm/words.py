"""The table of distinct words, joined to documents by blocks.

A block is some 16 MB of documents read in turn. It sends each of its distinct words once, to the part of the word table that
the word's hash names; a part does its work once for each distinct word of the corpus and answers every block; the answers
meet the block's compressed documents again by block number. So what moves is the documents once and the distinct words of
each block twice, never a row for each word of the text, and a very common word is a single entry of each block.

A message is what one block has for one part. There are no more messages than distinct words of blocks, whatever the number of
parts, so they grow with the corpus at most in proportion; and parts follow the bytes of text, not the cluster.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, narrow, pack_array, partitions, runs_of, unpack_array

BLOCK_BYTES = 16 << 20
#: Bytes of text for each part of the word table.
PART_BYTES = 32 << 20
PACKED = "block long, ids binary, sizes binary, texts binary"
ASKED = "part int, block long, words binary, extra binary"
TOLD = "block long, part int, told binary"

#: Documents of a block.
Docs = list[tuple[int, bytes]]


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, Docs]]:
    """Numbered blocks of a task's documents; the same each time that a partition is read."""
    seq, own, size = 0, [], 0
    task = TaskContext.get().partitionId() << 32
    for b in batches:
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = raw.as_py()
            if own and size + len(raw) > block_bytes:
                yield task + seq, own
                seq, own, size = seq + 1, [], 0
            own.append((doc, raw))
            size += len(raw)
    if own:
        yield task + seq, own


def words_by_part(split: dict[bytes, int], parts: int) -> Iterator[tuple[int, list[bytes]]]:
    """The distinct words of a block by part, in the order in which they first appear."""
    words = list(split)
    part = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, [words[i] for i in order[cuts[p] : cuts[p + 1]].tolist()]


def join_words(
    docs: DataFrame,
    key: str,
    text: str,
    number: Callable[[Docs], dict[bytes, int]],
    answer: Callable[[list[list[bytes]], list[np.ndarray]], list[bytes]],
    finish: Callable[[Docs, Callable[[], Iterator[tuple[list[bytes], bytes]]], dict[int, bytes]], Iterator[pa.RecordBatch]],
    ddl: str,
    more: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """number: a block's distinct words, each with a number that is sent along. answer: for each block's words and numbers in a
    part, what the block is told. finish: a block's result from its documents, the words with what was told about them, and
    what `more`, rows of TOLD with parts below zero, tells the block besides.
    """
    spark = docs.sparkSession
    own = narrow(docs, key, text)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(min(partitions(spark), 64), size // part_bytes + 1)
    packed, asked, told = arrow_schema(PACKED), arrow_schema(ASKED), arrow_schema(TOLD)
    columns = [f.split()[0] for f in ddl.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in blocks(batches, block_bytes):
            raw = zstandard.compress(b"".join(x for _, x in held), 3)
            yield pa.RecordBatch.from_pylist([{"block": block, "ids": np.array([d for d, _ in held], "<i8").tobytes(), "sizes": np.array([len(x) for _, x in held], "<i8").tobytes(), "texts": raw}], schema=packed)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in blocks(batches, block_bytes):
            found = number(held)
            rows = [{"part": p, "block": block, "words": zstandard.compress(b"\n".join(ws), 1), "extra": pack_array(np.array([found[w] for w in ws], np.int64))} for p, ws in words_by_part(found, parts)]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=asked)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(rows: list[dict]) -> pa.RecordBatch:
            said = answer([zstandard.decompress(r["words"]).split(b"\n") for r in rows], [unpack_array(r["extra"], np.int64) for r in rows])
            return pa.RecordBatch.from_pylist([{"block": r["block"], "part": r["part"], "told": x} for r, x in zip(rows, said, strict=True)], schema=told)

        for rows in runs_of(batches, "part"):
            yield one(rows)

    def meet(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        row = left.to_pylist()[0]
        if left.num_rows != 1:
            raise RuntimeError("a block was read twice")
        texts, at, held = zstandard.decompress(row["texts"]), 0, []
        for doc, n in zip(np.frombuffer(row["ids"], "<i8").tolist(), np.frombuffer(row["sizes"], "<i8").tolist(), strict=True):
            held.append((doc, texts[at : at + n]))
            at += n
        said = dict(zip(right.column("part").to_pylist(), right.column("told").to_pylist(), strict=True))
        others = {p: said.pop(p) for p in [p for p in said if p < 0]}

        def answers() -> Iterator[tuple[list[bytes], bytes]]:
            for p, ws in words_by_part(number(held), parts):
                yield ws, said.pop(p)
            if said:
                raise RuntimeError("a block was read differently")

        return finish(held, answers, others)

    def meet_table(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(meet(left, right))
        return pa.Table.from_batches(out).select(columns)

    told_rows = own.mapInArrow(ask, ASKED).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tell, TOLD)
    if more is not None:
        told_rows = told_rows.union(more)
    return own.mapInArrow(pack, PACKED).groupBy("block").cogroup(told_rows.groupBy("block")).applyInArrow(meet_table, ddl)
