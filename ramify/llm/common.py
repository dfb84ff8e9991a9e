"""What the corpus operators share: typed inputs, the shared folder, tables that cut lineage, Arrow helpers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh, load, partitions, written

#: Stands for a null id inside an operator, so that ids can be joined, sorted and hashed like any other.
NULL_ID = -(2**63)

#: White space between words, everywhere in this subpackage: what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"


def id_in(col: Column | str) -> Column:
    """An id as a long that is never null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NULL_ID))


def id_out(col: Column | str) -> Column:
    """The id as it was before id_in."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


def narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id long, never null; text binary in UTF-8, never null). Other columns, whatever their names, stay behind."""
    return df.select(id_in(key).alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("text"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs no rework."""
    return written(df, name)


def rank_in(col: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by binary search in a constant array: its depth is the logarithm
    of their number, so thousands of ranges are no deeper an expression than two."""
    if not bounds:
        return F.lit(0)
    at = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))

    def step(own: Column, w: Column) -> Column:
        low = own["low"]
        return F.struct(F.when(F.coalesce(F.get(at, low + w - 1) <= own["value"], F.lit(False)), low + w).otherwise(low).alias("low"), own["value"].alias("value"))

    # the value is in the state: a column inside the lambda loses its way when joins infer filters from an alias of this
    start = F.struct(F.lit(0).alias("low"), col.cast("long").alias("value"))
    return F.aggregate(steps, start, step, lambda own: own["low"])


def range_of(key: Column, spread: Column, bounds: list[int], hot: dict[int, int]) -> Column:
    """The number of a key's range, rising with the key and then with spread, a number of 31 bits.

    Ranges begin at the bounds. A hot key, which has so many rows that it is given several ranges, is a range of its own and
    is divided by spread.
    """
    cuts = sorted({*bounds, *hot, *(k + 1 for k in hot if k < 2**63 - 1)})
    if not hot:
        return rank_in(key, cuts)
    many = [1] + [hot.get(c, 1) for c in cuts]
    first = [0, *accumulate(many[:-1])]
    at = rank_in(key, cuts)
    first_of, many_of = (F.get(F.from_json(F.lit(json.dumps(x)), "array<bigint>"), at) for x in (first, many))
    return (first_of + F.shiftright(spread.cast("long") * many_of, 31)).cast("int")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """Of simple types; works on executors, where there is no session."""
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(","))])


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: make() gives, once a task, what turns a batch into columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in pieces(batch):
                if (out := work(piece)) is not None:
                    yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def pieces(batch: pa.RecordBatch, at_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes each, so that what a worker holds doesn't follow the batch's rows."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * at_most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key of a partition that is sorted by it."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r[key] != held[0][key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def pack_array(a: np.ndarray) -> bytes:
    """The bytes of all values by place, so that equal high bytes lie together, compressed; short arrays as they are, after a
    zero, so that a message of few values is no larger than they."""
    if a.nbytes < 64:
        return b"\0" + a.tobytes()
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unpack_array(raw: bytes, kind: type) -> np.ndarray:
    if raw[:1] == b"\0":  # no frame begins with it
        return np.frombuffer(raw, kind, offset=1)
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
