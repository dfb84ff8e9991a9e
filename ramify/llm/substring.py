"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import arrow_schema, id_in, id_out, pack_array, partitions, unpack_array

#: Odd, so it has an inverse modulo 2**64 and window hashes come from differences of one running sum.
BASE = 0x9E3779B97F4A7C15
#: Of the second hash, whose upper 16 bits go with each window: equal windows agree in 80 bits.
CHECK_BASE = 0xD6E8FEB86659FD93
#: Windows that one range of hashes has, about; bounds what a worker sorts at a time.
RANGE_WINDOWS = 2_000_000
BATCH_WORDS = 1_000_000
PARTS = "part int, n int, hashes binary, checks binary, places binary, ids binary, texts binary, firsts binary"
BUCKETS = "bucket int, ids binary, texts binary, starts binary"
FLAGS = "doc_id long, th int, starts binary"


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(tokens: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """For each start, the sum over j < k of tokens[start + j] * base**-j modulo 2**64, mixed so that its bits are even."""
    if len(tokens) < k:
        return np.empty(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * _powers(pow(base, -1, 2**64), len(tokens)), dtype=np.uint64)))
    h = (total[k:] - total[:-k]) * _powers(base, len(tokens) - k + 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):  # the finaliser of MurmurHash3
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def check_values(tokens: np.ndarray, k: int) -> np.ndarray:
    """16 bits of another hash of each window, by another base over the tokens mixed anew: low bits of sums don't carry over."""
    mixed = (tokens ^ (tokens >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (window_hashes(mixed, k, CHECK_BASE) >> np.uint64(48)).astype(np.uint16)


def _rise(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


class _Batch:
    """Documents with different ids whose windows are hashed and sorted together."""

    def __init__(self, k: int, parts: int) -> None:
        self.k, self.parts, self.words = k, parts, _WordHash()
        self.start()

    def start(self) -> None:
        self.docs: list[tuple[int, int, np.ndarray]] = []
        self.seen: set[int] = set()
        self.size = 0

    def full(self, doc: int) -> bool:
        return self.size >= BATCH_WORDS or doc in self.seen

    def add(self, doc: int, th: int, raw: bytes) -> None:
        words = raw.split()
        if len(words) >= self.k:
            self.docs.append((doc, th, np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))))
            self.seen.add(doc)
            self.size += len(words)

    def rows(self) -> Iterator[dict]:
        """A row for each range of hashes with the first window of each hash and check, then the repeats found within the batch."""
        if not self.docs:
            return
        self.docs.sort(key=lambda x: x[0])
        ids, texts = np.array([d[0] for d in self.docs], np.int64), np.array([d[1] for d in self.docs], np.int32)
        lengths = np.array([len(d[2]) for d in self.docs], np.int64)
        firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int32)
        tokens = np.concatenate([d[2] for d in self.docs])
        h, check = window_hashes(tokens, self.k), check_values(tokens, self.k)
        whole = np.ones(len(h), bool)  # windows that don't run into the next document
        for s in range(1, self.k):
            at = firsts[1:] - s
            whole[at[(at >= 0) & (at < len(h))]] = False
        place = np.flatnonzero(whole).astype(np.int32)
        h, check = h[place], check[place]
        order = np.argsort(h, kind="stable")  # places rise within a hash, and so do (id, start)
        if np.any((np.diff(h[order]) == 0) & (np.diff(check[order]) != 0)):  # windows that differ share a hash
            order = np.lexsort((place, check, h))
        h, check, place = h[order], check[order], place[order]
        first = np.concatenate((np.ones(1, bool), (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
        part = self.part_of(h)

        def row(n: int, part: int, hashes: np.ndarray, checks: np.ndarray, places: np.ndarray) -> dict:
            own, at = np.unique(np.searchsorted(firsts, places, "right") - 1, return_inverse=True)
            starts = places - firsts[own][at]
            sent = np.concatenate(([0], np.cumsum(lengths[own])))[:-1].astype(np.int32)
            return {"part": part, "n": n, "hashes": pack_array(_rise(hashes)), "checks": pack_array(checks), "places": pack_array((sent[at] + starts).astype(np.int32)), "ids": pack_array(_rise(ids[own])), "texts": pack_array(texts[own]), "firsts": pack_array(_rise(sent))}

        hf, cf, pf, cut = h[first], check[first], place[first], part[first]
        edges = np.flatnonzero(np.concatenate((np.ones(1, bool), cut[1:] != cut[:-1])))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cut)], strict=True):
            yield row(b - a, int(cut[a]), hf[a:b], cf[a:b], pf[a:b])
        again = np.sort(place[~first])
        if len(again):  # to any part, for it only passes them on
            yield row(-1, (int(ids[0]) + int(texts[0])) % self.parts, np.empty(0, np.uint64), np.empty(0, np.uint16), again)

    def part_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)


def _decode(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, texts, firsts = np.cumsum(unpack_array(row["ids"], np.int64)), unpack_array(row["texts"], np.int32), np.cumsum(unpack_array(row["firsts"], np.int32), dtype=np.int32)
    place = unpack_array(row["places"], np.int32)
    at = np.searchsorted(firsts, place, "right") - 1
    return ids[at], texts[at], place - firsts[at]


def _by_bucket(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Windows to remove, one row for each bucket of documents; all windows of a document meet in one bucket."""
    bucket = ((ids.view(np.uint64) * np.uint64(BASE) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((starts, texts, ids, bucket))
    bucket, ids, texts, starts = bucket[order], ids[order], texts[order], starts[order]
    edge = np.flatnonzero(np.concatenate((np.ones(1, bool), bucket[1:] != bucket[:-1])))
    rows = [{"bucket": int(bucket[i]), "ids": pack_array(_rise(ids[i:j])), "texts": pack_array(_rise(texts[i:j])), "starts": pack_array(_rise(starts[i:j]))} for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True)]
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(BUCKETS))


def _merged(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """All windows to remove of the documents of one bucket, a row for each document."""
    if not rows:
        return
    ids, texts, starts = (np.concatenate([np.cumsum(unpack_array(r[n], kind), dtype=kind) for r in rows]) for n, kind in (("ids", np.int64), ("texts", np.int32), ("starts", np.int32)))
    order = np.lexsort((starts, texts, ids))
    ids, texts, starts = ids[order], texts[order], starts[order].astype("<i4")
    edge = np.flatnonzero(np.concatenate((np.ones(1, bool), (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]))))
    ends = [*edge[1:].tolist(), len(ids)]
    for i in range(0, len(edge), 5000):
        some = edge[i : i + 5000]
        blobs = [starts[a:b].tobytes() for a, b in zip(some.tolist(), ends[i : i + 5000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(texts[some]), pa.array(blobs, pa.binary())], schema=arrow_schema(FLAGS))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key of a partition that is sorted by it."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r[key] != held[0][key]:
                yield held
                held = []
            held.append(r)
    yield held


def _repeats(rows: list[dict], parts: int) -> Iterator[pa.RecordBatch]:
    """The windows of one range whose hash and check also start earlier: at a smaller (id, start)."""
    sent = [r for r in rows if r["n"] >= 0]
    if sent:
        h = np.concatenate([np.cumsum(unpack_array(r["hashes"], np.uint64), dtype=np.uint64) for r in sent])
        order = np.argsort(h)
        same = np.diff(h[order]) == 0
        more = np.concatenate((same, [False])) | np.concatenate(([False], same))
        chosen = order[more]
        if len(chosen):
            marks = np.zeros(len(h), bool)
            marks[chosen] = True
            got, begin = [], 0
            for r in sent:
                own = marks[begin : begin + r["n"]]
                begin += r["n"]
                if own.any():
                    got.append([x[own] for x in _decode(r)])
            h, check = h[marks], np.concatenate([unpack_array(r["checks"], np.uint16) for r in sent])[marks]
            ids, texts, starts = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((starts, ids, check, h))
            h, check, ids, texts, starts = h[order], check[order], ids[order], texts[order], starts[order]
            new = np.concatenate((np.ones(1, bool), (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (ids != ids[head]) | (starts != starts[head])
            if later.any():
                yield _by_bucket(ids[later], texts[later], starts[later], parts)
    for r in rows:
        if r["n"] < 0:
            yield _by_bucket(*_decode(r), parts)


def repeated_windows(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(doc_id, th, starts): starts of windows, as int32, that also start earlier. th: hash of the text.

    A batch sends, for each range of hashes, only the first window of each hash, so a passage in a third of all documents
    reaches its range once a batch; repeats within the batch are known without the others.
    """
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    own = docs.select(id_in(key).alias("doc_id"), F.hash(raw).alias("th"), raw.alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), int(size / 6 / RANGE_WINDOWS) + 1)
    sent_schema = arrow_schema(PARTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(k, parts)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(batch.rows())
            batch.start()
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[i : i + 64], schema=sent_schema)

        for b in batches:
            for doc, th, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if batch.full(doc):
                    yield from flush()
                batch.add(doc, th, x.as_buffer().to_pybytes())
        yield from flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "part"):
            yield from _repeats(rows, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket"):
            yield from _merged(rows)

    sent = own.mapInArrow(send, PARTS)
    found = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(judge, BUCKETS)
    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, FLAGS)


def covered(n: int, starts: bytes, k: int) -> np.ndarray:
    """Which of n words lie in a window at one of the starts: the union of maximal removal intervals."""
    at = np.frombuffer(starts, "<i4")
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _pressed(text: Column) -> Column:
    @arrow_udf("binary")
    def run(raws: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=1, write_checksum=False)
        return pa.array([press.compress(x or b"") for x in raws.to_pylist()], pa.binary())

    return run(text)


def _joined(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """docs with __ramify_z (the compressed text, which is what the join moves) and __ramify_starts."""
    flags = repeated_windows(docs, key, text, k)
    flags = flags.select(F.col("doc_id").alias("__ramify_id"), F.col("th").alias("__ramify_th"), F.col("starts").alias("__ramify_starts"))
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    left = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.col(text).isNull().alias("__ramify_null"), id_in(key).alias("__ramify_key"), F.hash(raw).alias("__ramify_own"), _pressed(raw).alias("__ramify_z"))
    return left.join(flags, (F.col("__ramify_key") == F.col("__ramify_id")) & (F.col("__ramify_own") == F.col("__ramify_th")), "left")


def _digest(k: int):
    @arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string>")
    def run(packed: pa.Array, starts: pa.Array) -> pa.Array:
        rows, press = [], zstandard.ZstdDecompressor()
        for z, at in zip(packed.to_pylist(), starts.to_pylist(), strict=True):
            words = press.decompress(z).split() if z else []
            gone = 0
            n = len(words)
            if at:
                out = covered(n, at, k)
                gone = int(out.sum())
                words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
            rows.append({"n_words": n, "n_removed": gone, "kept_sha256": hashlib.sha256(b" ".join(words)).hexdigest()})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return run


def _kept_text(k: int) -> Column:
    @arrow_udf("string")
    def run(packed: pa.Array, starts: pa.Array) -> pa.Array:
        rows, press = [], zstandard.ZstdDecompressor()
        for z, at in zip(packed.to_pylist(), starts.to_pylist(), strict=True):
            raw = press.decompress(z)
            if at:
                words = raw.split()
                raw = b" ".join(w for w, x in zip(words, covered(len(words), at, k).tolist(), strict=True) if not x)
            rows.append(raw.decode("utf-8", "replace"))
        return pa.array(rows, pa.string())

    return run


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of k words that covers it has a word sequence that also starts earlier, which is at a smaller id,
    or in rows of the same id at an earlier place; windows at the same id and place are not earlier than each other, so rows
    alike in id and text have the same result. Null text and texts of fewer than k words have no window. A null id sorts
    before all others. An empty table gives an empty result. Other columns are not read. Equal hashes of 80 bits count as
    equal windows: over n windows that is about n * n / 2**81 wrong pairs.
    """
    joined = _joined(docs.select(F.col(key), F.col(text)), key, text, k)
    out = _digest(k)(F.col("__ramify_z"), F.col("__ramify_starts")).alias("x")
    return joined.select(id_out("__ramify_key").alias("doc_id"), out).select("doc_id", "x.*")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 20, n_chars: str | None = "n_chars") -> DataFrame:
    """docs with all its columns, the texts without the words that removals() removes; other texts, null ones too, stay as they are.

    A text that loses words keeps the others joined by one space. n_chars, where there is such a column, is counted anew.
    """
    joined = _joined(docs, key, text, k)
    out = joined.withColumn(text, F.when(~F.col("__ramify_null"), _kept_text(k)(F.col("__ramify_z"), F.col("__ramify_starts"))))
    if n_chars in docs.columns:
        changed = F.col("__ramify_starts").isNotNull()
        out = out.withColumn(n_chars, F.when(changed, F.char_length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
