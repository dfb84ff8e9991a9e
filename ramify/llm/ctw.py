"""Context-tree weighting over bytes, decomposed into bits, as a language model for documents.

A byte is eight binary decisions, each with a context tree of its own over the bytes before. Every node holds a
Krichevsky-Trofimov estimate; a node's weighted probability is half its own and half the product of its children's, so that
all depths are mixed. Every context of up to `depth` bytes that occurs in a training document is a node, so the model grows with
the corpus; counts are exact. A further context that never occurred predicts as the one that it extends.

No worker and not the driver holds the model. A node's subtree below its third byte lies in one of `parts` partitions, by those
three bytes; only the two upper depths, whose size the alphabet bounds, are sent to all. A block of documents asks each partition
once for each of its distinct grams (a byte and its context), and is told their probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_schema, id_out, narrow, pack_array, partitions, runs_of, table, unpack_array
from .words import BLOCK_BYTES, PART_BYTES, TOLD, Docs, blocks, join_words

#: Ends a text and pads the context of its start; no byte of UTF-8.
END = 0xFF
SEGMENT = 4 << 20
#: Grams that a task gathers before it sends them.
HELD = 4 << 20
#: Depths below this one are split over partitions.
SPLIT = 3
COUNTED = "part int, keys binary, counts binary"
MERGED = "part int, keys binary, counts binary, tops binary, top_counts binary, below binary, weights binary"
ASKED = "part int, block long, keys binary, counts binary"
SCORED = "doc_id long, n_bytes long, held_out boolean, n_tokens long, n_known long, known_log double, score double, v long"


def held_out(doc: int | None, folds: int = 7, fold: int = 2) -> bool:
    """By crc32 of the id as text; a null id trains."""
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == fold


@dataclass
class Segments:
    """Texts end to end, each piece after `depth` bytes of context."""

    data: np.ndarray
    at: np.ndarray  # the places that count
    first: np.ndarray  # where each piece's places begin in `at`
    doc: list[int]  # which document each piece is of

    def keys(self, depth: int) -> np.ndarray:
        """The gram of each place: the bytes before it, the nearest highest, and then its own."""
        d, n = self.data, len(self.data)
        out = d.astype(np.uint64)
        for j in range(1, depth + 1):
            out[j:] |= d[: n - j].astype(np.uint64) << np.uint64(8 * (depth - j + 1))
        return out[self.at]


def segments(texts: Iterator[tuple[int, bytes]], depth: int) -> Iterator[Segments]:
    """Lower-cased texts with their ends, in pieces whose size doesn't depend on that of a text."""
    held: list[bytes] = []
    docs: list[int] = []
    size = 0

    def done() -> Segments:
        lengths = np.array([len(x) for x in held])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        data = np.frombuffer(b"".join(held), np.uint8)
        counts = np.ones(len(data), bool)
        for j in range(depth):
            counts[starts + j] = False
        return Segments(data, np.flatnonzero(counts), np.concatenate(([0], np.cumsum(lengths - depth)[:-1])), list(docs))

    pad = bytes([END]) * depth
    for doc, raw in texts:
        text = pad + raw.lower() + bytes([END])
        for a in range(0, len(text) - depth, SEGMENT):
            held.append(text[a : a + SEGMENT + depth])
            docs.append(doc)
            size += len(held[-1])
            if size >= SEGMENT:
                yield done()
                held, docs, size = [], [], 0
    if held:
        yield done()


class _LogGamma:
    """log gamma(n + offset) for whole n, by Stirling's series, and from a table below TABLE."""

    TABLE = 1 << 14

    def __init__(self, offset: float) -> None:
        self.offset = offset
        self.table = np.array([math.lgamma(n + offset) for n in range(self.TABLE)])

    def __call__(self, n: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(n, self.TABLE - 1)]
        large = n >= self.TABLE
        if large.any():
            x = n[large] + self.offset
            out[large] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
        return out


_HALF, _ONE = _LogGamma(0.5), _LogGamma(1.0)


def block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of what Krichevsky and Trofimov's estimator gives all these decisions in any order."""
    return _HALF(zeros) + _HALF(ones) - _ONE(zeros + ones) - np.log(np.pi)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))]


def sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def shorter(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the grams of one depth those of the depth above: without the byte that is furthest back."""
    return sums(((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255)), n)


def parent(prefix: np.ndarray, bit: int) -> np.ndarray:
    """The same decision one depth up: a prefix is a context and then the first `bit` bits of a byte."""
    low = np.uint64((1 << bit) - 1)
    return ((prefix >> np.uint64(8 + bit)) << np.uint64(bit)) | (prefix & low)


class Level:
    """The nodes of one depth: for each of eight bits the decisions that occurred, as sorted prefixes, with zeros and ones."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.prefix: list[np.ndarray] = [keys] * 8
        self.zeros: list[np.ndarray] = [n] * 8
        self.ones: list[np.ndarray] = [n] * 8
        for bit in range(7, -1, -1):
            up, one = keys >> np.uint64(1), (keys & np.uint64(1)).astype(bool)
            first = np.flatnonzero(np.concatenate((np.ones(min(len(up), 1), bool), up[1:] != up[:-1])))
            self.prefix[bit] = keys = up[first]
            self.zeros[bit] = np.add.reduceat(np.where(one, 0, n), first) if len(first) else n
            self.ones[bit] = np.add.reduceat(np.where(one, n, 0), first) if len(first) else n
            n = self.zeros[bit] + self.ones[bit]
        self.estimate = [(o + 0.5) / (z + o + 1) for z, o in zip(self.zeros, self.ones, strict=True)]

    def weigh(self, below: list[np.ndarray] | None) -> list[np.ndarray]:
        """The logarithms of the weighted probabilities. below: the sums of those of the children, None at the last depth."""
        out, self.stay = [], []
        for bit in range(8):
            alone = block_estimate(self.zeros[bit], self.ones[bit])
            mixed = alone if below is None else np.logaddexp(alone, below[bit]) - np.log(2)
            self.stay.append(np.exp(alone - mixed - (0 if below is None else np.log(2))))
            out.append(mixed)
        return out

    def predict(self, above: Level | None) -> None:
        """What all depths down to this one say of a one, and the weight that is left to deeper ones."""
        self.mixed, self.left = [], []
        for bit in range(8):
            mixed, left = np.zeros(len(self.prefix[bit])), np.ones(len(self.prefix[bit]))
            if above is not None:
                at = np.searchsorted(above.prefix[bit], parent(self.prefix[bit], bit))
                mixed, left = above.mixed[bit][at], above.left[bit][at]
            self.mixed.append(mixed + left * self.stay[bit] * self.estimate[bit])
            self.left.append(left * (1 - self.stay[bit]))


def levels(keys: np.ndarray, n: np.ndarray, deep: int, shallow: int) -> dict[int, Level]:
    out = {}
    for d in range(deep, shallow - 1, -1):
        out[d] = Level(keys, n)
        keys, n = shorter(keys, n)
    return out


def weigh(tree: dict[int, Level], below: list[np.ndarray] | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights from the deepest level up; below: sums for the deepest one, None if there is no deeper. Gives the prefixes of the
    decisions above the uppermost level, and for each the sum over its children."""
    for d in sorted(tree, reverse=True):
        weights = tree[d].weigh(below)
        if d - 1 in tree:
            above = tree[d - 1].prefix
        else:
            above = [distinct(parent(p, bit)) for bit, p in enumerate(tree[d].prefix)]
        below = [np.bincount(np.searchsorted(above[bit], parent(tree[d].prefix[bit], bit)), weights[bit], len(above[bit])) for bit in range(8)]
    return above, below


def log_probabilities(asked: np.ndarray, tree: dict[int, Level], depth: int) -> np.ndarray:
    """The log10 probability of each gram, a sorted array, from the deepest node that each of its decisions has."""
    out = np.zeros(len(asked))
    for bit in range(8):
        full = asked >> np.uint64(8 - bit)
        new = np.concatenate((np.ones(min(len(full), 1), bool), full[1:] != full[:-1]))
        own = full[new]
        low = own & np.uint64((1 << bit) - 1)
        mixed, left, estimate = np.zeros(len(own)), np.ones(len(own)), np.full(len(own), 0.5)
        for d in range(depth + 1):
            level = tree[d]
            if not len(level.prefix[bit]):
                break
            prefix = ((own >> np.uint64(bit + 8 * (depth - d))) << np.uint64(bit)) | low
            at = np.minimum(np.searchsorted(level.prefix[bit], prefix), len(level.prefix[bit]) - 1)
            found = level.prefix[bit][at] == prefix
            at = at[found]
            mixed[found], left[found], estimate[found] = level.mixed[bit][at], level.left[bit][at], level.estimate[bit][at]
        one = (mixed + left * estimate)[np.cumsum(new) - 1]
        out += np.log10(np.where(asked >> np.uint64(7 - bit) & np.uint64(1), one, 1 - one))
    return out


def part_of(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """By the SPLIT bytes before, so that all deeper nodes of such a context are in one part."""
    near = (keys >> np.uint64(8 * (depth + 1 - SPLIT))) * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def by_part(keys: np.ndarray, depth: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of sorted keys that belong to each part; the keys stay sorted."""
    part = part_of(keys, depth, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, order[cuts[p] : cuts[p + 1]]


def _rise(keys: np.ndarray) -> bytes:
    return pack_array(np.diff(keys, prepend=np.uint64(0)))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_array(raw, np.uint64), dtype=np.uint64)


def counted(own: DataFrame, depth: int, parts: int, trains: Callable[[int], bool], most: int = HELD) -> DataFrame:
    """The grams of all training documents by part: summed in a task first, then in the part. A part's row has its grams, and
    what it adds to the decisions of depth SPLIT - 1."""
    sent, merged = arrow_schema(COUNTED), arrow_schema(MERGED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((0, raw.as_py()) for b in batches for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True) if trains(doc))
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def flush() -> pa.RecordBatch:
            rows = [{"part": p, "keys": _rise(keys[at]), "counts": pack_array(n[at])} for p, at in by_part(keys, depth, parts)]
            return pa.RecordBatch.from_pylist(rows, schema=sent)

        for s in segments(texts, depth):
            more, m = np.unique(s.keys(depth), return_counts=True)
            keys, n = sums(np.concatenate((keys, more)), np.concatenate((n, m)))
            if len(keys) >= most:
                yield flush()
                keys, n = keys[:0], n[:0]
        if len(keys):
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "part"):
            keys, n = sums(np.concatenate([_keys(r["keys"]) for r in rows]), np.concatenate([unpack_array(r["counts"], np.int64) for r in rows]))
            tree = levels(keys, n, depth, SPLIT)
            above, below = weigh(tree, None)
            tops, m = keys, n
            for _ in range(depth - SPLIT + 1):
                tops, m = shorter(tops, m)
            tags = np.concatenate([p | np.uint64(bit << 56) for bit, p in enumerate(above)])
            row = {"part": rows[0]["part"], "keys": _rise(keys), "counts": pack_array(n), "tops": _rise(tops), "top_counts": pack_array(m), "below": _rise(tags), "weights": np.concatenate(below).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=merged)

    found = own.mapInArrow(count, COUNTED).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, MERGED)
    return table(found, "ctw-grams")


def top_of(merged: DataFrame) -> dict[int, Level]:
    """The levels above SPLIT, whole. Their grams have at most SPLIT bytes, so their number is bounded by the alphabet, not by the
    corpus: some 22,000 grams at 0.17 GB of text in four languages, against 16,000 at 0.05 GB."""
    rows = sorted(merged.select("part", "tops", "top_counts", "below", "weights").collect(), key=lambda r: r.part)
    none = np.empty(0, np.uint64)
    keys, n = sums(np.concatenate([none, *(_keys(r.tops) for r in rows)]), np.concatenate([np.empty(0, np.int64), *(unpack_array(r.top_counts, np.int64) for r in rows)]))
    tags, weights = sums(np.concatenate([none, *(_keys(r.below) for r in rows)]), np.concatenate([np.empty(0), *(np.frombuffer(r.weights) for r in rows)]))
    tree = levels(keys, n, SPLIT - 1, 0)
    cuts = np.searchsorted(tags, np.arange(9, dtype=np.uint64) << np.uint64(56))
    weigh(tree, [weights[cuts[bit] : cuts[bit + 1]] for bit in range(8)])
    for d in range(SPLIT):
        tree[d].predict(tree.get(d - 1))
    return tree


def distinct_grams(held: Docs, depth: int) -> np.ndarray:
    out = np.empty(0, np.uint64)
    for s in segments(iter(held), depth):
        out = distinct(np.concatenate((out, distinct(s.keys(depth)))))
    return out


def told_grams(own: DataFrame, merged: DataFrame, top: dict[int, Level], depth: int, parts: int, block_bytes: int) -> DataFrame:
    """For each block and part the probabilities of the block's grams in the part, as rows of TOLD with parts below zero."""
    asked, told = arrow_schema(ASKED), arrow_schema(TOLD)
    spread = own.sparkSession.sparkContext.broadcast(top)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in blocks(batches, block_bytes):
            keys = distinct_grams(held, depth)
            rows = [{"part": p, "block": block, "keys": _rise(keys[at]), "counts": None} for p, at in by_part(keys, depth, parts)]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=asked)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, "part"):
            own = [r for r in rows if r["counts"] is not None]
            keys, n = (_keys(own[0]["keys"]), unpack_array(own[0]["counts"], np.int64)) if own else (np.empty(0, np.uint64), np.empty(0, np.int64))
            tree = spread.value | levels(keys, n, depth, SPLIT)
            weigh({d: tree[d] for d in range(SPLIT, depth + 1)}, None)
            for d in range(SPLIT, depth + 1):
                tree[d].predict(tree[d - 1])
            every = [_keys(r["keys"]) for r in rows if r["counts"] is None]
            if not every:
                continue
            grams = distinct(np.concatenate(every))
            logs = log_probabilities(grams, tree, depth).astype(np.float32)
            blocks_of = [r["block"] for r in rows if r["counts"] is None]
            for i in range(0, len(every), 64):
                out = [{"block": b, "part": -1 - rows[0]["part"], "told": pack_array(logs[np.searchsorted(grams, k)])} for b, k in zip(blocks_of[i : i + 64], every[i : i + 64], strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=told)

    model = merged.select("part", F.lit(-1).cast("long").alias("block"), "keys", "counts")
    both = own.mapInArrow(ask, ASKED).union(model)
    return both.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tell, TOLD)


def text_scores(held: Docs, told: dict[int, bytes], depth: int, parts: int) -> np.ndarray:
    """The log10 probability of each text with its end."""
    pieces = []
    for s in segments(((i, raw) for i, (_, raw) in enumerate(held)), depth):
        grams, place = np.unique(s.keys(depth), return_inverse=True)
        pieces.append((s.doc, s.first, grams, place.astype(np.int32)))
    keys = distinct(np.concatenate([grams for _, _, grams, _ in pieces]))
    logs = np.zeros(len(keys), np.float32)
    for p, at in by_part(keys, depth, parts):
        logs[at] = unpack_array(told[-1 - p], np.float32)
    total = np.zeros(len(held))
    for doc, first, grams, place in pieces:
        np.add.at(total, doc, np.add.reduceat(logs[np.searchsorted(keys, grams)][place], first, dtype=np.float64))
    return total


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 6, folds: int = 7, fold: int = 2, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from rows that are not held out by their id's crc32, and scores all. score is the log10 probability of
    the lower-cased UTF-8 bytes and one end, bits_per_byte the code length of these; base_score is that of an add-one unigram
    model of the lower-cased words and one end. Null text: as empty, only the end. A null id trains. Tied and repeated ids: each
    row counts and is scored for itself. Very long texts are counted and scored whole, in pieces of SEGMENT bytes with the bytes
    before them. An empty table gives an empty result; without any training text every byte has the same probability. Other
    columns are not read.
    """
    if not SPLIT <= depth <= 7:
        raise ValueError("a gram is a byte and 3 to 7 bytes before it")
    is_held = lambda doc: held_out(None if doc == NULL_ID else doc, folds, fold)
    own = narrow(docs, key, text)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(min(partitions(docs.sparkSession), 64), size // part_bytes + 1)
    merged = counted(own, depth, parts, lambda doc: not is_held(doc))
    grams = told_grams(own, merged, top_of(merged), depth, parts, block_bytes)
    schema = arrow_schema(SCORED)

    def number(held: Docs) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        for doc, raw in held:
            if is_held(doc):
                for w in raw.lower().split():
                    found.setdefault(w, 0)
            else:
                for w in raw.lower().split():
                    found[w] = found.get(w, 0) + 1
        return found

    def answer(words: list[list[bytes]], counts: list[np.ndarray]) -> list[bytes]:
        total: dict[bytes, int] = {}
        for ws, n in zip(words, counts, strict=True):
            for w, c in zip(ws, n.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        distinct = sum(c > 0 for c in total.values())
        out = []
        for i, ws in enumerate(words):  # the first block asked is also told how many distinct words trained
            out.append(np.fromiter(chain((distinct if i == 0 else 0,), map(total.__getitem__, ws)), "<i8", len(ws) + 1).tobytes())
        return out

    def finish(held: Docs, answers: Callable[[], Iterator[tuple[list[bytes], bytes]]], others: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        scores = text_scores(held, others, depth, parts)
        logs: dict[bytes, float] = {}
        distinct = 0
        for ws, told in answers():
            counts = np.frombuffer(told, "<i8")
            distinct += int(counts[0])
            logs.update(zip(ws, np.log10(counts[1:] + 1.0).tolist(), strict=True))
        rows = []
        for doc, raw in held:
            words = raw.lower().split()
            own = np.fromiter(map(logs.__getitem__, words), np.float64, len(words))
            rows.append((doc, len(raw) + 1, is_held(doc), len(words) + 1, int(np.count_nonzero(own)), float(own.sum()), 0))
        cols = [list(x) for x in zip(*rows, strict=True)]
        cols[6][0] = distinct
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*cols[:6], scores, cols[6]), schema, strict=True)], schema=schema)

    found = table(join_words(docs, key, text, number, answer, finish, SCORED, grams, block_bytes, part_bytes), "scores")
    # the end is a token of each document: known if any document trains
    sums_ = found.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("n"), F.sum("v").alias("v"), F.sum((~F.col("held_out")).cast("long")).alias("ends")).first()
    n, ends = sums_.n or 0, sums_.ends or 0
    total = n + (sums_.v or 0) + (ends > 0) + 1
    base = F.col("known_log") + F.log10(F.lit(ends + 1.0)) - F.col("n_tokens") * F.log10(F.lit(float(total)))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    return found.select(id_out("doc_id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
