"""SimHash near-duplicates: a byte-position inverted index with count filtering finds fingerprints a few bits apart."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import arrow_schema, partitions, table
from .components import components

SEED = 42
#: At most 3 of 64 bits differ, so at most 3 of 8 bytes, so at least 5 positional bytes are shared.
MIN_SHARED = 5
#: Of any 5 positions, 3 lie in one half; so some triple of one half is shared, and 2 more of the other 5 positions are.
TRIPLES = tuple(combinations(range(4), 3)) + tuple(combinations(range(4, 8), 3))
EDGES = "a long, b long"


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the shingles, repeats included. No words: 0."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n) + 1
    start = np.concatenate(([0], np.cumsum(lengths)))
    k = min(shingle, n)
    starts, ends = start[: n - k + 1], start[k:] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 15):
        s, e = starts[i : i + (1 << 15)].tolist(), ends[i : i + (1 << 15)].tolist()
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(s, e, strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long; null as the empty text."""

    @arrow_udf("long")
    def run(raws: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x or b"", shingle) for x in raws.to_pylist()], pa.int64())

    return run(text.cast("string").cast("binary"))


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))


def _packed(positions: tuple[int, ...], tag: int) -> Column:
    """The bytes at positions and, above them, the tag of these positions, in a long."""
    out = F.lit(tag).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links that join the fingerprints of one posting list as all its links do: one fewer than the nodes at most.

    From each fingerprint to those not yet joined: the shared positional bytes are tallied, pairs with enough are verified.
    """
    left = fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            apart = left ^ at
            tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = tally >= 8 - max_bits
            near[near] = np.bitwise_count(apart[near]) <= max_bits
            found = left[near]
            yield from ((int(at.view(np.int64)), int(x)) for x in found.view(np.int64))
            todo.extend(found)
            left = left[~near]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of a partition sorted by key, cut only between keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        cut = int(np.searchsorted(k, k[-1]))
        held.append((k[:cut], v[:cut]))
        if cut:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((k[cut:], v[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def links(fps: DataFrame, max_bits: int = 3, most: int = 512) -> DataFrame:
    """Distinct fingerprints (column fp) to links that connect what fingerprints at max_bits or fewer differing bits connect.

    The postings are triples of positional bytes, 8 rows a fingerprint. A posting list above `most` is split by two more of the
    bytes that its pairs must share, 10 rows for each of its fingerprints, so no list is cut short and all its pairs are met.
    A list gives a spanning forest, never all its pairs.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees 5 shared bytes, so at most 3 bits may differ")
    posts = fps.select("fp", F.explode(F.array(*(_packed(t, i) for i, t in enumerate(TRIPLES)))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = posts.join(sizes, "key")
    split = F.lit(None)
    for i, t in reversed(list(enumerate(TRIPLES))):
        rest = [p for p in range(8) if p not in t]
        keys = F.array(*(_packed((*t, *two), (1 + i) << 4 | j) for j, two in enumerate(combinations(rest, 2))))
        split = F.when(F.shiftrightunsigned("key", 24) == i, keys).otherwise(split)
    keyed = posts.where(F.col("n") <= most).select("key", "fp").union(posts.where(F.col("n") > most).select(F.explode(split).alias("key"), "fp"))
    schema = arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, v in _lists(batches):
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[start, len(k)])
            found = [e for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True) for e in _forest(v[s : s + n], max_bits)]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    n = partitions(fps.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, EDGES).distinct()


def classes(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp), a written table, to (fp, root, component_id) for each distinct fp. component_id: the least id, null if all are."""
    own = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    joined = own.join(components(links(own.select("fp"), max_bits)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = table(joined, "components")
    # a written table, not an aggregation, beside the other side: so adaptive execution splits a component with very many rows
    least = table(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Equal fingerprints are one node, so copies make no pairs. Null text or no words: fingerprint zero, linked like any other.
    A null id is never a component_id unless the component has no other; repeated rows each get a row; an empty table gives
    an empty result. Very long texts are hashed whole, in slices of their shingles. Other columns are not read.
    """
    fps = table(docs.select(F.col(key).cast("long").alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp")), "simhash")
    return fps.join(classes(fps, max_bits).drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a wide fingerprint, and the pairs of its 32 positional bytes that are posted: all pairs of each 8 bytes that are one
#: word. Of any 5 bytes two are in one word, so fingerprints that share 5 bytes, as any at most 27 bits apart do, always meet.
WIDE = ("a", "b", "c", "d")
PAIRS = tuple(p for w in range(0, 32, 8) for p in combinations(range(w, w + 8), 2))
#: Posting lists up to this long are compared by shifts, all lists of a batch at once.
SHIFTS = 16
#: Postings that a task makes or reads, about, where the cluster has too few shuffle partitions for them.
POSTINGS = 8_000_000
#: A task gives out its links when it has joined so many ids.
HELD = 200_000


def wide_fingerprint(raw: bytes, shingle: int) -> tuple[int, int, int, int]:
    """256 bits, by four mixes of each shingle's XXH64; no words: zeros."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0
    flat = b" ".join(words)
    start = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)))
    k = min(shingle, n)
    starts, ends = start[: n - k + 1], start[k:] - 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(256, np.int64)
    for i in range(0, len(starts), 1 << 14):
        s, e = starts[i : i + (1 << 14)].tolist(), ends[i : i + (1 << 14)].tolist()
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(s, e, strict=True)], "<u8")
        mixed = h[:, None] + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # SplitMix64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), bitorder="little").reshape(-1, 256).sum(0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8").tolist())


def wide_column(text: Column, shingle: int) -> Column:
    @arrow_udf("struct<a: long, b: long, c: long, d: long>")
    def run(raws: pa.Array) -> pa.Array:
        found = zip(*(wide_fingerprint(x or b"", shingle) for x in raws.to_pylist()), strict=True)
        cols = [pa.array(c, pa.int64()) for c in found] or [pa.array([], pa.int64())] * 4
        return pa.StructArray.from_arrays(cols, names=list(WIDE))

    return run(text.cast("string").cast("binary"))


def bits_apart(similarity: float) -> int:
    """The most of 256 bits by which fingerprints of that cosine similarity are expected to differ."""
    return int(256 * np.arccos(similarity) / np.pi)


def _near(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs share two positional bytes or more, and of those, which are near enough."""
    apart = left ^ right
    near = (apart.view(np.uint8).reshape(len(apart), 32) == 0).sum(1) >= 2
    near[near] = np.bitwise_count(apart[near]).sum(1) <= max_bits
    return near


def _wide_forest(ids: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    out, left = [], np.arange(len(ids))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _near(fps[left], fps[at][None, :], max_bits)
            out.extend((int(ids[at]), int(x)) for x in ids[left[near]])
            todo.extend(left[near])
            left = left[~near]
    return out


class Stars:
    """Joined ids; stars() gives a link from each to the least of its group, so that a large group has no more links than ids."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = up[x]
        return x

    def join(self, links: Iterable[tuple[int, int]]) -> None:
        for a, b in links:
            a, b = self.top(a), self.top(b)
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(self.top(x), x) for x in list(self.up) if self.top(x) != x]


def wide_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct wide fingerprints (id, a, b, c, d) to links (a, b) that connect the ids at most max_bits of 256 bits apart.

    The inverted index posts pairs of positional bytes, 112 rows a fingerprint. Two fingerprints meet if both bytes of one of
    the pairs are the same in them: always at 27 bits or fewer, and else with a probability that falls with their distance. By
    simulation (20,000 draws a point) that is 0.997 at 40 bits and 0.885 at 52, or 0.990 at a Jaccard similarity of 0.8 and 0.998
    at 0.85, so a link between 28 and 52 bits may be missed. Lists are never cut; a task gives its groups as stars.

    A file of fingerprints has millions, which are 112 times as many postings: they are dealt out before they are posted.
    """
    byte = lambda p: F.shiftrightunsigned(WIDE[p // 8], 8 * (p % 8)).bitwiseAND(F.lit(255).cast("long"))
    keys = F.array(*(F.lit(i).cast("long") * 65536 + byte(p) * 256 + byte(q) for i, (p, q) in enumerate(PAIRS)))
    n = max(partitions(fps.sparkSession), fps.count() * len(PAIRS) // POSTINGS + 1)
    posts = fps.repartition(n, "id").select(F.explode(keys).alias("key"), "id", *WIDE).repartition(n, "key").sortWithinPartitions("key")
    schema = arrow_schema(EDGES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held.append([c[:cut] for c in cols])
            if cut:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def given(held: Stars) -> pa.RecordBatch:
        a, b = zip(*held.stars(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stars()
        for key, ids, *words in whole(batches):
            fp = np.ascontiguousarray(np.stack(words, 1)).view(np.uint64)
            start = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1])))
            size = np.diff(np.concatenate((start, [len(key)])))
            short = np.repeat(size <= SHIFTS, size)
            found: set[tuple[int, int]] = set()
            for shift in range(1, min(SHIFTS, int(size.max(initial=1)))):
                at = np.flatnonzero((key[shift:] == key[:-shift]) & short[shift:])
                near = at[_near(fp[at], fp[at + shift], max_bits)]
                found.update(zip(ids[near].tolist(), ids[near + shift].tolist(), strict=True))
            for s, m in zip(start[size > SHIFTS].tolist(), size[size > SHIFTS].tolist(), strict=True):
                found.update(_wide_forest(ids[s : s + m], fp[s : s + m], max_bits))
            held.join(found)
            if len(held.up) >= HELD:
                yield given(held)
                held = Stars()
        if held.up:
            yield given(held)

    return posts.mapInArrow(run, EDGES).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of near-duplicates the row of docs with the smallest id, with all its columns.

    Rows are near-duplicates if the cosine similarity of their shingles is at least `similarity` by their 256-bit SimHash;
    groups are what such links connect. Three of 64 bits, as in near_duplicates(), would be a similarity of 0.99. Null text: as
    empty, which is like any text without words. A null id is only kept where a group has no other. Of rows in a group that
    share the smallest id one stays, that of the least hash. Very long texts are hashed whole. An empty table stays empty.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    fps = docs.select(F.col(key).cast("long").alias("doc_id"), hashed.alias("th"), wide_column(F.col(text), shingle).alias("w")).select("doc_id", "th", "w.*")
    fps = table(fps.withColumn("id", F.xxhash64(*WIDE)), "simhash")
    own = table(fps.select("id", *WIDE).distinct(), "fingerprints")
    found = own.join(components(wide_links(own, bits_apart(similarity))), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    found = table(found, "components").select("id", "root")
    # the least of a group by partial sums: no join by group, which a group with a third of all rows would make one task
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = fps.join(found, "id").groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.th").alias("__ramify_th"), F.col("x.doc_id").alias("__ramify_id"))
    marked = docs.withColumn("__ramify_own", hashed)
    kept = marked.join(first, (F.col("__ramify_own") == F.col("__ramify_th")) & F.col(key).cast("long").eqNullSafe(F.col("__ramify_id")), "left_semi")
    return kept.dropDuplicates([key, "__ramify_own"]).drop("__ramify_own")
