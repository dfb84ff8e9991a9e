import base64
import collections
import functools
import hashlib
import json
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ramify.llm import attribution, common, components, ctw, imatch, packing, quality, queries, sharding, simhash, substring, warc, word_bpe, words
from ramify.llm.bpe import byte_bpe, default_path

from .conftest import awkward, corpus, make, prose


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def raw(text):
    return (text or "").encode()


# document fingerprints


def test_imatch_edits_and_neighbours(docs):
    got, rows = by_id(imatch.fingerprints(docs, low=0.01, high=0.4)), sorted(corpus(), key=lambda x: -x[0])
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1
    assert got[3].fingerprint == got[14].fingerprint == got[15].fingerprint == got[16].fingerprint  # case doesn't count
    assert got[15].near_next == got[16].near_next == 1  # 14 and 15, copies
    assert got[1].fingerprint != got[2].fingerprint
    long = [got[i] for i in range(6, 14)]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)


def spark_hash(raw_, seed=42):
    return xxhash.xxh64_intdigest(raw_, seed)


def plain_imatch(rows, low=1 / 5000, high=1 / 20, least=3, subsets=16, levels=5, seed=42):
    """Fingerprints as entries, and likenesses, by sets of words."""
    eight = lambda x: struct.pack("<Q", x & (1 << 64) - 1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = lambda t: {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    texts = {t or "" for _, t in rows}
    df = collections.Counter(w for t in texts for w in words(t))
    band = {w: spark_hash(w.encode()) >> 1 for w, c in df.items() if low * len(texts) <= c <= max(high * len(texts), least)}

    def entry(ts):
        h = 42
        for t in sorted(ts):
            h = spark_hash(eight(t), h)
        return signed(h) % 65535 + 1 if ts else 0

    def fp(t):
        own = {band[w] for w in words(t) if w in band}
        parts = [[entry({x for x in own if spark_hash(eight(j + seed), spark_hash(eight(x))) % 4**n == 0}) for j in range(subsets)] for n in range(1, levels + 1)]
        return entry(own), parts, None if own else t

    def like(f, g):
        if f[2] is not None and g[2] is not None:
            return float(f[2] == g[2])
        tally = [(sum(x == y != 0 for x, y in zip(a, b, strict=True)), sum((x or y) != 0 for x, y in zip(a, b, strict=True))) for a, b in zip([[f[0]], *f[1]], [[g[0]], *g[1]], strict=True)]
        full = [x for x in tally[1:] if 2 * x[1] >= subsets]
        same, either = full[-1] if full else map(sum, zip(*tally, strict=True))
        return same / either

    order = sorted(((i, t or "") for i, t in rows), key=lambda x: -x[0])
    out = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 3
        f, e = fp(t), fp(t[: len(t) - cut] + nxt[:cut])
        text = lambda f: f"{f[0]:04x}" + "".join(f"{x:04x}" for p in f[1] for x in p) if f[2] is None else f"x{spark_hash(f[2].encode()):016x}"
        out[i] = (text(f), text(e), pytest.approx(like(f, e)), pytest.approx(like(f, fp(nxt))))
    return out


@pytest.mark.parametrize("sizes", [{}, {"low": 0.02, "high": 0.4}, {"subsets": 4, "levels": 2, "seed": 7, "broadcast_rows": 0}])
def test_imatch_against_sets_of_words(docs, sizes):
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.fingerprints(docs, **sizes).collect()}
    assert got == plain_imatch(corpus(), **{k: v for k, v in sizes.items() if k != "broadcast_rows"})


def test_imatch_of_few_documents_and_of_very_many_copies(spark):
    few = imatch.fingerprints(make(spark, [(i, prose(i, 120, 3000)) for i in range(12)])).collect()
    assert all(0 < r.near_edited < 1 and r.near_next < r.near_edited for r in few)
    copies = [(i, prose(500, 120, 3000)) if i % 3 == 0 else (i, prose(i, 120, 3000)) for i in range(120)]
    got = imatch.fingerprints(make(spark, copies)).collect()
    assert all(r.near_edited > 0 for r in got if r.doc_id % 3 == 0) and len({r.fingerprint for r in got}) == 81


def test_imatch_of_an_id_with_very_many_rows(spark):
    rows = [(None if i % 3 else i, prose(i, 40)) for i in range(150)]
    got = imatch.fingerprints(make(spark, rows)).collect()
    want = collections.Counter((i, len(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_chars) for r in got) == want
    # the rows are one ring: each text is the next of one row
    starts = collections.Counter(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for (_, t) in rows for (_, n) in rows)
    assert all(r.edited_sha256 in starts for r in got)


def test_imatch_is_native(docs, monkeypatch):
    plans = []
    keep = imatch.table
    monkeypatch.setattr(imatch, "table", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))  # noqa: SLF001
    plans.append(imatch.fingerprints(docs)._jdf.queryExecution().toString())  # noqa: SLF001
    assert len(plans) == 5 and not any(x in plan for x in ("Python", "Pandas", "Arrow") for plan in plans)


def test_imatch_writes_few_files_of_copies_and_terms(spark, monkeypatch):
    files, plans, keep = {}, {}, imatch.table

    def table(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
        out = keep(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(imatch, "table", table)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = [(i, prose(i // 2, 60, 3000)) for i in range(400)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.fingerprints(make(spark, rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_imatch(rows)
    assert files["copies"] <= 4 and files["lexicon"] <= 4
    # what the grouping by row sorts has what is shown of a document once, not beside each of its terms
    plan = plans["fingerprints"]
    assert "first(about#" in plan and regex.search(r"Project \[[^\n]*CASE WHEN \(code#\d+L? = 0\) THEN about#", plan)


def test_imatch_lexicon_band(spark):
    df = spark.createDataFrame([(f"all a{i % 2} own{i}",) for i in range(20)], "text string")
    assert imatch.lexicon(df, 0.1, 0.6).count() == 2  # a0 and a1
    assert imatch.lexicon(df, 0, 1).count() == 23


def test_imatch_awkward_rows(odd, none, spark):
    rows = imatch.fingerprints(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in awkward())
    assert imatch.fingerprints(none).count() == 0
    alone = imatch.fingerprints(make(spark, [(5, "to be or not to be")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"to be or notto be ").hexdigest()


# SimHash


def plain_fingerprint(text, k=3):
    words = raw(text).lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_groups(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_against_all_pairs(docs):
    got, rows = by_id(simhash.near_duplicates(docs)), corpus()
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {i: (got[i].fingerprint, got[i].component_id) for i, _ in rows} == {i: (f"{f:016x}", g) for (i, _), f, g in zip(rows, fps, groups, strict=True)}


@pytest.mark.parametrize("most", [2, 16, 512])
def test_links_connect_like_all_pairs(spark, most):
    rnd = random.Random(7)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        x = rnd.choice(fps)
        for _ in range(rnd.randint(1, 5)):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    found = components.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), most=most)).collect()
    at = {r.node: r.root for r in found}
    groups = plain_groups([x & (1 << 64) - 1 for x in fps], lambda a, b: (a ^ b).bit_count() <= 3)
    assert [at.get(x, x) for x in fps] == [fps[g] for g in groups]


def test_components_of_a_chain_and_a_star(spark):
    chain, star = [(i, i + 1) for i in range(200)], [(1000, 1000 + i) for i in range(1, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(201)} == {0} and {got.get(1000 + i, 1000 + i) for i in range(100)} == {1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_awkward_rows(odd, none):
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    ids = {}
    for i, t in awkward():
        f = f"{plain_fingerprint(t):016x}"
        ids[f] = min(x for x in (ids.get(f), i) if x is not None) if (ids.get(f), i) != (None, None) else None
    assert got == collections.Counter((i, f"{plain_fingerprint(t):016x}", ids[f"{plain_fingerprint(t):016x}"]) for i, t in awkward())
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def plain_wide(text, k=5):
    """256 bits as one number: four SplitMix64 mixes of each shingle's hash, counted bit by bit."""
    words, mask = raw(text).lower().split(), (1 << 64) - 1
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [0] * 256
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for w in range(4):
            z = (h + (w + 1) * 0x9E3779B97F4A7C15) & mask
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
            z ^= z >> 31
            for b in range(64):
                counts[64 * w + b] += z >> b & 1
    return sum(1 << b for b in range(256) if 2 * counts[b] > len(grams))


def plain_similar(rows):
    return plain_groups([plain_wide(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 52)


def test_keep_one_keeps_all_columns_and_one_of_each(docs, odd):
    assert simhash.bits_apart(0.8) == 52
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(plain_similar(corpus()))
    assert simhash.keep_one(odd).count() == len(set(plain_similar(awkward())))


def test_keep_one_finds_near_copies_and_leaves_others(spark):
    rnd, rows = random.Random(2), []
    for g in range(60):
        words = prose(g, 150, 3000).split()
        rows.append((10 * g, " ".join(words)))
        for c in range(1, 4):  # two changed words: a Jaccard similarity of 0.87 or more
            copy = list(words)
            for _ in range(2):
                copy[rnd.randrange(len(copy))] = f"other{rnd.random()}"
            rows.append((10 * g + c, " ".join(copy)))
    kept = {r.doc_id for r in simhash.keep_one(make(spark, rows)).collect()}
    assert {10 * g for g in range(60)} <= kept and len(kept) <= 62


@pytest.mark.parametrize(("shifts", "postings"), [(2, 8_000_000), (16, 500)])
def test_wide_links_of_short_and_long_lists(spark, shifts, postings, monkeypatch):
    monkeypatch.setattr(simhash, "SHIFTS", shifts)
    monkeypatch.setattr(simhash, "POSTINGS", postings)
    texts = [prose(g, 120, 4000).split() for g in range(8)]
    rows = [(i, " ".join([*t[: i % 100], f"w{i}", *t[i % 100 + 1 :]])) for i, t in enumerate(texts * 12)]
    kept = {r.doc_id for r in simhash.keep_one(make(spark, rows)).collect()}
    assert kept == set(range(8))


# repeated passages


def test_wide_fingerprints_that_share_five_bytes_meet(spark):
    rnd, rows, want = np.random.default_rng(4), [], set()
    for i in range(0, 400, 2):
        one = rnd.integers(0, 256, 32, dtype=np.uint8)
        other = one ^ (1 << rnd.integers(0, 8, 32)).astype(np.uint8)
        same = rnd.choice(32, 5, replace=False) if i else np.array([0, 4, 8, 16, 24])
        other[same] = one[same]
        rows += [(i + j, *x.view("<i8").tolist()) for j, x in enumerate((one, other))]
        want.add((i, i + 1))
    found = simhash.wide_links(spark.createDataFrame(rows, "id long, a long, b long, c long, d long"), 27).collect()
    assert {tuple(sorted((r.a, r.b))) for r in found} == want


def plain_removals(rows, k=20):
    """For each row the words that go, by comparing word sequences."""
    first = {}
    key = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        w = raw(t).split()
        for s in range(len(w) - k + 1):
            seq = tuple(w[s : s + k])
            first[seq] = min(first.get(seq, (math.inf, 0)), (key(i), s))
    out = []
    for i, t in rows:
        w = raw(t).split()
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (key(i), s):
                gone.update(range(s, s + k))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("k", [3, 20])
def test_removals_against_word_sequences(docs, k):
    assert collections.Counter(map(tuple, substring.removals(docs, k=k).collect())) == plain_removals(corpus(), k)


def test_removals_of_awkward_rows(odd, none):
    assert collections.Counter(map(tuple, substring.removals(odd).collect())) == plain_removals(awkward())
    assert substring.removals(none).count() == 0


def test_window_hashes_are_equal_for_equal_windows():
    t = np.random.default_rng(0).integers(0, 2**63, 50, np.uint64)
    h = substring.window_hashes(np.concatenate((t, t[:7], t)), 20)
    assert len(h) == 88 and (h[57:] == h[:31]).all() and len(set(h[:50].tolist())) == 50
    assert len(substring.window_hashes(t[:19], 20)) == 0


@pytest.mark.parametrize("batch_words", [300, 10**6])
def test_windows_that_share_a_hash_are_told_apart(monkeypatch, batch_words):
    """With 18 bits of hash thousands of windows meet others; the check, the same in all batches, keeps them apart."""
    whole = substring.window_hashes
    short = lambda tokens, k, base=substring.BASE: whole(tokens, k, base) & np.uint64(~(2**46 - 1) & (2**64 - 1) if base == substring.BASE else 2**64 - 1)
    monkeypatch.setattr(substring, "window_hashes", short)
    monkeypatch.setattr(substring, "BATCH_WORDS", batch_words)
    rows, k, sent = [(i, t) for i, t in corpus() if t], 5, collections.defaultdict(list)
    own = [whole(np.fromiter(map(substring._WordHash().__getitem__, raw(t).split()), np.uint64), k) for _, t in rows]
    every = np.unique(np.concatenate(own))
    assert len(every) - len(np.unique(every >> np.uint64(46))) > 100
    batch = substring._Batch(k, 3)
    for i, t in rows:
        if batch.full(i):
            for r in batch.rows():
                sent[r["part"]].append(r)
            batch.start()
        batch.add(i, 0, raw(t))
    for r in batch.rows():
        sent[r["part"]].append(r)
    buckets = collections.defaultdict(list)
    for part in sent.values():
        for out in substring._repeats(part, 3):
            for r in out.to_pylist():
                buckets[r["bucket"]].append(r)
    gone = {r["doc_id"]: r["starts"] for b in buckets.values() for out in substring._merged(b) for r in out.to_pylist()}
    got = collections.Counter()
    for i, t in rows:
        words = raw(t).split()
        out = substring.covered(len(words), gone.get(i, b""), k)
        got[i, len(words), int(out.sum()), hashlib.sha256(b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x)).hexdigest()] += 1
    assert got == plain_removals(rows, k)


def test_remove_repeats_changes_only_texts_that_lose_words(docs, none):
    after, before = by_id(substring.remove_repeats(docs)), dict(corpus())
    gone = {r.doc_id: r for r in substring.removals(docs).collect()}
    for i, t in before.items():
        if gone[i].n_removed:
            assert hashlib.sha256(after[i].text.encode()).hexdigest() == gone[i].kept_sha256 and after[i].n_chars == len(after[i].text)
        else:
            assert after[i].text == t
    assert substring.remove_repeats(docs).columns == docs.columns and substring.remove_repeats(none).count() == 0


# sharding


def check_shards(df, rows, shards=24):
    got = df.collect()
    want = collections.Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t)), "bytes", None) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
    at = collections.defaultdict(list)
    for r in got:
        at[r.shard].append(r.slot)
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in at.items())
    return got


def test_shards_are_near_equal(spark):
    rows = [(i, prose(i, 20 + i % 50)) for i in range(600)] + [(1000 + i, "the same text, over and over " * 5) for i in range(300)]
    got = check_shards(sharding.shard_by_bytes(make(spark, rows), shards=8), rows, 8)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean, most = sum(sizes.values()) / 8, max(r.size for r in got)
    assert len(sizes) == 8 and all(abs(x - mean) <= 2 * most + 0.01 * mean for x in sizes.values())


def test_shards_of_awkward_rows(docs, odd, none):
    check_shards(sharding.shard_by_bytes(docs), corpus())
    check_shards(sharding.shard_by_bytes(odd), awkward())
    assert sharding.shard_by_bytes(none).count() == 0


def test_cells_against_plain_comparison():
    rnd = random.Random(3)
    keys = [(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(200)]
    probes = sorted({(rnd.randint(0, 5), rnd.choice([sharding.KEY_LOW, 1, 3, 5])) for _ in range(12)})
    h, d = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    assert sharding.cell_of(h, d, *sharding.arrays(probes)).tolist() == [sum(p <= k for p in probes) for k in keys]


# quality


def plain_quality(text):
    b = raw(text)
    w = b.split()
    lines = [x for x in b.split(b"\n") if x.split()]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def plain_kept(text, rules=quality.CLEAN):
    """The verdict by the words of the rules: base rule, band of the whole text, share of chunks outside their band."""
    n, _, _, _, repeat = plain_quality(text)
    b = raw(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    ratio = lambda x: len(zstandard.ZstdCompressor(level=3, write_checksum=False).compress(x)) / len(x)
    band = [(low, high) for size, low, high in rules.bands if len(b) >= size][-1:]
    if not all(low <= ratio(b) <= high for low, high in band):
        return False
    chunks = [b[i : i + 4096] for i in range(0, len(b), 4096)] if band and len(b) > 4096 else []
    if chunks and len(chunks[-1]) < 4096:
        chunks[-1] = b[-4096:]
    found = [ratio(c) for c in chunks]
    low, high = rules.chunk_band
    return sum(x < low for x in found) <= 0.25 * len(found) and sum(x > high for x in found) <= 0.25 * len(found)


def test_kept_against_the_words_of_the_rules(spark, docs):
    got = by_id(queries.op5_quality_rules(spark, "/root/testdata/sf0.001"))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: plain_kept(r.text) for r in rows}
    assert {i: r.kept for i, r in got.items()} == want and 0 < sum(want.values()) < len(want)
    assert sum(not r.base_failed and not r.kept for r in got.values()) > 0
    wide = by_id(quality.rate(docs))
    assert {i: wide[i].kept for i, _ in corpus()} == {i: plain_kept(t, quality.Bands()) for i, t in corpus()}


def test_quality_counts(docs, odd, none):
    got = by_id(quality.rate(docs))
    for i, t in corpus():
        n, chars, symbols, lines, repeat = plain_quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    assert quality.rate(odd).count() == len(awkward()) and quality.rate(none).count() == 0


def test_bands_reject_what_repeats_and_what_is_random(spark):
    rnd = random.Random(5)
    noise = " ".join("".join(chr(rnd.randrange(33, 127)) for _ in range(40)) for _ in range(400))
    stutter = " ".join(f"{w} {w} {w}" for w in prose(1, 40).split()) + " " + "".join(f"na{i % 7}" + "na" * 300 + f" k{i} q{i} " for i in range(60))
    half = prose(3, 4000, 5000) + " " + " ".join("z" * 997 + str(i) for i in range(12))
    rows = [(1, prose(8, 600, 5000)), (2, noise), (3, stutter), (4, half)]
    got = by_id(quality.rate(make(spark, rows)))
    assert [got[i].reason for i, _ in rows] == [None, "incompressible", "repetitive", "repetitive chunks"]
    assert {r.doc_id for r in quality.keep_good(make(spark, rows)).collect()} == {1}


def test_clean_bands_reject_stuck_on_symbols(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = queries.op5_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    junk = {i for i, t in texts.items() if sum(c.isalpha() or c.isspace() for c in t) < 0.8 * len(t)}
    clean, bad = [r.kept for r in rows if r.doc_id in good], [r.kept for r in rows if r.doc_id in junk]
    assert sum(clean) >= 0.97 * len(clean) and sum(bad) <= 0.25 * len(bad) and bad


def test_chunks_cover_the_tail(spark):
    clean, junk = prose(8, 900, 5000).replace("é", "e").replace("ö", "o")[:4096], base64.b64encode(random.Random(3).randbytes(4000)).decode()[:4095]
    got = by_id(quality.rate(make(spark, [(1, clean + junk), (2, junk + clean), (3, clean * 2)])))
    assert got[1].reason == got[2].reason == "incompressible chunks"
    assert [got[i].n_chunks for i in (1, 2, 3)] == [2, 2, 2]


def test_keep_good_is_what_rate_keeps(docs, odd, none):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.rate(docs).collect() if r.kept}
    assert quality.keep_good(odd).count() == sum(r.kept for r in quality.rate(odd).collect()) and quality.keep_good(none).count() == 0


# BPE


def test_word_bpe_against_the_library(docs, odd, none):
    tok = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    got = by_id(word_bpe.encode(docs))
    for i, t in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == tok.decode(ids, skip_special_tokens=False)
    many = collections.Counter((r.doc_id, tuple(r.ids)) for r in word_bpe.encode(odd).collect())
    assert many == collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in awkward())
    assert word_bpe.encode(none).count() == 0


def test_byte_bpe_against_the_library():
    tok = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    bpe = byte_bpe(default_path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in corpus()] + ["  a   b\n\n\tc  ", "it's we'll  I'M", "x<|endoftext|>y", "   z", "é́á", "1234567 ½²", " " * 50, "a " * 120_000]
    for t in texts:
        ids = bpe.ids(t)
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert bpe.n_bytes[ids].sum() == len(t.encode())


# token attribution


def plain_sections(text, sep, tok):
    spans, at = [], 0
    for line in text.split(sep):
        spans.append((at, min(len(text), at + len(line) + len(sep))))
        at = spans[-1][1]
    if len(spans) > 1 and spans[-1][0] == spans[-1][1]:
        spans.pop()
    counts = [0] * len(spans)
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(b, y) - max(a, x)) for x, y in spans]
        counts[share.index(max(share))] += 1
    return [(i, a, b, c) for i, ((a, b), c) in enumerate(zip(spans, counts, strict=True))]


@pytest.mark.parametrize("sep", ["\n", " ", "an"])
def test_attribution_against_offsets(docs, sep):
    tok = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in attribution.attribute(docs, separator=sep).collect():
        got[r.doc_id].append((r.section, r.start_char, r.end_char, r.n_tokens))
    for i, t in corpus():
        if all(ord(c) < 0x3000 for c in t or ""):  # the library gives each part of a split character the whole of it
            assert sorted(got[i]) == plain_sections(t or "", sep, tok)
        assert sum(x[3] for x in got[i]) == len(tok.encode(t or "", add_special_tokens=False).ids)


def test_a_crossing_token_goes_to_the_larger_share():
    raw_ = b"aab|b"
    tokens, crossing = attribution.allocate(np.array([0, 1]), np.array([1, 5]), np.array([0, 4, 5]), raw_)
    assert tokens.tolist() == [2, 0] and crossing.tolist() == [1, 0]
    tokens, _ = attribution.allocate(np.array([0]), np.array([2]), np.array([0, 1, 2]), b"ab")
    assert tokens.tolist() == [1, 0]  # a tie: the earlier


def test_attribution_of_fields_and_awkward_rows(docs, odd, none, spark):
    rows = attribution.attribute(docs.where("doc_id = 25"), fields=("fingerprint", "text")).orderBy("section").collect()
    assert [(r.section, r.start_char, r.end_char) for r in rows] == [(0, 0, 2), (1, 2, 2 + 8)] or len(rows) >= 2
    assert {r.doc_id for r in attribution.attribute(odd).collect()} == {i for i, _ in awkward()}
    assert attribution.attribute(none).count() == 0


# WARC

PAGES = "page_id long, url string, html string, shard int, digest string, payload string"


def plain_pages(rows):
    last = {}
    for i, _, h in rows:
        last[raw(h)] = max(last.get(raw(h), -(2**63)), -(2**63) if i is None else i)
    out = collections.Counter()
    for i, _, h in rows:
        p = raw(h)
        again = len(p) >= 1000 and last[p] != (-(2**63) if i is None else i)
        out[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None)] += 1
    return out


def test_warc_round_trip(spark):
    big = ["<p>" + prose(s, 300) + "</p>" for s in range(4)]
    rows = [(i, f"http://x/{i}", big[i % 4]) for i in range(60)] + [(100, None, None), (101, "u\r\nInjected: 1", "short"), (102, "u", "short"), (103, "u", ""), (104, "u", big[0]), (104, "u", big[0]), (None, "v", big[1]), (None, "v", big[1]), (105, "w", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*r, 1, "d", "p") for r in rows], PAGES)
    assert collections.Counter(map(tuple, warc.round_trip(df).collect())) == plain_pages(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_writes_the_same_bytes_and_rolls(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", prose(i, 400), 1, "d", "p") for i in range(40)], PAGES)
    seen = []
    for name in ("a", "b"):
        warc.write(df.repartition(3), f"file://{tmp_path}/{name}", shard_bytes=20_000, roll_bytes=4_000)
        files = {f: open(tmp_path / name / f, "rb").read() for f in sorted(os.listdir(tmp_path / name)) if not f.startswith((".", "_"))}
        seen.append(files)
    assert seen[0] == seen[1] and len([f for f in seen[0] if f.endswith(".gz")]) > len([f for f in seen[0] if f.endswith(".json")]) > 1
    assert not [f for f in os.listdir(tmp_path / "a") if "temporary" in f]
    back = {r.page_id: r.payload for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert {i: bytes(p) for i, p in back.items()} == {i: prose(i, 400).encode() for i in range(40)}


def test_warc_of_very_many_shards(spark, tmp_path):
    rows = [(7 * i + (i > 2500) * 10**9, "u", f"page {i} " * 20, 1, "d", "p") for i in range(5000)]
    target = f"file://{tmp_path}/many"
    assert warc.write(spark.createDataFrame(rows, PAGES), target, shard_bytes=800) == 5000
    assert {r.page_id: bytes(r.payload) for r in warc.read(spark, target).collect()} == {i: h.encode() for i, _, h, *_ in rows}


def test_warc_divides_an_id_with_very_many_rows(spark, tmp_path):
    rows = [(None if i % 2 else i, "u", f"{i} " * 300, 1, "d", "p") for i in range(400)]
    target = f"file://{tmp_path}/hot"
    assert warc.write(spark.createDataFrame(rows, PAGES), target, shard_bytes=20_000) > 15
    sizes = [sum(f["records"] for f in json.loads((tmp_path / "hot" / n).read_text())["files"]) for n in os.listdir(tmp_path / "hot") if n.startswith("shard") and n.endswith("json")]
    assert max(sizes) < 60 and sum(sizes) == 400
    assert sorted(bytes(r.payload) for r in warc.read(spark, target).collect()) == sorted(h.encode() for _, _, h, *_ in rows)


def test_warc_read_refuses_what_is_not_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", prose(i, 100), 1, "d", "p") for i in range(60)], PAGES)
    for n, (gone, error) in enumerate([("MANIFEST.json", FileNotFoundError), ("shard-00001.json", ValueError), ("shard-00001-00000.warc.gz", FileNotFoundError)]):
        warc.write(df, f"file://{tmp_path}/{n}", shard_bytes=10_000)
        assert warc.read(spark, f"file://{tmp_path}/{n}").count() == 60
        os.remove(tmp_path / str(n) / gone)
        with pytest.raises(error):
            warc.read(spark, f"file://{tmp_path}/{n}").collect()


def test_ranges_by_binary_search(spark):
    rnd = random.Random(9)
    bounds, hot = sorted(rnd.sample(range(-1000, 1000), 300)), {5: 3, -(2**63): 2}
    rows = [(rnd.randint(-1100, 1100), rnd.randrange(2**31)) for _ in range(2000)] + [(5, s) for s in (0, 2**30, 2**31 - 1)] + [(-(2**63), 0), (2**63 - 1, 1)]
    df = spark.createDataFrame(rows, "k long, s long")
    assert [r.n for r in df.select(common.rank_in(F.col("k"), bounds).alias("n")).collect()] == [sum(b <= k for b in bounds) for k, _ in rows]
    got = [r.n for r in df.select(common.range_of(F.col("k"), F.col("s"), bounds, hot).alias("n")).collect()]
    order = sorted(range(len(rows)), key=lambda i: rows[i])
    assert all(got[a] <= got[b] for a, b in zip(order, order[1:], strict=False))
    assert sorted(g for g, (k, _) in zip(got, rows, strict=True) if k == 5)[-3:][0] < max(g for g, (k, _) in zip(got, rows, strict=True) if k == 5)


def test_a_damaged_record_is_refused():
    import gzip

    one = gzip.decompress(warc.record({"page_id": 1, "url": "u", "payload": b"abc", "digest": hashlib.sha1(b"abc").hexdigest(), "first": 1}))
    assert warc.parse(one)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"abc", b"abd"))


# context-tree weighting


def plain_kt(bits):
    p, n = 1.0, [0, 0]
    for b in bits:
        p *= (n[b] + 0.5) / (sum(n) + 1)
        n[b] += 1
    return p


def test_block_estimate_is_sequential_kt():
    for bits in ([0], [1, 1, 0], [0, 1, 1, 1, 0, 1]):
        z, o = np.array([bits.count(0)]), np.array([bits.count(1)])
        assert math.exp(ctw.block_estimate(z, o)[0]) == pytest.approx(plain_kt(bits), rel=1e-9)
    n = np.array([0, 5, ctw._LogGamma.TABLE - 1, ctw._LogGamma.TABLE, 10**7])
    assert np.allclose(ctw._HALF(n), [math.lgamma(x + 0.5) for x in n.tolist()], rtol=1e-13)


def plain_ctw(texts, text, depth):
    """The weighted mixture of all contexts of the training texts by recursion over dictionaries, for one text."""
    pad = bytes([255])
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        s = pad * depth + t.lower() + pad
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[s[i - d : i]][s[i]] += 1
    kids = collections.defaultdict(list)
    for c in list(counts):
        if c:
            kids[c[1:]].append(c)

    def decide(c, prefix, bit):
        z = o = 0
        for b, k in counts[c].items() if c in counts else ():
            if b >> (8 - bit) == prefix:
                if b >> (7 - bit) & 1:
                    o += k
                else:
                    z += k
        return z, o

    def log_kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    @functools.cache
    def weighted(c, prefix, bit):
        own = log_kt(*decide(c, prefix, bit))
        if len(c) == depth:
            return own
        return np.logaddexp(own, sum(weighted(k, prefix, bit) for k in kids[c])) - math.log(2)

    def predict(c, past, prefix, bit):
        z, o = decide(c, prefix, bit)
        own = (o + 0.5) / (z + o + 1)
        further = past[len(past) - len(c) - 1 :]
        if len(c) == depth or not sum(decide(further, prefix, bit)):
            return own
        stay = math.exp(log_kt(z, o) - math.log(2) - weighted(c, prefix, bit))
        return stay * own + (1 - stay) * predict(further, past, prefix, bit)

    s, total = pad * depth + text.lower() + pad, 0.0
    for i in range(depth, len(s)):
        for bit in range(8):
            p = predict(b"", s[i - depth : i], s[i] >> (8 - bit), bit)
            total += math.log10(p if s[i] >> (7 - bit) & 1 else 1 - p)
    return total


@pytest.mark.parametrize(("depth", "sizes"), [(3, {}), (6, {}), (6, {"block_bytes": 100, "part_bytes": 60}), (7, {"block_bytes": 100})])
def test_ctw_against_recursion(spark, depth, sizes):
    rows = [(i, prose(4, 40)[7 * i : 7 * i + 60]) for i in range(12)] + [(50, None), (51, ""), (52, "neu è ÉÈ"), (None, prose(5, 9)), (3, "again"), (3, "again")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [raw(t) for i, t in rows if not held(i)]
    assert 0 < len(texts) < len(rows)
    got = collections.defaultdict(list)
    for r in ctw.score(make(spark, rows).repartition(2), depth=depth, **sizes).collect():
        got[r.doc_id].append(r.score)
        assert r.bits_per_byte > 0
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(plain_ctw(texts, raw(t), depth))
    assert {i: sorted(x) for i, x in got.items()} == {i: pytest.approx(sorted(x), rel=1e-6) for i, x in want.items()}


def test_ctw_grams_grow_with_the_corpus(spark):
    sizes = []
    for n in (40, 160):
        own = common.narrow(make(spark, [(i, prose(i, 60)) for i in range(n)]), "doc_id", "text")
        rows = ctw.counted(own, 6, 5, lambda doc: True, most=500).collect()
        sizes.append(sum(len(ctw._keys(r["keys"])) for r in rows))
        assert sum(int(ctw.unpack_array(r["counts"], np.int64).sum()) for r in rows) == sum(len(raw(prose(i, 60))) + 1 for i in range(n))
    assert sizes[1] > 1.5 * sizes[0]


def test_ctw_probabilities_add_up(spark):
    own = common.narrow(make(spark, [(i, prose(i, 60)) for i in range(20)]), "doc_id", "text")
    merged = ctw.counted(own, 6, 1, lambda doc: True)
    row = merged.first()
    tree = ctw.top_of(merged) | ctw.levels(ctw._keys(row["keys"]), ctw.unpack_array(row["counts"], np.int64), 6, 3)
    ctw.weigh({d: tree[d] for d in range(3, 7)}, None)
    for d in range(3, 7):
        tree[d].predict(tree[d - 1])
    for context in (ctw._keys(row["keys"])[77] >> np.uint64(8), np.uint64(0x616263646566), np.uint64(0x7A7A7A7A7A7A)):
        logs = ctw.log_probabilities((context << np.uint64(8)) + np.arange(256, dtype=np.uint64), tree, 6)
        assert (10.0**logs).sum() == pytest.approx(1)


def test_ctw_scores_and_base(docs, odd, none):
    got, rows = by_id(ctw.score(docs)), corpus()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*raw(t).lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words, r = [*raw(t).lower().split(), None], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r.score < 0
    assert ctw.score(odd).count() == len(awkward()) and ctw.score(none).count() == 0


def test_ctw_prefers_its_own_language(spark):
    rnd = random.Random(1)
    noise = "".join(chr(rnd.randrange(97, 123)) for _ in range(2000))
    own = [(i, prose(200, 300)[11 * i :]) for i in range(40)]
    out = next(i for i in range(100, 200) if ctw.held_out(i))
    got = by_id(ctw.score(make(spark, [*own, (out, noise)])))
    assert max(r.bits_per_byte for i, r in got.items() if r.held_out and i != out) < 3 < got[out].bits_per_byte


def test_long_texts_are_cut_into_pieces_with_their_context(monkeypatch):
    held = [(i, raw(t)) for i, t in corpus()]
    whole = np.sort(np.concatenate([s.keys(6) for s in ctw.segments(iter(held), 6)]))
    monkeypatch.setattr(ctw, "SEGMENT", 97)
    assert (np.sort(np.concatenate([s.keys(6) for s in ctw.segments(iter(held), 6)])) == whole).all()


def test_messages_grow_no_faster_than_distinct_words(spark):
    seen = []
    for n in (60, 120):  # with the parts growing, too
        texts = [raw(prose(i, 100, 3000)) for i in range(n)]
        held = [(i, t) for i, t in enumerate(texts)]
        blocks = [held[i : i + 5] for i in range(0, n, 5)]
        parts = n * 20
        sent = [sum(1 for _ in words.words_by_part(dict.fromkeys(w for _, t in b for w in t.split()), parts)) for b in blocks]
        most = [len({w for _, t in b for w in t.split()}) for b in blocks]
        assert all(a <= b for a, b in zip(sent, most, strict=True))
        seen.append(sum(sent))
    assert seen[1] < 2.5 * seen[0]


def test_word_bpe_in_many_blocks(docs):
    one, many = (sorted(map(tuple, word_bpe.encode(docs, **sizes).collect())) for sizes in ({}, {"block_bytes": 2000, "part_bytes": 5000}))
    assert one == many


# packing


def check_packing(got, rows, capacity=1024):
    tok = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for x in seqs.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(n for _, n in x) <= capacity
    return len(seqs)


def test_packing(docs, odd, none):
    check_packing(packing.pack(docs).collect(), corpus())
    check_packing(packing.pack(odd).collect(), awkward())
    check_packing(packing.pack(docs, capacity=16).collect(), corpus(), 16)
    assert packing.pack(none).count() == 0


def optimum(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[i]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_against_the_optimum():
    rnd = random.Random(11)
    for _ in range(60):
        capacity = rnd.choice([10, 20, 50])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 10))]
        plan, bound = packing.bin_completion(dict(collections.Counter(sizes)), capacity)
        used = collections.Counter(s for own, n in plan for s in own for _ in range(n))
        assert used == collections.Counter(sizes) and all(sum(own) <= capacity for own, _ in plan)
        best = optimum(sizes, capacity)
        assert bound <= best <= sum(n for _, n in plan) <= best + 1
        assert packing.lower_bound(collections.Counter(sizes), capacity) <= best


def test_bin_completion_beats_best_fit():
    counts = dict(collections.Counter([6, 6, 5, 5, 5, 4, 4, 3, 2, 2, 7, 3]))
    plan, bound = packing.bin_completion(counts, 13)
    assert sum(n for _, n in plan) == bound == 4
    plan, _ = packing.bin_completion({300: 10**9, 724: 10**9}, 1024)
    assert sum(n for _, n in plan) == 10**9  # counts, not documents, make the work


def test_lower_bound_shows_what_is_least():
    rnd = random.Random(4)
    assert packing.lower_bound({300: 10, 320: 20}, 1024) == 10  # over a quarter: three at most
    assert packing.lower_bound({513: 3, 512: 4}, 1024) == 5  # halves exactly
    assert packing.lower_bound({}, 1024) == 0 and packing.lower_bound({1024: 7}, 1024) == 7
    for low, high, each in ((300, 341, 3), (257, 340, 3), (210, 256, 4)):
        counts = collections.Counter(rnd.randint(low, high) for _ in range(999))
        plan, bound = packing.bin_completion(counts, 1024)
        assert sum(n for _, n in plan) == bound == -(-999 // each)


def test_runs_cover_all_ranks():
    plan = [((5, 5, 3), 4), ((5, 2), 2), ((3,), 1)]
    at = packing.runs(plan)
    assert at["length"].tolist() == [2, 3, 3, 5, 5, 5] and at["rank"].tolist() == [0, 0, 4, 0, 4, 8]
    assert at["offset"].tolist() == [5, 10, 0, 0, 5, 0]


# quality of the sample used above


def test_fixture_has_extra_columns_with_clashing_names(docs):
    assert {"fp", "h", "bucket", "shard", "block", "rank"} <= set(docs.columns) and docs.agg(F.count("*")).first()[0] == len(corpus())
