"""Quality rules: word statistics, and zstandard ratios within bands that depend on the length."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, id_out, narrow, per_batch

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, doc_ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, base_failed boolean, kept boolean, reason string"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Compressed size over size. A row of bands holds from its number of UTF-8 bytes on: least and greatest ratio.

    Short texts compress worse, so both limits fall with the length; texts under the first row's length have no limits.
    Chunks have chunk_bytes bytes each; the last one ends where the text does, and overlaps the one before if need be.
    A text goes if more than bad_share of its chunks are outside the chunk limits.
    """

    bands: tuple[tuple[int, float, float], ...] = ((256, 0.40, 0.92), (512, 0.34, 0.86), (1024, 0.28, 0.80), (2048, 0.24, 0.75), (8192, 0.20, 0.72))
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (0.20, 0.75)
    bad_share: float = 0.25
    level: int = 3
    min_words: int = 50
    max_repeat_share: float = 0.5


#: Fitted to the documents of sf0.1 that are labelled quality 1 and pass the base rule (3243), at level 3:
#: the least and greatest ratio in each row, and over their 1368 chunks, 0.008 further out. The last row has no labelled
#: document; its limits carry on those of the row before. Made for natural prose; the wide limits of Bands() are for any text.
CLEAN = Bands(
    bands=(
        (256, 0.594, 0.733), (384, 0.536, 0.716), (512, 0.546, 0.690), (640, 0.519, 0.687), (768, 0.508, 0.630), (896, 0.499, 0.602), (1024, 0.487, 0.588),
        (1280, 0.481, 0.569), (1536, 0.473, 0.551), (1792, 0.458, 0.535), (2048, 0.458, 0.529), (2560, 0.456, 0.516), (3072, 0.446, 0.502), (3584, 0.443, 0.491),
        (4096, 0.432, 0.480), (5120, 0.428, 0.474), (6144, 0.419, 0.466), (8192, 0.412, 0.459), (12288, 0.407, 0.450), (16384, 0.395, 0.436), (32768, 0.375, 0.430),
    ),
    chunk_band=(0.435, 0.490),
)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    if len(number) >= 1 << 21:  # three numbers no longer fit in 63 bits: number the pairs first
        _, pair = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * len(number) + at[2:]
    else:
        key = (at[:-2] << 42) | (at[1:-1] << 21) | at[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def ratios(raw: bytes, rules: Bands, press: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """The ratio of the whole text, and those of its chunks."""
    whole = len(press.compress(raw)) / len(raw) if raw else 0.0
    if len(raw) <= rules.chunk_bytes:
        return whole, [whole] if raw else []
    size = rules.chunk_bytes
    starts = [*range(0, len(raw) - size, size), len(raw) - size]
    return whole, [len(press.compress(raw[i : i + size])) / size for i in starts]


def verdict(size: int, whole: float, low: int, high: int, chunks: int, rules: Bands) -> str | None:
    """Why the compression bands reject a text, or None."""
    row = bisect_right([b[0] for b in rules.bands], size) - 1
    if row < 0:
        return None
    _, least, most = rules.bands[row]
    if whole < least:
        return "repetitive"
    if whole > most:
        return "incompressible"
    if low > rules.bad_share * chunks:
        return "repetitive chunks"
    if high > rules.bad_share * chunks:
        return "incompressible chunks"
    return None


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Bands = Bands()) -> DataFrame:
    """One row per row of docs with its statistics, base_failed, kept and the reason (null if kept).

    One pass over the input without a shuffle; a worker holds one slice of a batch at a time, and texts are read whole.
    Null text: as the empty text, no words, so base_failed. Null, tied or repeated ids: each row gets its own result.
    An empty table gives an empty result; columns other than key and text are not read.
    """
    schema = arrow_schema(SCHEMA)

    def make():
        press = zstandard.ZstdCompressor(level=rules.level, write_checksum=False)

        def work(batch: pa.RecordBatch) -> dict:
            rows = []
            for raw in batch.column(1).to_pylist():
                words = raw.split()
                n, joined = len(words), b"".join(words)
                lines = [x for x in raw.split(b"\n") if x.strip()]
                repeat = repeated_words(words)
                whole, parts = ratios(raw, rules, press)
                if len(raw) > rules.chunk_bytes:
                    low, high = sum(x < rules.chunk_band[0] for x in parts), sum(x > rules.chunk_band[1] for x in parts)
                else:  # the only chunk is the whole text, which the bands judge
                    low = high = 0
                failed = n < rules.min_words or repeat > rules.max_repeat_share * n
                why = "base" if failed else verdict(len(raw), whole, low, high, len(parts), rules)
                rows.append((n, len(joined.decode("utf-8", "replace")), len(joined) - len(joined.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, whole, len(parts), low, high, failed, why is None, why))
            cols = list(zip(*rows, strict=True))
            return {"doc_id": batch.column(0)} | dict(zip(schema.names[1:], map(list, cols), strict=True))

        return work

    out = narrow(docs, key, text).mapInArrow(per_batch(make, schema), SCHEMA)
    return out.withColumn("doc_id", id_out("doc_id"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Bands = Bands()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and in one pass.

    A filter by a vectorised UDF over the text alone, so that no id is needed: null and repeated ids lose no row.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def good(raws: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=rules.level, write_checksum=False)
        return pa.array([judge(x or b"", rules, press) for x in raws.to_pylist()], pa.bool_())

    return docs.where(good(F.col(text).cast("string").cast("binary")))


def judge(raw: bytes, rules: Bands, press: zstandard.ZstdCompressor) -> bool:
    """kept, as rate() finds it, for one text."""
    words = raw.split()
    if len(words) < rules.min_words or repeated_words(words) > rules.max_repeat_share * len(words):
        return False
    whole, parts = ratios(raw, rules, press)
    one = len(raw) <= rules.chunk_bytes
    low, high = (0, 0) if one else (sum(x < rules.chunk_band[0] for x in parts), sum(x > rules.chunk_band[1] for x in parts))
    return verdict(len(raw), whole, low, high, len(parts), rules) is None
