"""Token counts of sections: whole documents are encoded once, and token spans joined with section spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe, default_path
from .common import arrow_schema, id_in, id_out, per_batch

SPANS = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Joins token byte spans, which tile the text, with sections [edges[i], edges[i + 1]), which do too.

    A token within a section counts there. One that crosses a boundary counts for the section that has most of its
    characters, the earlier one if two have as many; a character that tokens share counts for the one with its first byte.
    Gives tokens, and those of them that cross, for each section.
    """
    n = len(edges) - 1
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    first, last = np.minimum(first, n - 1), np.minimum(last, n - 1)
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero(first != last).tolist():
        best, own = -1, int(first[t])
        for s in range(int(first[t]), int(last[t]) + 1):
            part = raw[max(starts[t], edges[s]) : min(ends[t], edges[s + 1])]
            chars = sum(b & 0xC0 != 0x80 for b in part)
            if chars > best:
                best, own = chars, s
        first[t] = own
        crossing[own] += 1
    return np.bincount(first, minlength=n), crossing


def attribute(docs: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("text",), separator: str = "\n", path: str | None = None) -> DataFrame:
    """One row per section of each row of docs: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    A document is its fields joined by the separator, encoded whole and once. Sections are what ends with a separator, which is
    a section's last character; so every field is a run of whole sections. The n_tokens of a document add up to its tokens.
    A null field is as an empty one; a document without a character has one section without tokens. Null, tied and repeated ids: each row has
    its own sections. An empty table gives an empty result. Other columns are not read.
    """
    schema, path = arrow_schema(SPANS), path or default_path("byte_bpe_50k.json")
    whole = F.concat_ws(separator, *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))

    def make():
        bpe, cut = byte_bpe(path), separator.encode()

        def work(batch: pa.RecordBatch) -> dict:
            ids, cols = batch.column(0).to_numpy(), [[] for _ in range(5)]
            many = []
            for text in batch.column(1).to_pylist():
                lines = text.split(separator)
                chars = np.cumsum([0, *(len(x) + len(separator) for x in lines)])
                raw = text.encode()
                sizes = np.fromiter((len(x.encode()) + len(cut) for x in lines), np.int64, len(lines))
                edges = np.concatenate(([0], np.cumsum(sizes)))
                chars[-1], edges[-1] = len(text), len(raw)
                if len(lines) > 1 and not lines[-1]:  # nothing follows the last separator
                    chars, edges = chars[:-1], edges[:-1]
                n = len(edges) - 1
                ends = np.cumsum(bpe.n_bytes[bpe.ids(text)])
                if len(raw) != (ends[-1] if len(ends) else 0):
                    raise ValueError("tokens don't cover their text")
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                tokens, crossing = allocate(starts, ends, edges, raw) if len(ends) else (np.zeros(n, np.int64),) * 2
                for col, x in zip(cols, (np.arange(n), chars[:-1], chars[1:], tokens, crossing), strict=True):
                    col.append(x)
                many.append(n)
            flat = [np.concatenate(c) for c in cols]
            return {"doc_id": np.repeat(ids, many), "section": flat[0].astype(np.int32), "start_char": flat[1], "end_char": flat[2], "n_tokens": flat[3], "n_crossing": flat[4]}

        return work

    return docs.select(id_in(key).alias("doc_id"), whole.alias("text")).mapInArrow(per_batch(make, schema), SPANS).withColumn("doc_id", id_out("doc_id"))
