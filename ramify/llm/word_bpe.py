"""BPE through a table of distinct words: each word is encoded once, ids are joined back by position, and decoded by piece."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import default_path
from .common import id_out, pack_array, unpack_array
from .words import BLOCK_BYTES, PART_BYTES, Docs, join_words

ENCODED = "doc_id long, ids array<int>, decoded string"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[int, str]:
    """The id-to-piece table, which is as large as the vocabulary. Such a tokenizer has no decoder: pieces are joined by spaces."""
    with open(path, encoding="utf-8") as f:
        if json.load(f)["decoder"] is not None:
            raise ValueError("only tokenizers without a decoder can be decoded by pieces")
    return {i: p for p, i in tokenizer(path).get_vocab(with_added_tokens=True).items()}


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, ids, decoded.

    For tokenizers that drop white space and never merge across it, so that a text's ids are those of its words in turn; words
    are split at ASCII white space, and other white space stays in a word, where the tokenizer drops it. Null text: as empty,
    no ids. Null, tied and repeated ids: each row is encoded for itself. Very long texts are read whole; one is a block by
    itself. An empty table gives an empty result. Other columns are not read.
    """
    path = path or default_path("word_bpe_49k.json")

    def number(held: Docs) -> dict[bytes, int]:
        return dict.fromkeys(chain.from_iterable(raw.split() for _, raw in held), 0)

    def answer(words: list[list[bytes]], _: list[np.ndarray]) -> list[bytes]:
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        ids: dict[bytes, list[int]] = {}
        for i in range(0, len(distinct), 4096):
            some = distinct[i : i + 4096]
            ids.update(zip(some, (e.ids for e in tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)), strict=True))
        out = []
        for ws in words:
            counts = pack_array(np.fromiter((len(ids[w]) for w in ws), np.int32, len(ws)))
            out.append(len(counts).to_bytes(4, "little") + counts + pack_array(np.fromiter(chain.from_iterable(ids[w] for w in ws), np.int32)))
        return out

    def finish(held: Docs, answers: Callable[[], Iterator[tuple[list[bytes], bytes]]], _: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        table, piece = pieces(path), {}
        ids: dict[bytes, bytes] = {}
        for ws, told in answers():
            n = int.from_bytes(told[:4], "little")
            ends = np.cumsum(unpack_array(told[4 : 4 + n], np.int32)) * 4
            flat = unpack_array(told[4 + n :], np.int32)
            raw, text = flat.tobytes(), [table[i] for i in flat.tolist()]
            a = 0
            for w, b in zip(ws, ends.tolist(), strict=True):
                ids[w] = raw[a:b]
                piece[w] = " ".join(text[a // 4 : b // 4])
                a = b
        for i in range(0, len(held), 500):
            some = held[i : i + 500]
            found, back = [], []
            for _, raw in some:
                words = raw.split()
                found.append(np.frombuffer(b"".join(map(ids.__getitem__, words)), np.int32))
                back.append(" ".join(filter(None, map(piece.__getitem__, words))))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), lists, pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return join_words(docs, key, text, number, answer, finish, ENCODED, None, block_bytes, part_bytes).withColumn("doc_id", id_out("doc_id"))
