"""Byte-level BPE from a tokenizer file, with the place of each token in the text."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: The pattern that splits text before merging, a fixed value of this family of tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longer texts go through the tokenizers library, whose splitter has no limit on runs of white space.
LONG = 200_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes: Latin-1 letters and signs stand for themselves, others follow from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Gives the ids that the tokenizers library gives for the file, several times as fast, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        to_byte = _byte_of()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.n_bytes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for piece, i in ranks.items():
            self.n_bytes[i] = len(piece)
        for piece, i in self.special.items():
            self.n_bytes[i] = len(piece.encode())

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        for piece, i in self.special.items():
            if piece in text:
                return np.concatenate([x for j, part in enumerate(text.split(piece)) for x in (np.array([i] * (j > 0), "<u4"), self.ids(part))])
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path)
