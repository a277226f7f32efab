"""Byte-level BPE tokenizers by path, and where their tokens lie in a text."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import tiktoken

#: A vocabulary as ranks (a token in base64 and its rank per line), the same place on every machine. Never copied.
TOKENIZER = os.environ.get("KINWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how this kind of vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self._sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """Where each token of the text ends, in bytes of UTF-8; a token begins where the one before ends."""
        return np.cumsum(self._sizes[self._encoding.encode_to_numpy(text)])

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


@cache
def tokenizer(path: str = TOKENIZER) -> Tokenizer:
    """One per process."""
    return Tokenizer(path)
