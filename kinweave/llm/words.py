"""Words of whole Arrow batches as numpy arrays: where they lie, what they hash to, and windows of them.

Texts are looked at as UTF-8 bytes. Every byte of a character above U+007F is 0x80 or more, so both word patterns of
this package can be told byte by byte, and no text is turned into Python strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together, so that the arrays made from them stay small. A longer text is taken alone.
CHUNK_BYTES = 1 << 20
#: Bytes hashed together.
_REGION = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def alnum_bytes() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in text whose A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def visible_bytes() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[0x20] = table[0x09:0x0E] = False
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table[data]


class Texts(NamedTuple):
    """Bytes of some texts one after the other; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The bytes of an Arrow string column; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[ends[0] : ends[-1]], ends - ends[0])


def chunks(texts: Texts, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts in runs of about ``most`` bytes, each with the number of its first text."""
    ends, at, n = texts.offsets, 0, len(texts.offsets) - 1
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, Texts(texts.data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at])
        at = upto


class Words(NamedTuple):
    """Byte spans of words; those of text ``i`` are number ``first[i]`` to ``first[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(texts: Texts, table: np.ndarray) -> Words:
    """Runs of the bytes in ``table``; a run ends with its text."""
    inside = table[texts.data]
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[texts.offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[texts.offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """The values with every bit spread over all bits, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""

    def up(base: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans come in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(ends, low + _REGION, "right")))
        high = int(ends[upto - 1])
        if high - low > _REGION:  # one long span
            out[at] = int.from_bytes(hashlib.blake2b(data[low:high].tobytes(), digest_size=8).digest(), "little")
            at = upto
            continue
        up, down = _powers(_REGION)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_byte_values()[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = upto
    return mix(out)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive values (from one text to the next, too; see ``window_mask``)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += hashes[k : k + size] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
    return mix(out)


def window_mask(first: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` words, whether it lies in one text."""
    size = max(0, int(first[-1]) - n + 1)
    starts = np.ones(size, bool)
    for k in range(1, n):
        over = first[1:-1] - k
        starts[over[(over >= 0) & (over < size)]] = False
    return starts


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` words of each text, a shorter text (if it has a word) being one window; and, for
    each text, where its windows begin (one more entry than texts)."""
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    sizes = np.maximum(counts - n + 1, 0)
    sizes[short] = 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(bounds[-1], np.uint64)
    inside = np.ones(len(out), bool)
    inside[bounds[short]] = False
    out[inside] = windows(hashes, n)[window_mask(first, n)]
    for i in short:
        part = hashes[first[i] : first[i + 1]]
        factors = np.array([pow(_BASE, 2 * k + 1, 1 << 64) for k in range(len(part))], np.uint64)
        out[bounds[i]] = mix(np.array([(part * factors).sum(dtype=np.uint64) + np.uint64(len(part))], np.uint64))[0]
    return out, bounds
