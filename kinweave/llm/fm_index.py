"""FM-index over a sequence of small integers, with numpy: suffix sort, Burrows-Wheeler transform, wavelet matrix,
backward search and location by sampled suffix positions. All queries work on arrays of patterns or rows at once."""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of ``x`` (values below ``2 ** bits``, the last the only 0) in order, by prefix doubling.

    Only suffixes that are still tied are sorted again, so repeated passages cost a few short rounds.
    """
    n = len(x)
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        if k < n:
            key[: n - k] |= x[k:]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = np.diff(key[order]) != 0
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        some = order[tied]
        follow = some + width
        second = np.zeros(len(some), np.int64)
        inside = follow < n
        second[inside] = rank[follow[inside]] + 1
        group = rank[some]
        key = group * (n + 1) + second
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[tied] = some
        new = np.ones(len(tied), bool)
        new[1:] = np.diff(key) != 0
        heads = np.flatnonzero(new)
        rank[some] = np.repeat(tied[heads], np.diff(np.append(heads, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of values below ``2 ** bits``."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(bits)):
            bit = ((x >> level) & 1).astype(bool)
            below = np.zeros(len(x) + 1, np.int32)
            np.cumsum(~bit, out=below[1:])
            self.zeros.append(below)
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each value stands before each position."""
        low, high = np.zeros(len(value), np.int64), upto.astype(np.int64)
        for level, below in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = ((value >> level) & 1).astype(bool)
            a, b = below[low], below[high]
            low = np.where(one, below[-1] + low - a, a)
            high = np.where(one, below[-1] + high - b, b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some positions."""
        at, value = at.astype(np.int64), np.zeros(len(at), np.int64)
        for below in self.zeros:
            zero = below[at + 1] > below[at]
            at = np.where(zero, below[at], below[-1] + at - below[at])
            value = (value << 1) | ~zero
        return value


class FmIndex:
    """Index of ``x``, whose values lie from 1 to ``2 ** bits - 1``."""

    def __init__(self, x: np.ndarray, bits: int, sample: int = 16):
        x = np.append(x, 0).astype(np.int64)
        order = suffix_array(x, bits)
        self.size = len(x)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=1 << bits))])
        self.bwt = WaveletMatrix(x[order - 1], bits)
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        self.position = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns`` (filled up with zeros on the left), the range of its suffixes."""
        n = len(patterns)
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        alive = np.arange(n)
        for column in patterns.T[::-1]:
            value = column[alive]
            going = value > 0
            rows, value = alive[going], value[going]
            low[rows] = self.less[value] + self.bwt.rank(value, low[rows])
            high[rows] = self.less[value] + self.bwt.rank(value, high[rows])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in ``x`` of the suffixes at some rows: step back until a sampled suffix is met."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            found = self.kept[rows + 1] > self.kept[rows]
            out[left[found]] = self.position[self.kept[rows[found]]] + steps
            left, rows = left[~found], rows[~found]
            value = self.bwt.access(rows)
            rows = self.less[value] + self.bwt.rank(value, rows)
            steps += 1
        return out
