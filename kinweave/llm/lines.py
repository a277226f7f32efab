"""Lines of whole texts as numpy arrays: spans, repeated lines and words, and the features a line labeller looks at.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Only lines with a word count; texts are split at line feeds alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from kinweave.llm.words import Texts, Words, find_words, mix, span_hashes, visible_bytes, window_mask, windows

SYMBOLS = b"#*$%&|<>"
_VISIBLE, _SYMBOL, _UPPER, _DIGIT, _LOUD, _BAR, _POINT, _WIDE = (1 << k for k in range(8))


def _flags() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[visible_bytes()] |= _VISIBLE
    table[np.frombuffer(SYMBOLS, np.uint8)] |= _SYMBOL
    table[0x41:0x5B] |= _UPPER
    table[0x30:0x3A] |= _DIGIT
    table[np.frombuffer(b"!?", np.uint8)] |= _LOUD
    table[np.frombuffer(b"|\t", np.uint8)] |= _BAR
    table[:0x80] |= _POINT  # where a code point begins
    table[0xC0:] |= _POINT | _WIDE
    return table


_FLAGS = _flags()

#: Names of the columns of ``Lines.features``, all from 0 to 1.
FEATURES = (
    "one", "few words", "many words", "word length", "symbols", "capitals", "digits", "loud", "bars", "repeated line",
    "repeated words", "ends a sentence", "wide characters",
)
#: Those that a line also sees of the lines before and after it.
SEEN = tuple(FEATURES.index(x) for x in ("symbols", "capitals", "loud", "bars", "repeated line", "repeated words"))


class Lines(NamedTuple):
    """Lines with a word, in order; those of text ``i`` are number ``first[i]`` to ``first[i + 1]``."""

    words: Words
    first: np.ndarray
    #: Code points of the words of each line.
    chars: np.ndarray
    #: Whether an equal line came before in the text.
    repeated: np.ndarray
    features: np.ndarray
    #: Code points of words, and symbols, of each text.
    word_chars: np.ndarray
    symbols: np.ndarray


def _equal_before(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values of texts: whether an equal one comes before in the text, and whether there is another at all."""
    key = key ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    before, any_other = np.empty(len(key), bool), np.empty(len(key), bool)
    before[order] = same[:-1]
    any_other[order] = same[:-1] | same[1:]
    return before, any_other


def repeat_words(words: Words, hashes: np.ndarray, n: int = 3) -> np.ndarray:
    """For each text, its words in windows of ``n`` words that are found twice or more in it."""
    at = np.flatnonzero(window_mask(words.first, n))
    text = words.texts
    _, again = _equal_before(text[at], windows(hashes, n)[at])
    marked = np.zeros(len(hashes), bool)
    for k in range(n):
        marked[at[again] + k] = True
    return np.bincount(text[marked], minlength=len(words.first) - 1)


def find_lines(texts: Texts) -> tuple[Lines, np.ndarray]:
    """The lines of some texts, and the hashes of their words."""
    data, n = texts.data, len(texts.offsets) - 1
    words = find_words(texts, visible_bytes())
    hashes = span_hashes(data, words.starts, words.ends)
    feeds = np.flatnonzero(data == 0x0A)
    # Edges are the line feeds and the ends of texts; a line lies between two of them, the feed left out.
    edges = np.union1d(feeds, texts.offsets)
    line_of_word = np.searchsorted(edges, words.starts, "right") - 1
    used, first_word = np.unique(line_of_word, return_index=True)
    bounds = np.append(first_word, len(words.starts))
    begin = edges[used] + (data[edges[used]] == 0x0A if len(used) else 0)
    end = edges[used + 1] if len(used) else edges[:0]
    text = words.texts[first_word]
    first = np.searchsorted(text, np.arange(n + 1))
    repeated, twin = _equal_before(text, span_hashes(data, begin, end))

    flags = _FLAGS[data]

    def count(mask: int, every: int = 0) -> np.ndarray:
        """Bytes up to each place that have the flag, or all of some."""
        sums = np.zeros(len(data) + 1, np.int32)  # a batch of Arrow strings is shorter than that
        np.cumsum((flags & every) == every if every else (flags & mask) != 0, out=sums[1:])
        return sums

    def per_line(sums: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]).astype(np.int64)

    points = count(0, _VISIBLE | _POINT)
    symbols = count(_SYMBOL)
    chars = per_line(points)
    n_words = np.diff(bounds)
    again, _ = _equal_before(np.repeat(np.arange(len(used)), n_words), hashes)
    in_line = np.concatenate([[0], np.cumsum(again)])
    features = np.empty((len(used), len(FEATURES)), np.float32)
    share = lambda part, whole: np.minimum(part / np.maximum(whole, 1), 1)
    last = data[words.ends[bounds[1:] - 1] - 1] if len(used) else data[:0]
    for k, values in enumerate(
        (
            1.0, n_words < 4, np.minimum(n_words / 40, 1), share(chars / 12, n_words), share(per_line(symbols) / 2, n_words),
            share(per_line(count(_UPPER)), chars), share(per_line(count(_DIGIT)), chars), share(per_line(count(_LOUD)), n_words),
            share(per_line(count(_BAR)), n_words), twin, (in_line[bounds[1:]] - in_line[bounds[:-1]]) / np.maximum(n_words, 1),
            np.isin(last, np.frombuffer(b".!?:;", np.uint8)), share(per_line(count(_WIDE)), chars),
        )
    ):
        features[:, k] = values
    of_text = lambda sums: (sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]).astype(np.int64)
    return Lines(words, first, chars, repeated, features, of_text(points), of_text(symbols)), hashes


def with_neighbours(lines: Lines) -> np.ndarray:
    """The features, and those ``SEEN`` of the lines before and after in the text (0 at its ends)."""
    own, seen = lines.features, lines.features[:, SEEN]
    before, after = np.zeros_like(seen), np.zeros_like(seen)
    before[1:], after[:-1] = seen[:-1], seen[1:]
    firsts = lines.first[:-1][np.diff(lines.first) > 0]
    lasts = lines.first[1:][np.diff(lines.first) > 0] - 1
    before[firsts] = 0
    after[lasts] = 0
    return np.hstack([own, before, after])
