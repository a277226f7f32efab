"""Quality rules with line labelling: counts of words, symbols and repeats, and a linear-chain conditional random field
whose Viterbi labels tell content from boilerplate line by line; the share of content decides.

Everything is worked out where a text lies: one pass, no shuffle, whole texts, rows independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import added, map_batches
from kinweave.llm.line_crf import Crf, fit, viterbi
from kinweave.llm.lines import Lines, find_lines, repeat_words
from kinweave.llm.words import chunks, texts_of

MIN_WORDS = 50
MIN_CONTENT = 0.5

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def own_features(lines: Lines) -> np.ndarray:
    return lines.features


def fit_lines(docs: DataFrame, labels: DataFrame, **more) -> Crf:
    """The line labeller, from documents labelled good (1) or bad (0); see ``line_crf.fit`` for the sample's bounds."""
    return fit(docs, labels, own_features, **more)


def quality(
    docs: DataFrame, crf: Crf, *, text: str = "text", min_words: int = MIN_WORDS, min_content: float = MIN_CONTENT,
) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with the counts, ``content_share``, ``base_failed`` and ``kept``; also returned
    is what the new columns are called (a name that is taken gets an underscore).

    ``base_failed``: fewer than ``min_words`` words, or more than half of them in 3-word windows found twice or more.
    ``content_share`` is the share of characters in lines labelled content; a text without words (null, empty, white
    space) has none, so it fails. Repeated rows are judged alike.
    """
    names = {c: added(docs, c) for c in (*_COUNTS, "content_share")}
    at = docs.columns.index(text)

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        for first, part in chunks(texts_of(batch.column(at))):
            lines, hashes = find_lines(part)
            n = len(part.offsets) - 1
            label = viterbi(crf, crf.emissions(own_features(lines)), lines.first)
            of = np.repeat(np.arange(n), np.diff(lines.first))
            whole = np.bincount(of, lines.chars, n)
            share = np.bincount(of[label], lines.chars[label], n) / np.maximum(whole, 1)
            repeated = np.bincount(of[lines.repeated], minlength=n)
            yield [
                *(c.slice(first, n) for c in batch.columns),
                lines.words.counts, lines.word_chars, lines.symbols, repeated, repeat_words(lines.words, hashes), share,
            ]

    kinds = [T.StructField(names[c], T.LongType()) for c in _COUNTS] + [T.StructField(names["content_share"], T.DoubleType())]
    out = map_batches(docs, of_batch, T.StructType([*docs.schema.fields, *kinds]))
    names |= {c: added(docs, c) for c in ("base_failed", "kept")}
    words, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    out = out.withColumn(names["base_failed"], (words < min_words) | (100 * repeats > 50 * words))
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["content_share"]) >= min_content)), names


def judged(docs: DataFrame, crf: Crf, *, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept`` and ``content_share`` of every row."""
    out, _ = quality(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), crf, **more)
    return out.drop("text")


def keep(docs: DataFrame, crf: Crf, *, text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    out, names = quality(docs, crf, text=text, **more)
    return out.filter(F.col(names["kept"])).select(*docs.columns)
