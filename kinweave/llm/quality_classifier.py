"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad from its own and
its neighbours' features; the forward-backward marginals, weighted by the lines' lengths, make the document's score.

The model is learnt from a bounded sample of labelled documents. Scoring is one pass over whole texts, no shuffle; it
sees nothing of a row but its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import added, map_batches
from kinweave.llm.line_crf import Crf, document_score, fit, marginals
from kinweave.llm.lines import find_lines, with_neighbours
from kinweave.llm.words import chunks, texts_of

THRESHOLD = 0.3


def fit_quality(docs: DataFrame, labels: DataFrame, **more) -> Crf:
    """The classifier; rows whose crc32 of the id, as text, is divisible by 5 are held out (see ``line_crf.fit``)."""
    return fit(docs, labels, with_neighbours, **more)


def with_score(docs: DataFrame, crf: Crf, *, text: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` with the probability of label 1, and that column's name.

    A text without words (null, empty, white space) gets the share of label 1 among the rows learnt from. Equal texts
    get equal scores. Without labels of both kinds to learn from, all texts get that share (a half without any).
    """
    name, at = added(docs, "score"), docs.columns.index(text)

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        for first, part in chunks(texts_of(batch.column(at))):
            lines, _ = find_lines(part)
            good = marginals(crf, crf.emissions(with_neighbours(lines)), lines.first)
            yield [*(c.slice(first, len(part.offsets) - 1) for c in batch.columns), document_score(crf, good, lines)]

    return map_batches(docs, of_batch, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def scored(docs: DataFrame, crf: Crf, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null id is held out of nothing."""
    out, name = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), crf)
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        name,
        (F.col(name) >= threshold).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, crf: Crf, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their own columns."""
    out, name = with_score(docs, crf, text=text)
    return out.filter(F.col(name) >= threshold).select(*docs.columns)
