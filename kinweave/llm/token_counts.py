"""Token counts by section: whole documents are encoded once, token spans are joined to the spans of sections, and a
token that crosses a boundary goes to one section by rule.

A document is its fields one after the other, each followed by a line feed; sections are the lines of the fields (a line
feed belongs to the line it ends). Spans are counted in characters; tokens are byte-level, and a token that ends inside a
character is told by its bytes. Every token goes to exactly one section, so that counts add up to those of the document.

One pass, no shuffle; a document's spans are sorted, so the interval join is a binary search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import map_batches
from kinweave.llm.tokens import TOKENIZER, Tokenizer, tokenizer
from kinweave.llm.words import texts_of

#: Where a token goes that crosses boundaries: to the section that holds most of its bytes (of equal ones the first), to
#: the one in which it begins, or to the one in which it ends.
RULES = ("most", "first", "last")
#: Sections handed on together.
_ROWS = 20_000


def assign(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of its section, and whether it crosses a boundary. Both kinds of spans follow each
    other without gaps from 0 to the same end; sections may be empty, and then get no token."""
    starts = np.concatenate([[0], token_ends[:-1]])
    begin = np.searchsorted(section_ends, starts, "right")
    end = np.searchsorted(section_ends, token_ends, "left")
    crosses = end > begin
    if rule == "first":
        return begin, crosses
    if rule == "last":
        return end, crosses
    out = begin.copy()
    for t in np.flatnonzero(crosses):
        edges = section_ends[begin[t] : end[t] + 1]
        held = np.diff(np.concatenate([[starts[t]], np.minimum(edges, token_ends[t])]))
        out[t] = begin[t] + int(np.argmax(held))
    return out, crosses


_SECTIONS = T.StructType(
    [
        T.StructField("section", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
    ]
)


def section_tokens(
    docs: DataFrame, fields: Sequence[str] = ("text",), *, doc_id: str = "doc_id", path: str = TOKENIZER, rule: str = "most"
) -> DataFrame:
    """``doc_id, section, field, start, end, n_tokens, n_crossing``, a row per section of every row of ``docs``.

    ``section`` counts from 0 through the document; ``start`` and ``end`` are characters of the field's text;
    ``n_crossing`` are those of the section's tokens that also lie in another. A null field is like an empty one: a
    section of length 0, whose closing line feed, if more fields follow, may be its only token. The last field has no
    line feed after it; if it is empty, and others are not, it has no section. Repeated rows are counted each.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    names = list(fields)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(names)))

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        encoder, parts, size = tokenizer(path), [], 0
        raws = [texts_of(batch.column(i + 1)) for i in range(len(names))]
        for row in range(batch.num_rows):
            own = _count([t.data[t.offsets[row] : t.offsets[row + 1]] for t in raws], encoder, rule)
            parts.append((np.full(len(own[0]), row), *own))
            size += len(own[0])
            if size >= _ROWS or row + 1 == batch.num_rows:
                at, section, field, *numbers = map(np.concatenate, zip(*parts, strict=True))
                yield [batch.column(0).take(pa.array(at)), section, pa.array(names).take(pa.array(field)), *numbers]
                parts, size = [], 0

    return map_batches(rows, of_batch, T.StructType([rows.schema["doc_id"], *_SECTIONS.fields]))


def _count(raws: list[np.ndarray], encoder: Tokenizer, rule: str) -> tuple[np.ndarray, ...]:
    """Numbers, fields, starts, ends, tokens and crossing tokens of the sections of a document, from its fields' bytes."""
    whole = np.concatenate([p for raw in raws for p in (raw, np.frombuffer(b"\n", np.uint8))][:-1])
    points = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])
    field_end = np.cumsum([len(raw) + 1 for raw in raws])
    field_end[-1] -= 1
    # A last line that is empty is a section only if nothing else is.
    cuts = np.union1d(np.flatnonzero(whole == 0x0A) + 1, len(whole))
    field = np.searchsorted(field_end, cuts, "left")
    counts = crossing = np.zeros(len(cuts), np.int64)
    if len(whole):
        section, crosses = assign(encoder.ends(whole.tobytes().decode()), cuts, rule)
        counts = np.bincount(section, minlength=len(cuts))
        crossing = np.bincount(section[crosses], minlength=len(cuts))
    base = points[np.concatenate([[0], field_end[:-1]])][field]
    start = points[np.concatenate([[0], cuts[:-1]])] - base
    # The line feed between two fields is no character of either.
    end = points[cuts] - base - ((cuts == field_end[field]) & (field < len(raws) - 1))
    return np.arange(len(cuts)), field, start, end, counts, crossing
