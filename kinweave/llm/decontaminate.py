"""Benchmark decontamination: an FM-index per training shard, searched for the words of the benchmark's phrases.

A shard is a run of words of one task's documents, ``SHARD_WORDS`` of them and as many more as a phrase may reach over; a
long document lies in several. Its words become numbers (those of no phrase share one number, and a run of them is kept as one, as nothing can be found across it), the numbers
an FM-index. Phrases are searched backwards through the ranks of a wavelet matrix, places are found by sampled suffix
positions, and the word spans of a document are merged. Nothing is shuffled, and a lost task is simply run again.

Phrases are a table below the shared folder, made, reduced to distinct ones and dealt into blocks of bounded size by
Spark; the driver learns which blocks there are. A task reads a block at a time and searches it in all texts of an Arrow
batch before the next, so more blocks mean more passes, none of them needs more memory. A document's words are lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import added, map_batches
from kinweave.llm.fm_index import FmIndex
from kinweave.llm.words import Texts, alnum_bytes, chunks, find_words, lowered, span_hashes, texts_of
from kinweave.sources.shared import scratch_path

#: Words of a phrase.
WINDOW = 10
#: Words of documents in one index.
SHARD_WORDS = 1 << 18
#: Phrases that a task holds at once.
BLOCK_PHRASES = 200_000
#: Phrases made at once, and tasks that write a block.
_MADE = 1 << 14
_WRITERS = 8


class Phrases(NamedTuple):
    """A block of phrases: rows of word numbers (from 2 on, right-aligned, 0 for none); the sorted word hashes the
    numbers stand for; and the items of phrase ``i``, ``item[first[i]:first[i + 1]]``, numbers into ``names``."""

    words: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    item: np.ndarray
    names: list[str | None]


_PHRASE = T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.BinaryType())])


def _phrases(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``item, words``: the word hashes of every window of the items' words, in runs of bounded size however long an item
    is; an item of fewer words, but not none, is one phrase."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        for at, part in chunks(texts_of(batch.column(1))):
            low = Texts(lowered(part.data), part.offsets)
            words = find_words(low, alnum_bytes())
            hashes = span_hashes(low.data, words.starts, words.ends)
            item, raw, sizes, made = [], [], [], 0
            for i, (first, end) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                n = min(window, end - first)
                for k in range(first, end - n + 1 if n else first, _MADE):
                    some = np.lib.stride_tricks.sliding_window_view(hashes[k : min(k + _MADE + n - 1, end)], n)
                    item.append(np.full(len(some), at + i))
                    raw.append(some.tobytes())
                    sizes.append(np.full(len(some), 8 * n))
                    made += len(some)
                    if made >= _MADE:
                        yield _columns(batch.column(0), item, raw, sizes)
                        item, raw, sizes, made = [], [], [], 0
            if made:
                yield _columns(batch.column(0), item, raw, sizes)

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, of_batch, _PHRASE)


def _columns(names: pa.Array, item: list[np.ndarray], raw: list[bytes], sizes: list[np.ndarray]) -> list[pa.Array]:
    ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(raw))])
    return [names.take(pa.array(np.concatenate(item))), words]


def _blocks(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> list[str]:
    """The folders of the benchmark's distinct phrases, about ``BLOCK_PHRASES`` at most in each; none without phrases.

    Pairs of phrase and item are dealt by a hash of both, so a phrase that many items have lies in several blocks.
    """
    spark = items.sparkSession
    # A word and the gap after it have two characters at least.
    most = items.agg(F.sum(F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).cast("long") / 2 + 1)).first()[0]
    n = max(1, -(-int(most or 0) // BLOCK_PHRASES))
    folder = scratch_path(spark, "phrases")
    block, writer = (F.pmod(F.xxhash64(*c), F.lit(k)).cast("int") for c, k in ((("words", "item"), n), (("item", "words"), _WRITERS)))
    dealt = _phrases(items, item_id, text, window).distinct().withColumns({"block": block, "writer": writer})
    dealt.repartition("block", "writer").drop("writer").write.partitionBy("block").parquet(folder)
    written = spark.read.schema(T.StructType([*_PHRASE.fields, T.StructField("block", T.IntegerType())])).parquet(folder)
    return [f"{folder}/block={r.block}" for r in written.select("block").distinct().orderBy("block").toLocalIterator()]


@lru_cache(maxsize=1)
def _block(folder: str, window: int) -> Phrases:
    """A written block; a task holds the last one it has read."""
    system, root = fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet"))
    parts = []
    for path in files:
        with system.open_input_file(path) as file:
            parts.append(pq.ParquetFile(file).read(["item", "words"]))
    table = pa.concat_tables(parts)
    words = table["words"].to_pylist()
    sizes = np.array([len(w) // 8 for w in words])
    vocabulary, numbers = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
    rows = np.zeros((len(sizes), window), np.int64)
    rows[np.arange(window) >= window - sizes[:, None]] = numbers + 2
    names = table["item"].to_pylist()
    number = {name: i for i, name in enumerate(dict.fromkeys(names))}
    unique, which = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), [number[name] for name in names]], 1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(unique) + 1))
    return Phrases(vocabulary, unique, first, pairs[:, 1], list(number))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    skipped = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - skipped, sizes)


class Hits(NamedTuple):
    """What is found in some texts: words, merged spans (their text, and four rows: first and last byte, first and
    last word; the end of the bytes is exclusive) and pairs of text and item."""

    n_words: np.ndarray
    span_text: np.ndarray
    spans: np.ndarray
    pair_text: np.ndarray
    pair_item: np.ndarray


def search_texts(texts: Texts, phrases: Phrases, shard_words: int = SHARD_WORDS) -> Hits:
    """Index the words of some texts, shard by shard, and search all phrases in them."""
    low = Texts(lowered(texts.data), texts.offsets)
    words = find_words(low, alnum_bytes())
    hashes = span_hashes(low.data, words.starts, words.ends)
    n, none = len(hashes), np.zeros(0, np.int64)
    if not n or not len(phrases.rows):
        return Hits(words.counts, none, np.zeros((4, 0), np.int64), none, none)
    at = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    numbers = np.where(phrases.words[at] == hashes, at + 2, 1)
    # A 1 stands for words of no phrase, and for the end of a text.
    numbers = np.insert(numbers, words.first[1:], 1)
    word = np.insert(np.arange(n), words.first[1:], -1)
    kept = np.ones(len(numbers), bool)
    kept[1:] = (numbers[1:] > 1) | (numbers[:-1] > 1)
    numbers, word = numbers[kept], word[kept]
    starts, phrase = [], []
    for at in range(0, len(numbers), shard_words):
        index = FmIndex(numbers[at : at + shard_words + phrases.rows.shape[1] - 1], int(len(phrases.words) + 1).bit_length())
        begin, end = index.search(phrases.rows)
        found = np.flatnonzero(end > begin)
        sizes = end[found] - begin[found]
        starts.append(word[at + index.locate(_ranges(begin[found], sizes))])
        phrase.append(np.repeat(found, sizes))
    starts, phrase = np.concatenate(starts), np.concatenate(phrase)
    length = (phrases.rows[phrase] > 0).sum(1)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    hit = np.cumsum(change)[:n] > 0
    text_of_word = words.texts
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    # A run that goes on into the next text is cut there.
    cuts = words.first[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[hit[cuts] & hit[cuts - 1]]
    firsts, lasts = np.sort(np.concatenate([firsts, cuts])), np.sort(np.concatenate([lasts, cuts - 1]))
    span_text = text_of_word[firsts]
    base = texts.offsets[span_text]
    how_many = phrases.first[phrase + 1] - phrases.first[phrase]
    items = phrases.item[_ranges(phrases.first[phrase], how_many)]
    pairs = np.unique(np.repeat(text_of_word[starts], how_many) * len(phrases.names) + items)
    before = words.first[span_text]
    spans = np.stack([words.starts[firsts] - base, words.ends[lasts] - base, firsts - before, lasts - before])
    return Hits(words.counts, span_text, spans, *np.divmod(pairs, len(phrases.names)))


_PARTS = ("start", "end", "first_word", "last_word")
_SPANS = T.ArrayType(T.StructType([T.StructField(p, T.IntegerType()) for p in _PARTS]))
_ITEMS = T.ArrayType(T.StringType())


def find_hits(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, str, str, str]:
    """All rows and columns of ``docs`` with three more, whose names are returned: the number of words, the merged
    spans that phrases cover (bytes of the text in UTF-8, the end exclusive; words, from 0), and the ids of the items
    that have one (as strings, distinct, sorted).

    A null text has no words; so has an empty one. Items without words have no phrase; an item with a null id has
    phrases, but no id to name. Repeated items, texts and rows are treated row by row. No items: no spans.
    """
    words, spans, found = added(docs, "n_words"), added(docs, "hit_spans"), added(docs, "hit_items")
    out = docs.withColumns(
        {words: F.lit(0).cast("long"), spans: F.array().cast(_SPANS), found: F.array().cast(_ITEMS)}
    )
    of_batch = _searcher(_blocks(items, item_id, item_text, window), docs.columns.index(text), len(docs.columns), window, shard_words)
    return map_batches(out, of_batch, out.schema), words, spans, found


def _searcher(blocks: Sequence[str], text_at: int, width: int, window: int, shard_words: int):
    none = np.zeros(0, np.int64)
    nothing = Phrases(np.zeros(0, np.uint64), np.zeros((0, window), np.int64), np.zeros(1, np.int64), none, [])

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        # A word and the gap after it have two bytes at least, more often about six.
        parts = list(chunks(texts_of(batch.column(text_at)), shard_words * 6))
        counts = np.zeros(batch.num_rows, np.int64)
        spans: dict[int, list[tuple]] = {}
        items: dict[int, set[str]] = {}
        for block in blocks or [None]:
            phrases = _block(block, window) if block else nothing
            for first, part in parts:
                hits = search_texts(part, phrases, shard_words)
                counts[first : first + len(hits.n_words)] = hits.n_words
                for i, span in zip((hits.span_text + first).tolist(), hits.spans.T.tolist(), strict=True):
                    spans.setdefault(i, []).append(tuple(span))
                for i, item in zip((hits.pair_text + first).tolist(), hits.pair_item.tolist(), strict=True):
                    if phrases.names[item] is not None:
                        items.setdefault(i, set()).add(phrases.names[item])
        for first, part in parts:
            n = len(part.offsets) - 1
            own = [c.slice(first, n) for c in batch.columns[:width]]
            merged = [[dict(zip(_PARTS, s, strict=True)) for s in _merged(spans.get(i, []))] for i in range(first, first + n)]
            yield [*own, counts[first : first + n], merged, [sorted(items.get(i, ())) for i in range(first, first + n)]]

    return of_batch


def _merged(spans: list[tuple]) -> list[tuple]:
    """Spans of a text that share a word, or lie word by word, as one."""
    out: list[tuple] = []
    for span in sorted(spans):
        if out and span[2] <= out[-1][3] + 1:
            out[-1] = (*out[-1][:1], max(span[1], out[-1][1]), out[-1][2], max(span[3], out[-1][3]))
        else:
            out.append(span)
    return out


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a phrase, ``n_items`` items with a phrase that occurs;
    ``items_sha256`` digests their ids, sorted as strings and joined by commas.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    hits, words, spans, found = find_hits(narrow, items, **more)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return hits.select(
        "doc_id",
        F.col(words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


def remove_hits(docs: DataFrame, items: DataFrame, *, text: str = "text", **more) -> DataFrame:
    """``docs`` with the spans that phrases cover cut out of the text; what stands around a span stays as it is."""
    hits, words, spans, found = find_hits(docs, items, text=text, **more)
    raw = F.encode(text, "UTF-8")
    nothing = F.struct(F.lit(b"").alias("done"), F.lit(0).alias("at"))

    def step(state, span):
        before = F.substring(raw, state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.concat(state["done"], before).alias("done"), span["end"].alias("at"))

    rest = lambda state: F.concat(state["done"], F.substring(raw, state["at"] + 1, F.octet_length(text)))
    cut = F.decode(F.aggregate(spans, nothing, step, rest), "UTF-8")
    whole = F.when(F.size(spans) > 0, cut).otherwise(F.col(text))
    return hits.withColumn(text, whole).drop(words, spans, found)
