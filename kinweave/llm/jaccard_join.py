"""Near-duplicate documents: an LSH forest of MinHash finds candidates, exact Jaccard similarity of word shingles decides.

1. Each text becomes a set of hashed shingles (five lower-cased words). Documents with equal sets are one *class*; from
   here on there is one line per class, whatever the number of copies.
2. An LSH forest: ``TREES`` trees of ``DEPTH`` min-hashes (symbols of 16 bits) per class. The paths of all trees are
   sorted by range, so that the classes below a node, whatever its depth, are a run of neighbours.
3. Matched prefixes are shortened from ``DEPTH`` until two recalls reach the target: the computed one of a pair right
   at the threshold, and the measured one of a sample. ``SAMPLE_CLASSES`` classes are compared exactly with all texts, and
   the longest prefixes that the pairs found share are counted. The sample settles the length alone.
4. Inside the runs of that length whole signatures are compared. Pairs that agree in fewer symbols than a pair at the
   threshold ever does (five standard deviations) are no candidates, so dissimilar texts do not hang together by
   chains of runs. Runs with the same members, in whatever trees, are looked at once; a run too large for a task is cut into
   blocks. Connected components of the candidates (a line per class and run) put what may be linked in one place.
5. All sets of a component are compared exactly, by counting common shingles. A component too large for a task is cut
   into blocks by hash, and each two blocks meet in one task. A task returns one line per class: how many documents it
   is linked to, and the smallest class it hangs together with. No pair is ever written, nothing is capped.

A text with fewer than five words, but not none, is one shingle; one without words (null, empty, punctuation) is like
nothing, not even another such text. Repeated rows are copies. Ids may be null or repeated: rows are told apart by their
shingles. A class is named by the smallest id in it (null if all are null).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import added, map_batches
from kinweave.llm.words import Texts, alnum_bytes, chunks, find_words, lowered, mix, shingles, span_hashes, texts_of
from kinweave.operators.components import components_of_numbers
from kinweave.sources.shared import SharedTable, materialise

WORDS = 5
SIMILARITY = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9999
#: Classes, and shingles, that a block holds about; two blocks are compared in one task.
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 1 << 20
#: Classes that are compared with all texts to measure the recall, and shingles that each of them has at most.
SAMPLE_CLASSES = 256
SAMPLE_SHINGLES = 1024
#: Bits of a map of keys: 8 MB, whatever the number of keys.
KEY_BITS = 1 << 26
_SEED = 20240229
#: Common shingles counted at once.
_STEP = 1 << 20


def prefix_length(
    similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, matched: Sequence[int] = (),
) -> int:
    """The longest prefix with which a pair as similar as the threshold shares a tree node with probability ``recall``,
    and with which that share of measured pairs do; 1 if even that falls short. ``matched[k]`` counts measured pairs
    whose longest common prefix has ``k`` symbols."""
    length = depth
    while length > 1 and (1 - (1 - similarity**length) ** trees < recall or sum(matched[length:]) < recall * sum(matched)):
        length -= 1
    return length


def least_agreement(similarity: float, symbols: int) -> int:
    """Of ``symbols`` equal places, the fewest that let a pair pass as a candidate."""
    return max(1, math.floor(symbols * similarity - 5 * math.sqrt(symbols * similarity * (1 - similarity))))


def _sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and where they begin."""
    low = Texts(lowered(texts.data), texts.offsets)
    words = find_words(low, alnum_bytes())
    values, bounds = shingles(span_hashes(low.data, words.starts, words.ends), words.first, n)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(bounds)))


def _signatures(values: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text that has shingles, ``trees * depth`` min-hashes of 16 bits; a tree's path are ``depth`` in a row."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(1, 1 << 31, trees * depth, np.uint32) * np.uint32(2) + np.uint32(1)
    starts = first[np.flatnonzero(np.diff(first))]
    out = np.empty((len(starts), trees * depth), np.uint16)
    if not len(starts):
        return out
    short = (values >> np.uint64(32)).astype(np.uint32)
    held, high = np.empty_like(short), np.empty_like(short)
    for k, factor in enumerate(factors):
        np.multiply(short, factor, out=held)
        np.right_shift(held, np.uint32(15), out=high)
        held ^= high
        held *= np.uint32(0x2C1B3C6D)
        out[:, k] = (np.minimum.reduceat(held, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _symbols(column: pa.Array) -> np.ndarray:
    """The symbols of signatures or paths, a row each."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros((len(column), 0), np.uint16)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(len(column), -1)


def _digests(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    raw = values.tobytes()
    return [
        hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    ]


def _signed(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """``doc_id, row_key, digest, node, size, signature`` of each row of ``docs`` (columns ``doc_id, text, row_key``)."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        for begin, part in chunks(texts_of(batch.column(1))):
            values, first = _sets(part, words)
            n, sizes = len(first) - 1, np.diff(first)
            ends = np.zeros(n + 1, np.int32)
            ends[1:] = np.cumsum(np.where(sizes > 0, 2 * trees * depth, 0))
            raw = pa.py_buffer(_signatures(values, first, trees, depth).tobytes())
            signatures = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), raw])
            digests = _digests(values, first)
            node = [_node(d) if d else None for d in digests]
            yield [*(batch.column(k).slice(begin, n) for k in (0, 2)), digests, node, sizes, signatures]

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            docs.schema["row_key"],
            T.StructField("digest", T.BinaryType()),
            T.StructField("node", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("signature", T.BinaryType()),
        ]
    )
    return map_batches(docs, of_batch, schema)


class _Sample(NamedTuple):
    """Sets of sampled classes: their distinct shingles in order, which classes have each (``who[starts[i] : starts[i + 1]]``),
    sizes and signatures of the classes."""

    shingles: np.ndarray
    starts: np.ndarray
    who: np.ndarray
    sizes: np.ndarray
    signatures: np.ndarray

    def near(self, values: np.ndarray, first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Texts and classes, by number, that are similar but not equal."""
        seen = np.zeros(1 << 20, bool)
        seen[self.shingles >> np.uint64(44)] = True
        at = np.flatnonzero(seen[values >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.shingles, values[at]), len(self.shingles) - 1)
        hit = self.shingles[place] == values[at]
        at, place = at[hit], place[hit]
        texts, row = np.unique(np.searchsorted(first, at, "right") - 1, return_inverse=True)
        common = np.zeros((len(texts), len(self.sizes)), np.int32)
        often = np.diff(self.starts)[place]
        run = np.cumsum(often) // _STEP
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(run)) + 1) if len(at) else ():
            size = often[some]
            skipped = np.cumsum(size) - size
            mine = self.who[np.arange(size.sum()) + np.repeat(self.starts[place[some]] - skipped, size)]
            pair, times = np.unique(np.repeat(row[some], size) * len(self.sizes) + mine, return_counts=True)
            common.ravel()[pair] += times.astype(np.int32)
        own = np.diff(first)[texts][:, None]
        all_in = own + self.sizes[None, :] - common
        text, other = np.nonzero((common >= similarity * all_in - 1e-6) & (common < all_in))
        return texts[text], other


def _sample(keyed: DataFrame, reps: DataFrame, words: int, trees: int, depth: int) -> _Sample | None:
    """The classes with the smallest hashes, at most ``SAMPLE_CLASSES`` of at most ``SAMPLE_SHINGLES`` shingles."""
    some = reps.filter(F.col("size") <= SAMPLE_SHINGLES).orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE_CLASSES)
    keys = [r[0] for r in some.select("lead.row_key").collect()]
    if not keys:
        return None

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        for _, part in chunks(texts_of(batch.column(0))):
            values, first = _sets(part, words)
            yield [[values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]]

    texts = keyed.filter(F.col("row_key").isin(keys)).groupBy("row_key").agg(F.first("text").alias("text")).select("text")
    found = map_batches(texts, of_batch, T.StructType([T.StructField("shingles", T.BinaryType())])).collect()
    sets = [np.frombuffer(r[0], np.uint64) for r in found]
    sizes = np.array([len(x) for x in sets], np.int64)
    values, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    shingles, starts = np.unique(values[order], return_index=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return _Sample(shingles, np.append(starts, len(values)), who[order], sizes, _signatures(values, first, trees, depth))


def measured_prefixes(keyed: DataFrame, reps: DataFrame, words: int, similarity: float, trees: int, depth: int) -> list[int]:
    """How many pairs of a sampled class and a similar, not equal text have a longest common prefix of 0, 1, ... symbols.
    One pass over all texts; a task returns counts."""
    sample = _sample(keyed, reps, words, trees, depth)
    if sample is None:
        return []

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        counts = np.zeros(depth + 1, np.int64)
        for _, part in chunks(texts_of(batch.column(0))):
            values, first = _sets(part, words)
            texts, other = sample.near(values, first, similarity)
            rows, row = np.unique(texts, return_inverse=True)
            kept = np.zeros(len(first) - 1, bool)
            kept[rows] = True
            sizes = np.diff(first)
            own = _signatures(values[np.repeat(kept, sizes)], np.concatenate([[0], np.cumsum(sizes[kept])]), trees, depth)
            for k in range(0, len(row), 4096):
                same = (own[row[k : k + 4096]] == sample.signatures[other[k : k + 4096]]).reshape(-1, trees, depth)
                counts += np.bincount(np.logical_and.accumulate(same, 2).sum(2).max(1), minlength=depth + 1)
        some = np.flatnonzero(counts)
        yield [some, counts[some]]

    schema = T.StructType([T.StructField("matched", T.LongType()), T.StructField("pairs", T.LongType())])
    lines = map_batches(keyed.select("text"), of_batch, schema).groupBy("matched").agg(F.sum("pairs").alias("pairs")).collect()
    by_length = {r.matched: r.pairs for r in lines}
    return [by_length.get(k, 0) for k in range(depth + 1)]


def _runs(trie: DataFrame, length: int) -> DataFrame:
    """``run, node``: who is below each node of depth ``length``, from lines ``tree, path, node``. Paths are sorted by range, so
    a run is seen where it lies; classes that are alone in theirs are left out, unless at the edge of a batch."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        if not batch.num_rows:
            return
        run = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)
        symbols = _symbols(batch.column(1)).astype(np.uint64)
        for k in range(length):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + symbols[:, k])
        same = run[1:] == run[:-1]
        kept = (run == run[0]) | (run == run[-1])
        kept[1:] |= same
        kept[:-1] |= same
        yield [run[kept].view(np.int64), batch.column(2).filter(pa.array(kept))]

    placed = trie.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("node", T.LongType())])
    return map_batches(placed, of_batch, schema)


def _alike_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """``id_a, id_b`` of the pairs (with ``sign_a, sign_b``) that agree in ``least`` symbols."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        alike = pa.array((_symbols(batch.column(2)) == _symbols(batch.column(3))).sum(1) >= least)
        yield [batch.column(k).filter(alike) for k in (0, 1)]

    return map_batches(pairs, of_batch, T.StructType([T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType())]))


def _alike_in_runs(members: DataFrame, least: int) -> DataFrame:
    """Lines ``id_a, id_b``: a member and the smallest it hangs together with, by pairs of two blocks ``a`` and ``b`` of a run that
    agree in ``least`` symbols (``run, a, b, block, node, signature``)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        nodes, block = (table.column(c).to_numpy() for c in ("node", "block"))
        symbols = _symbols(table.column("signature").cast(pa.large_binary()).combine_chunks())
        rows, others = np.flatnonzero(block == table.column("a")[0].as_py()), np.flatnonzero(block == table.column("b")[0].as_py())
        agree = np.zeros((len(rows), len(others)), np.uint16)
        for k in range(symbols.shape[1]):
            agree += symbols[rows, k][:, None] == symbols[others, k][None, :]
        near = np.zeros((len(rows), len(nodes)), bool)
        near[:, others] = agree >= least
        root = _roots(near, rows)
        moved = root != np.arange(len(nodes))
        return pa.table({"id_a": nodes[moved], "id_b": nodes[root[moved]]})

    return members.groupBy("run", "a", "b").applyInArrow(compare, "id_a long, id_b long")


def _candidates(reps: DataFrame, length: int, similarity: float, trees: int, depth: int) -> SharedTable:
    """``node, component`` of every class that has a candidate."""
    width = 2 * depth
    trie = reps.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    trie = trie.select("tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("path"), "node")
    members = materialise(_runs(trie, length), "members")
    runs = members.df.groupBy("run").agg(
        F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("mark")
    )
    runs = runs.filter("least < most").groupBy("n", "least", "most", "mark").agg(F.min("run").alias("run"))
    runs = materialise(runs, "runs")
    small, large = runs.df.filter("n = 2").select("least", "most"), runs.df.filter("n > 2").select("run", "n")
    inside = materialise(members.df.join(large, "run"), "inside")
    wanted = inside.df.select("node").unionByName(small.select(F.col("least").alias("node"))).unionByName(small.select(F.col("most").alias("node")))
    few, held = _narrowed(reps.select("node", "signature"), wanted, "node")
    signs = materialise(few, "signatures")
    held.drop()
    pairs = small.select(F.col("least").alias("id_a"), F.col("most").alias("id_b"))
    for end in ("a", "b"):
        pairs = pairs.join(signs.df.select(F.col("node").alias(f"id_{end}"), F.col("signature").alias(f"sign_{end}")), f"id_{end}")
    parts = F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")
    placed = inside.df.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("run", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node")
    least = least_agreement(similarity, trees * depth)
    alike = _alike_pairs(pairs.select("id_a", "id_b", "sign_a", "sign_b"), least)
    ties = materialise(alike.unionByName(_alike_in_runs(placed.join(signs.df, "node"), least)), "ties")
    out = components_of_numbers(ties.df)
    for table in (members, runs, inside, signs, ties):
        table.drop()
    return out


def _common(values: np.ndarray, member: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Common shingles of the members ``rows`` with each of ``n`` members. values, member: shingles and who has them.

    Shingles that many members have are counted by matrix products, the others along their lists of members.
    """
    order = np.argsort(values, kind="stable")
    member = member[order]
    new = np.ones(len(values), bool)
    new[1:] = np.diff(values[order]) != 0
    heads = np.flatnonzero(new)
    often = np.diff(np.append(heads, len(values)))
    shingle = np.repeat(np.arange(len(heads)), often)
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    out = np.zeros((len(rows), n), np.float32)
    frequent = np.flatnonzero(often >= max(4, n // 8))
    for at in range(0, len(frequent), 2048):
        some = frequent[at : at + 2048]
        column = np.full(len(heads), -1)
        column[some] = np.arange(len(some))
        has = column[shingle] >= 0
        table = np.zeros((n, len(some)), np.float32)
        table[member[has], column[shingle[has]]] = 1
        out += table[rows] @ table.T
    rare = np.flatnonzero((often[shingle] < max(4, n // 8)) & (often[shingle] > 1) & (place[member] >= 0))
    sizes = often[shingle[rare]]
    flat, run = out.ravel(), np.cumsum(sizes) // _STEP
    for some in np.split(np.arange(len(rare)), np.flatnonzero(np.diff(run)) + 1) if len(rare) else ():
        one, size = rare[some], sizes[some]
        skipped = np.cumsum(size) - size
        other = member[np.arange(size.sum()) + np.repeat(heads[shingle[one]] - skipped, size)]
        where, times = np.unique(np.repeat(place[member[one]], size) * n + other, return_counts=True)
        flat[where] += times
    return out


def _compare(sets: list[np.ndarray], copies: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For members of two blocks (or of one, ``left`` and ``right`` both true): the documents of other classes each is
    linked to by a link between the blocks, and the first member it hangs together with."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.flatnonzero(left)
    common = _common(np.concatenate(sets), np.repeat(np.arange(n), sizes), rows, n)
    near = common >= similarity * (sizes[rows][:, None] + sizes[None, :] - common) - 1e-6
    near &= right[None, :] & (rows[:, None] != np.arange(n)[None, :])
    links = np.zeros(n, np.int64)
    links[rows] += near @ copies
    if not (left & right).any():  # between two blocks a link is seen from one side only
        links += near.T.astype(np.int64) @ copies[rows]
    return links, _roots(near, rows)


def _roots(near: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first member that each hangs together with; ``near[i]`` tells which are near to ``rows[i]``."""
    n = near.shape[1]
    root = np.arange(n)
    while True:  # smallest label of the neighbours, until nothing changes
        seen = np.where(near, root[None, :], n).min(1, initial=n)
        new = root.copy()
        new[rows] = np.minimum(root[rows], seen)
        back = np.where(near, new[rows][:, None], n).min(0, initial=n)
        new = np.minimum(new, back)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Lines ``digest, node, parts, links, root`` of classes, from their texts (``component, parts, a, b, block, digest,
    copies, text``; a and b are the blocks that meet)."""

    def compare(table: pa.Table) -> pa.Table:
        rows = table.select(["digest", "parts", "block", "copies"]).to_pylist()
        texts, sets = table.column("text").cast(pa.large_string()).combine_chunks(), []
        for _, part in chunks(texts_of(texts)):
            values, first = _sets(part, words)
            sets += [values[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        nodes = [_node(r["digest"]) for r in rows]
        order = sorted(range(len(rows)), key=nodes.__getitem__)
        rows, sets, nodes = ([x[i] for i in order] for x in (rows, sets, nodes))
        block, copies = (np.array([r[c] for r in rows], np.int64) for c in ("block", "copies"))
        a, b = (table.column(c)[0].as_py() for c in ("a", "b"))
        links, root = _compare(sets, copies, block == a, block == b, similarity)
        parts = [r["parts"] for r in rows]
        out = {"digest": [r["digest"] for r in rows], "node": nodes, "parts": parts, "links": links, "root": [nodes[r] for r in root]}
        return pa.table({c: pa.array(v, pa.binary() if c == "digest" else pa.int64()) for c, v in out.items()})

    return members.groupBy("component", "a", "b").applyInArrow(compare, "digest binary, node long, parts long, links long, root long")


def _node(digest: bytes) -> int:
    """The digest's first half as a number, for joins and components; sets are told apart by whole digests."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _row_key(doc_id: str, text: str):
    """Tells rows apart by id and text."""
    return F.md5(F.concat_ws("\0", F.coalesce(F.col(doc_id).cast("string"), F.lit("\1")), F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _key_map(keys: DataFrame, key: str) -> SharedTable:
    """A bit per hashed key, ``key_bucket, key_bits``. Keys are dealt by bucket first, so no task holds more than its buckets."""
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1
    placed = keys.select(F.bitmap_bucket_number(place).alias("key_bucket"), F.bitmap_bit_position(place).alias("bit"))
    bits = placed.repartition("key_bucket").groupBy("key_bucket").agg(F.bitmap_construct_agg("bit").alias("key_bits"))
    return materialise(bits, "key_map")


def _marked(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` and a column ``name``: false where the key is not in the map; true where it is, or rarely by chance. Spares the
    shuffle of rows that a join would not meet."""
    bucket, bits = added(df, "key_bucket"), added(df, "key_bits")
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1
    position = F.bitmap_bit_position(place)
    # The map has KEY_BITS bits at most.
    joined = df.join(
        F.broadcast(keys.select(F.col("key_bucket").alias(bucket), F.col("key_bits").alias(bits))),
        F.bitmap_bucket_number(place) == F.col(bucket), "left",
    )
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1, F.lit(False))
    return joined.withColumn(name, found).select(*df.columns, name)


def _narrowed(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, SharedTable]:
    """The lines of ``df`` whose key is in ``keys``, and the map of keys, to be dropped after use."""
    held = _key_map(keys, key)
    mark = added(df, "marked")
    return _marked(df, key, held.df, mark).filter(mark).drop(mark).join(keys.select(key).distinct(), key, "left_semi"), held


class Classes(NamedTuple):
    """``rows``: a line per document, ``doc_id, row_key, digest``. ``classes``: a line per digest, ``digest, copies, links,
    class_key, class_id, first_key``; ``class_key`` names the class of near-duplicates, ``first_key`` is the row key of
    the class's first document (smallest id, nulls last)."""

    rows: SharedTable
    classes: SharedTable

    def drop(self) -> None:
        self.rows.drop()
        self.classes.drop()


def find_classes(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    recall: float = RECALL, trees: int = TREES, depth: int = DEPTH,
) -> Classes:
    """Run the join. The two tables lie below the shared folder; drop them when their readers are done."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = narrow.withColumn("row_key", _row_key("doc_id", "text"))
    signed = materialise(_signed(keyed, words, trees, depth), "signed")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    reps = materialise(
        signed.df.filter("digest IS NOT NULL")
        .groupBy("digest", "node", "size")
        .agg(F.min(own).alias("lead"), F.count("*").alias("copies"), F.first("signature").alias("signature")),
        "representatives",
    )
    length = prefix_length(similarity, recall, trees, depth, measured_prefixes(keyed, reps.df, words, similarity, trees, depth))
    candidates = _candidates(reps.df, length, similarity, trees, depth)
    found = reps.df.join(candidates.df, "node")
    members = materialise(found.select("component", "digest", "size", "copies", F.col("lead.row_key").alias("row_key")), "members")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    blocks = materialise(members.df.groupBy("component").agg(parts.alias("parts")), "blocks")
    placed = members.df.join(blocks.df, "component").withColumn("block", F.pmod(F.xxhash64("digest"), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", "parts", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "digest",
        "copies", "row_key",
    )
    wanted, held = _narrowed(keyed, members.df, "row_key")
    once = wanted.groupBy("row_key").agg(F.first("text").alias("text"))
    verified = materialise(_verified(placed.join(once, "row_key"), words, similarity), "verified")
    # A task that holds a whole component names its classes for good, by their smallest; others are tied together.
    ties = verified.df.filter("parts > 1").select(F.col("node").alias("id_a"), F.col("root").alias("id_b"))
    tied = components_of_numbers(ties)
    alone_there = F.min(F.when(F.col("parts") == 1, F.col("root")))
    links = verified.df.groupBy("digest", "node").agg(F.sum("links").alias("links"), alone_there.alias("whole"))
    linked = links.join(tied.df, "node", "left").select("digest", "links", F.coalesce("whole", "component").alias("component"))
    key = F.coalesce("component", "node").alias("class_key")
    named = reps.df.join(linked, "digest", "left")
    named = materialise(named.select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), key, "lead"), "named")
    firsts = materialise(named.df.groupBy("class_key").agg(F.min("lead").alias("first")), "firsts")
    classes = named.df.drop("lead").join(firsts.df, "class_key")
    classes = classes.select("*", F.col("first.doc_id").alias("class_id"), F.col("first.row_key").alias("first_key"))
    out = Classes(signed, materialise(classes.drop("first"), "classes"))
    for table in (reps, candidates, held, members, blocks, verified, tied, named, firsts):
        table.drop()
    return out


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", **more) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``docs``: the smallest id of its class of near-duplicates, and to
    how many other rows its similarity reaches the threshold (copies count each)."""
    found = find_classes(docs, doc_id=doc_id, **more)
    rows = found.rows.df
    linked = rows.join(found.classes.df, "digest")
    alone = rows.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")).unionByName(alone)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of ``docs``, with their own columns, of which each class keeps its first (smallest id, nulls last); of
    rows equal in id and text, the one whose columns hash lowest. Texts without words all stay."""
    found = find_classes(docs, doc_id=doc_id, text=text, **more)
    key, met_key, lead, hit = (added(docs, c) for c in ("row_key", "met_key", "lead", "hit"))
    rows = found.rows.df.filter("digest IS NOT NULL").groupBy("row_key").agg(F.count("*").alias("n"))
    chosen = found.classes.df.select(F.col("first_key").alias("row_key"), F.lit(True).alias("chosen")).distinct()
    # Keys of which not every row stays; a text without words is of no class, and its rows all stay.
    met = rows.join(chosen, "row_key", "left").filter("n > 1 OR chosen IS NULL")
    met = materialise(met.select("row_key", F.coalesce("chosen", F.lit(False)).alias("chosen")), "met")
    found.drop()
    named = _marked(docs.withColumn(key, _row_key(doc_id, text)), key, _key_map(met.df, "row_key").df, hit)
    keys = met.df.select(F.col("row_key").alias(met_key), F.col("chosen").alias(lead))
    clear = named.filter(~F.col(hit)).select(*docs.columns)
    checked = named.filter(F.col(hit)).join(keys, F.col(key) == F.col(met_key), "left")
    others = checked.filter(F.col(met_key).isNull()).select(*docs.columns)
    # Equal rows are reduced before the shuffle, however many there are.
    lowest = F.min_by(F.struct(*docs.columns), F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    leads = checked.filter(F.col(lead)).groupBy(met_key).agg(lowest.alias(key)).select(f"{key}.*")
    return clear.unionByName(others).unionByName(leads)
