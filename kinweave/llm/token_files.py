"""Token ids of documents as files of shuffled bits: a writer, a reader of whole files and one of ranges of ids.

* Documents are dealt into shards by range of (id, digest of the text, copy), so ids lie in order, and null, frequent and
  outlying ids are split. Texts are shuffled once and encoded once, by the task that writes the shard; it holds a block of
  ids, a word cache of bounded size and one text with its ids.
* A file holds blocks of ``block`` ids. The ids of a block are transposed into planes: plane ``p`` holds bit ``p`` of every
  id (``planes="bit"``) or byte ``p`` of it (``"byte"``); planes above the block's largest id are left out. Each plane is
  compressed by zstandard by itself.
* After the blocks comes a chunk index: for each block the place and the sizes of its planes, for each document its id and
  number of ids; then a fixed-size end that tells where the index is. A reader fetches only the blocks that it needs.
* Files are written under temporary names and renamed when whole; only files that the manifest lists count. A lost task is
  run again and replaces its file. Where shards are cut may change between runs, the ids in order do not.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain, groupby, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm.words import texts_of
from kinweave.sources.shared import SharedTable, materialise, scratch_path

#: A tokenizer's file, the same place on every machine. Never copied.
TOKENIZER = os.environ.get("KINWEAVE_WORD_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")
#: Appended to every document.
END_ID = 1
#: Ids of a block, a multiple of 8.
BLOCK = 1 << 16
#: Shards hold about so many bytes of text, and there are at most so many shards.
SHARD_BYTES = 16 << 20
SHARDS = 1 << 16
#: Words that the cache holds before it is emptied, and the longest word (bytes) kept in it.
CACHE_WORDS, CACHE_WORD = 1 << 20, 64
#: The form of the tokenizers that are fast here, how their parts are told, and how they write bytes.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ\n]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
#: Bytes that have a printable Latin-1 character stand for themselves, the others follow from U+0100.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
MAGIC = b"KWIDS01\n"
#: Index offset, its compressed size and its crc32, before the closing magic.
_END = struct.Struct("<QQI")
_HEAD = struct.Struct("<BBIQQQ")
_BIT, _BYTE = 0, 1


class Encoder:
    """Ids of UTF-8 texts, the same as the tokenizer gives for the whole text at once.

    A tokenizer of the ``_SPLIT`` form drops white space and looks at nothing beyond it, so that a text's ids are those of
    its words one after the other. Words are cut at ASCII white space; distinct words are encoded once and kept, so that
    no text takes more memory than its bytes and ids. Words of printable ASCII and Latin-1 letters are their own
    normal form but for capitals; their parts go straight to the tokenizer's model. All others go through the whole
    tokenizer. A tokenizer of another form encodes whole texts.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self._by_words = form["normalizer"] == _NORMALIZER and form["pre_tokenizer"] == _SPLIT and not form["post_processor"]
        self._added = [t["content"] for t in form["added_tokens"]]
        self._by_words &= all(t.startswith("<") for t in self._added)
        self._clear()

    def _clear(self) -> None:
        self._number: dict[bytes, int] = {}
        self._of_part: dict[str, list[int]] = {"\n": []}
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0
        self._starts, self._sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._words = 0

    def whole(self, text: str) -> np.ndarray:
        """Without a cache."""
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word(self, word: str) -> list[int]:
        """Ids of any word, by the whole tokenizer."""
        return self._tokenizer.encode(word, add_special_tokens=False).ids

    def _plain(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain words, one in each line, and how many each has."""
        parts = _PARTS.findall(words.lower())
        known = self._of_part
        for part in [p for p, ids in zip(parts, map(known.get, parts), strict=True) if ids is None]:
            if part not in known:
                shown = part if part.isascii() else "".join(map(_BYTES.__getitem__, part.encode()))
                known[part] = [t.id for t in self._model.tokenize(shown)]
        of_parts = list(map(known.__getitem__, parts))
        sizes = np.fromiter(map(len, of_parts), np.int64, len(parts))
        ids = np.fromiter(chain.from_iterable(of_parts), np.uint32, int(sizes.sum()))
        ends = np.append(np.flatnonzero(np.fromiter(map("\n".__eq__, parts), bool, len(parts))), len(parts))
        for part in [p for p in set(parts) if len(p) > CACHE_WORD]:
            del known[part]
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends], prepend=0)

    def _learn(self, words: list[bytes]) -> None:
        """Number new words, in order."""
        lines = b"\n".join(words).decode()
        if _PLAIN.fullmatch(lines) and not ("<" in lines and any(t in lines for t in self._added)):
            self._keep(*self._plain(lines))
        elif len(words) > 1:
            plain = [_PLAIN.fullmatch(w) is not None and "<" not in w for w in lines.split("\n")]
            for same, group in groupby(zip(words, plain, strict=True), lambda x: x[1]):
                for some in [[w for w, _ in group]] if same else [[w] for w, _ in group]:
                    self._learn(some)
        else:
            ids = self._word(lines)
            self._keep(np.array(ids, np.uint32), np.array([len(ids)]))

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words, by all their ids and how many each has."""
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._words + len(sizes) > len(self._starts):
            self._starts, self._sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self._starts, self._sizes))
        own = slice(self._words, self._words + len(sizes))
        self._flat[self._used : self._used + len(ids)] = ids
        self._sizes[own] = sizes
        self._starts[own] = self._used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        self._words += len(sizes)

    def encode(self, text: bytes) -> np.ndarray:
        if not self._by_words:
            return self.whole(text.decode())
        if self._words > CACHE_WORDS or self._used > 16 * CACHE_WORDS:
            self._clear()
        parts = text.split()
        number = np.fromiter(map(self._number.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(number < 0).tolist()
        if unknown:
            words = list(dict.fromkeys(map(parts.__getitem__, unknown)))
            new = dict(zip(words, range(self._words, self._words + len(words)), strict=True))
            self._learn(words)
            number[unknown] = np.fromiter(map(new.__getitem__, map(parts.__getitem__, unknown)), np.int64, len(unknown))
            self._number.update(new if max(map(len, words)) <= CACHE_WORD else {w: at for w, at in new.items() if len(w) <= CACHE_WORD})
        sizes = self._sizes[number]
        before = np.cumsum(sizes) - sizes
        return self._flat[np.repeat(self._starts[number] - before, sizes) + np.arange(int(sizes.sum()))]


@cache
def encoder(path: str = TOKENIZER) -> Encoder:
    """One per process; a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block, lowest first; none if all ids are 0."""
    largest = int(ids.max(initial=0))
    if kind == "byte":
        parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [parts[:, p].tobytes() for p in range((largest.bit_length() + 7) // 8)]
    return [np.packbits((ids >> p).astype(np.uint8) & 1, bitorder="little").tobytes() for p in range(largest.bit_length())]


def from_planes(planes: Sequence[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ``n`` ids of a block."""
    out = np.zeros(n, np.uint32)
    for p, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if kind == "bit":
            raw = np.unpackbits(raw, count=n, bitorder="little")
        out |= raw.astype(np.uint32) << np.uint32(p if kind == "bit" else 8 * p)
    return out


class Writer:
    """One file, written as ids come."""

    def __init__(self, folder: str, name: str, planes: str, block: int, level: int):
        self.system, root = fs.FileSystem.from_uri(folder)
        self.name, self.planes, self.block = name, planes, block
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
        self.system.create_dir(root, recursive=True)
        self.out = self.system.open_output_stream(self.temporary, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.size, self.n_ids, self.held, self.waiting = len(MAGIC), 0, 0, []
        self.offsets, self.sizes, self.counts = [], [], []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) // self.block * self.block
            for at in range(0, full, self.block):
                self._flush(whole[at : at + self.block])
            self.waiting, self.held = [whole[full:].copy()], len(whole) - full

    def _flush(self, ids: np.ndarray) -> None:
        self.offsets.append(self.size)
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.planes)]
        self.sizes += [len(p) for p in packed]
        self.counts.append(len(packed))
        for p in packed:
            self.out.write(p)
            self.size += len(p)

    def commit(self) -> tuple[str, int, int, int]:
        """Name, documents, ids and bytes of the file, which stands from now on."""
        if self.held:
            self._flush(np.concatenate(self.waiting))
        kind = _BIT if self.planes == "bit" else _BYTE
        null = np.array([d is None for d in self.docs], np.uint8)
        raw = b"".join(
            [
                _HEAD.pack(1, kind, self.block, self.n_ids, len(self.offsets), len(self.docs)),
                np.array(self.offsets, "<u8").tobytes(), np.array(self.counts, np.uint8).tobytes(), np.array(self.sizes, "<u4").tobytes(),
                null.tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(), np.array(self.lengths, "<u8").tobytes(),
            ]
        )
        packed = self.zstd.compress(raw)
        self.out.write(packed + _END.pack(self.size, len(packed), zlib.crc32(packed)) + MAGIC)
        self.out.close()
        self.system.move(self.temporary, self.final)
        return self.name, len(self.docs), self.n_ids, self.size + len(packed) + _END.size + len(MAGIC)


class Index(NamedTuple):
    planes: str
    block: int
    n_ids: int
    offsets: np.ndarray
    #: Sizes of the planes of block ``b``: ``sizes[first[b]:first[b + 1]]``.
    first: np.ndarray
    sizes: np.ndarray
    docs: list
    lengths: np.ndarray


class Reader:
    """One file: its index, and any range of its ids."""

    def __init__(self, folder: str, name: str):
        system, root = fs.FileSystem.from_uri(folder)
        self.name, self.file = name, system.open_input_file(f"{root}/{name}")
        self.zstd = zstandard.ZstdDecompressor()
        self.index = self._index()

    def close(self) -> None:
        self.file.close()

    def _index(self) -> Index:
        size = self.file.size()
        end = _END.size + len(MAGIC)
        if size < end + len(MAGIC) or (tail := self.file.read_at(end, size - end))[_END.size :] != MAGIC:
            raise ValueError(f"{self.name} is no whole file of token ids")
        at, length, check = _END.unpack(tail[: _END.size])
        packed = self.file.read_at(length, at)
        if zlib.crc32(packed) != check:
            raise ValueError(f"{self.name}: the index is damaged")
        raw = self.zstd.decompress(packed)
        _, kind, block, n_ids, n_blocks, n_docs = _HEAD.unpack_from(raw)
        place = _HEAD.size

        def numbers(form: str, n: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(raw, form, n, place)
            place += out.nbytes
            return out

        offsets, counts = numbers("<u8", n_blocks), numbers("u1", n_blocks)
        first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        sizes, null, ids, lengths = numbers("<u4", int(first[-1])), numbers("u1", n_docs), numbers("<i8", n_docs), numbers("<u8", n_docs)
        docs = [None if none else d for none, d in zip(null.tolist(), ids.tolist(), strict=True)]
        return Index("bit" if kind == _BIT else "byte", block, n_ids, offsets, first, sizes, docs, lengths.astype(np.int64))

    def read_block(self, b: int) -> np.ndarray:
        i = self.index
        sizes = i.sizes[i.first[b] : i.first[b + 1]].tolist()
        raw, at, planes = self.file.read_at(sum(sizes), int(i.offsets[b])), 0, []
        for size in sizes:
            planes.append(self.zstd.decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, min(i.block, i.n_ids - b * i.block), i.planes)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number ``start`` to ``stop`` of the file, from the blocks that hold them."""
        start, stop, block = max(0, start), min(stop, self.index.n_ids), self.index.block
        if start >= stop:
            return np.zeros(0, np.uint32)
        parts = [self.read_block(b) for b in range(start // block, (stop - 1) // block + 1)]
        low = start // block * block
        return np.concatenate(parts)[start - low : stop - low]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Id, first id's number in the file, number of ids and their crc32, of each document; one block is held."""
        at = held = -1
        ids, place = np.zeros(0, "<u4"), 0
        for doc, n in zip(self.index.docs, self.index.lengths.tolist(), strict=True):
            check, begin, left = 0, place, n
            while left:
                at, inside = divmod(place, self.index.block)
                if at != held:
                    ids, held = self.read_block(at).astype("<u4"), at
                part = ids[inside : inside + left]
                check = zlib.crc32(part.tobytes(), check)
                place, left = place + len(part), left - len(part)
            yield doc, begin, n, check


_MANIFEST = "shard long, name string, n_docs long, n_ids long, bytes long"


def write_tokens(
    docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", path: str = TOKENIZER, end_id: int = END_ID,
    planes: str = "bit", block: int = BLOCK, level: int = 3, shard_bytes: int = SHARD_BYTES,
) -> SharedTable:
    """Write the ids of all rows in ascending order of ``doc_id`` (an integer; null last) and return the manifest
    (``shard, name, n_docs, n_ids, bytes``), a line per file.

    A null text is empty; every document ends with ``end_id``. Rows of one id are ordered by the MD5 of their text; rows
    equal in both are written each. No rows: no files.
    """
    if planes not in ("bit", "byte") or block <= 0 or block % 8:
        raise ValueError("planes are 'bit' or 'byte', a block is a multiple of 8 ids")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, min(SHARDS, -(-total // shard_bytes)))
    key = [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("copy")]
    dealt = plain.withColumns({"digest": F.md5("text"), "copy": F.monotonically_increasing_id()}).repartitionByRange(n, *key).sortWithinPartitions(*key)
    lines = dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard, own, last = None, 0, encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            if batch.num_rows and file is None:
                shard = batch.column(0)[0].as_py()
                file = Writer(folder, f"ids-{shard:06d}.bin", planes, block, level)
            texts = texts_of(batch.column(2))
            for row, name in enumerate(batch.column(1).to_pylist()):
                ids = own.encode(texts.data[texts.offsets[row] : texts.offsets[row + 1]].tobytes())
                file.add(name, np.concatenate([ids, last]))
        if file:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (shard, *file.commit())], names=["shard", "name", "n_docs", "n_ids", "bytes"])

    return materialise(lines.mapInArrow(run, _MANIFEST), "token-files")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of the manifest, a task per file.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the unsigned crc32 of the document's ids as
    little-endian unsigned 32-bit integers."""
    # At most SHARDS lines go through this window.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", "name", "n_docs", "n_ids", before.alias("before"))
    # An explicit number of partitions, which adaptive execution does not join into one.
    dealt = files.repartition(max(1, manifest.count()), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                file = Reader(folder, line["name"])
                if (len(file.index.docs), file.index.n_ids) != (line["n_docs"], line["n_ids"]):
                    raise ValueError(f"{line['name']} is not the file of the manifest")
                rows = []
                for doc, start, n, check in file.documents():
                    rows.append((doc, line["before"] + start, n, check))
                    if len(rows) == 50_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)
                file.close()

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def written_and_read(docs: DataFrame, **more) -> DataFrame:
    """Write files below the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_tokens(write_tokens(docs, folder, **more).df, folder)
