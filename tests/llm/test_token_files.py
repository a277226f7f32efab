"""Token files: round trips, ranges, and the ids of whole tables against the tokenizer on whole texts."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import token_files
from tests.llm.conftest import LONG, table


@pytest.fixture(scope="module")
def own():
    return token_files.encoder(token_files.TOKENIZER)


def _expected(own, rows, end_id=1):
    """Rows of id, text, by the tokenizer on whole texts."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out, start = [], 0
    for name, text in order:
        ids = np.append(own.whole(text or ""), end_id).astype("<u4")
        out.append((name, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x85  ́e'sllABé<|>")), max_size=60))
def test_words_one_by_one_are_the_whole_text(text):
    own = token_files.encoder(token_files.TOKENIZER)
    assert own.encode(text.encode()).tolist() == own.whole(text).tolist()


def test_special_and_long_words(own):
    for text in ("<|endoftext|> a<|startoftext|>b", "x" * 5000 + " y " + "é" * 3000, "it's I'LL we 've don't'dx 's'", "ÀÉÿß×÷µªº 12a3", LONG):
        assert own.encode(text.encode()).tolist() == own.whole(text).tolist()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    draw = np.random.default_rng(0)
    for ids in (np.zeros(9), np.zeros(0), draw.integers(0, 49408, 1000), np.array([2**32 - 1, 0, 1]), np.ones(8)):
        ids = ids.astype(np.uint32)
        planes = token_files.to_planes(ids, kind)
        assert token_files.from_planes(planes, len(ids), kind).tolist() == ids.tolist()
    assert len(token_files.to_planes(np.array([49407], np.uint32), "bit")) == 16
    assert len(token_files.to_planes(np.array([49407], np.uint32), "byte")) == 2


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_and_ranges(tmp_path, kind):
    """Documents that cross blocks, empty ones, ranges within and across blocks; a damaged file is told."""
    draw = np.random.default_rng(1)
    file = token_files.Writer(str(tmp_path), "a.bin", kind, 64, 3)
    docs = [(i if i != 5 else None, draw.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([0, 1, 63, 64, 65, 200, 0, 7])]
    for name, ids in docs:
        file.add(name, ids)
    assert not (tmp_path / "a.bin").exists()
    assert file.commit()[:3] == ("a.bin", 8, 400) and sorted(os.listdir(tmp_path)) == ["a.bin"]
    whole = np.concatenate([ids for _, ids in docs])
    reader = token_files.Reader(str(tmp_path), "a.bin")
    for start, stop in ((0, 400), (0, 0), (63, 65), (64, 128), (399, 1000), (130, 131), (-5, 3)):
        assert reader.ids(start, stop).tolist() == whole[max(0, start) : stop].tolist()
    found = list(reader.documents())
    assert [d[0] for d in found] == [d[0] for d in docs]
    assert [d[3] for d in found] == [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in docs]
    raw = (tmp_path / "a.bin").read_bytes()
    for name, data in (("short", raw[:-3]), ("index", raw[:-40] + b"xxxx" + raw[-36:])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="whole file|damaged"):
            token_files.Reader(str(tmp_path), name)


def test_odd_documents(spark, odd, nothing, own, rows):
    expected = _expected(own, [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()])
    for more in ({}, {"shard_bytes": 20_000, "block": 1024}, {"planes": "byte", "shard_bytes": 1}):
        assert rows(token_files.written_and_read(odd, **more)) == expected
    assert token_files.written_and_read(nothing).collect() == []


def test_whole_table(spark, data, own, rows):
    docs = table(spark, data, "documents")
    got = token_files.written_and_read(docs, path=token_files.TOKENIZER)
    assert rows(got) == _expected(own, [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_hot_null_and_outlying_ids_are_split(spark, tmp_path):
    """A third of the rows with one id and text, a third without an id, one id far away: even shards, several read tasks."""
    docs = spark.range(3000, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id WHEN id = 2 THEN 4611686018427387904 END AS doc_id", "'some words of a text' AS text"
    )
    manifest = token_files.write_tokens(docs, str(tmp_path / "ids"), shard_bytes=5_000).df
    sizes = [r[0] for r in manifest.select("n_docs").collect()]
    assert sum(sizes) == 3000 and len(sizes) > 15 and max(sizes) < 4 * 3000 / len(sizes)
    read = token_files.read_tokens(manifest, str(tmp_path / "ids"))
    assert read.rdd.getNumPartitions() == len(sizes)
    assert read.count() == 3000
