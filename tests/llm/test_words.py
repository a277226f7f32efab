import numpy as np
import pyarrow as pa

from kinweave.llm import fm_index, words
from tests.llm.conftest import ODD, VISIBLE
from tests.llm.conftest import words as plain_words


def _texts(values):
    return words.texts_of(pa.array(values, pa.string()))


def test_words_are_those_of_the_patterns():
    values = [t for _, t, _ in ODD]
    for chunk_bytes in (1, 100, 1 << 20):
        found, seen = [], []
        for _, part in words.chunks(_texts(values), chunk_bytes):
            low = words.Texts(words.lowered(part.data), part.offsets)
            for texts, table, out in ((low, words.alnum_bytes(), found), (part, words.visible_bytes(), seen)):
                w = words.find_words(texts, table)
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    out.append([texts.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)])
        assert found == [plain_words(t) for t in values]
        assert seen == [VISIBLE.findall(t or "") for t in values]


def test_slices_of_a_column_are_read_at_their_place():
    column = pa.array(["a b", None, "c", "d e"]).slice(1, 2)
    texts = words.texts_of(column)
    assert texts.data.tobytes() == b"c" and texts.offsets.tolist() == [0, 0, 1]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data = np.frombuffer(b"ab cd ab " + b"z" * 300_000 + b" cd ab", np.uint8)
    w = words.find_words(words.Texts(data, np.array([0, len(data)])), words.alnum_bytes())
    h = words.span_hashes(data, w.starts, w.ends)
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_shingles_of_short_and_long_texts():
    texts = _texts(["a b c d e f", "", "a b", "b a", "a b c d e"])
    w = words.find_words(texts, words.alnum_bytes())
    values, bounds = words.shingles(words.span_hashes(texts.data, w.starts, w.ends), w.first, 5)
    assert np.diff(bounds).tolist() == [2, 0, 1, 1, 1]
    assert values[0] == values[4] and values[2] != values[3]


def test_index_finds_what_a_search_finds():
    rng = np.random.default_rng(5)
    for trial in range(40):
        size, kinds = int(rng.integers(1, 150)), int(rng.integers(2, 8))
        x = rng.integers(1, kinds, size)
        x = np.tile(x, 3) if trial % 3 == 0 else x
        index = fm_index.FmIndex(x, kinds.bit_length(), sample=int(rng.integers(1, 20)))
        patterns = np.zeros((20, 5), np.int64)
        for row in patterns:
            n = rng.integers(1, 6)
            row[5 - n :] = rng.integers(1, kinds, n)
        for row, low, high in zip(patterns, *index.search(patterns), strict=True):
            p = row[row > 0]
            want = [i for i in range(len(x) - len(p) + 1) if (x[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(low, high))) == want
