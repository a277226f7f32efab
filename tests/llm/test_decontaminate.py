import hashlib

import pytest

from kinweave.llm import decontaminate as D
from tests.llm.conftest import ODD, words

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Small birds watch"),
    (3, "one"),
    (4, ""),
    (5, None),
    (6, "!!!"),
    (2, "an old wooden fence nearby"),
    (None, "no id here"),
    (10, "one two three four five six seven eight nine ten"),
    (11, "数字 😀 ok"),
]
DOCS = [(i, t) for i, t, _ in ODD] + [
    (30, "x ONE two, three four five six seven eight nine ten eleven twelve y"),
    (31, "one two three four five six seven eight nine"),
    (32, "two three four five six seven eight nine ten eleven\n\ntwo three four five six seven eight nine ten eleven é"),
    (33, "small birds"),
    (34, "watch small birds watch small birds watch"),
]


def brute(text, window=10):
    w, hit, found = words(text), set(), set()
    for item, phrase in ITEMS:
        p = words(phrase)
        for k in range(max(len(p) - window + 1, 1 if p else 0)):
            part = p[k : k + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(item)
    names = sorted(str(f) for f in found if f is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id bigint, text string, n_words int, hit_items string").repartition(4)


def test_equal_to_a_plain_search(docs, items):
    got = sorted((tuple(r) for r in D.contamination(docs, items).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in DOCS), key=repr)


@pytest.mark.parametrize("shard_words", [1, 40])
def test_small_shards_and_blocks_of_phrases_give_the_same(docs, items, monkeypatch, shard_words):
    monkeypatch.setattr(D, "BLOCK_PHRASES", 12)
    assert len(list(D._blocks(items, "item_id", "text"))) > 2
    few = docs.filter("doc_id <> 5")
    got = sorted((tuple(r) for r in D.contamination(few, items, shard_words=shard_words).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in DOCS if i not in (None, 5)), key=repr)


def test_spans_are_cut_out(docs, items):
    out = D.remove_hits(docs, items)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.filter("doc_id >= 30 OR doc_id < 3").collect()}
    assert got[1] is None and got[2] == ""
    assert got[30] == "x  y" and got[31] == " two three four five six seven eight nine"
    assert got[32] == " é" and got[33] == "small birds" and got[34] == "watch "


@pytest.mark.parametrize("most", [1, 200_000])
def test_more_blocks_are_no_more_stages_and_cut_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BLOCK_PHRASES", most)
    texts = ["red green blue", "cyan pink grey", "grey black", "tan " * 40] + ["red green blue"] * 30
    many = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(texts)], "item_id string, text string")
    monkeypatch.setattr(type(many), "toLocalIterator", _small(type(many).toLocalIterator))
    df = spark.createDataFrame([(1, "a red green blue, cyan pink grey black z"), (2, "pink grey")], "doc_id bigint, text string")
    out = D.remove_hits(df, many)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a  z", 2: "pink grey"}
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: (r.n_hit, r.n_items) for r in D.contamination(df, many).collect()} == {1: (7, 33), 2: (0, 0)}


def _small(fetch):
    """Fails if a text comes to the driver."""

    def checked(df, *more):
        assert not {"text", "words"} & {c.lower() for c in df.columns} and len(df.columns) == 1
        return fetch(df, *more)

    return checked


def test_a_long_item_is_made_in_runs(spark, monkeypatch):
    monkeypatch.setattr(D, "_MADE", 7)
    text = " ".join(f"w{i}" for i in range(100))
    got = D._phrases(spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "i int, t string"), "i", "t", 10).collect()
    assert len({bytes(r.words) for r in got}) == len(got) == 92 and sorted({len(r.words) for r in got}) == [16, 80]


def test_nothing(docs, items):
    assert D.contamination(docs.limit(0), items).count() == 0
    rows = D.contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.contaminated for r in rows)
