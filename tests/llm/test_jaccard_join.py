from collections import Counter

import numpy as np
import pytest

from kinweave.llm import jaccard_join as J
from tests.llm.conftest import ODD, words


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_force(rows, similarity=J.SIMILARITY):
    """Class and links of each row, by number; a class by the rows in it."""
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= similarity * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, smallest[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def _copies():
    rng = np.random.default_rng(11)
    rows = []
    for group in range(12):
        text = [f"g{group}w{i}" for i in rng.integers(0, 500, 60)]
        for _ in range(int(rng.integers(1, 9))):
            changed = list(text)
            for _ in range(int(rng.integers(0, 4))):
                changed[int(rng.integers(0, 60))] = "changed"
            rows.append((len(rows), " ".join(changed)))
            text = changed if group % 3 == 0 else text  # chains of copies of copies
    return rows + [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:7])]


def _join(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((tuple(r) for r in J.near_duplicates(df, **more).collect()), key=repr)


def test_equal_to_all_pairs(spark):
    rows = _copies()
    assert _join(spark, rows) == brute_force(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    """A component cut into many blocks: links between any two blocks are found once."""
    monkeypatch.setattr(J, "BLOCK_CLASSES", 3)
    rows = _copies()
    assert _join(spark, rows) == brute_force(rows)


def test_odd_documents(spark):
    rows = [(i, t) for i, t, _ in ODD]
    assert _join(spark, rows) == brute_force(rows)


def test_one_of_each_class_stays(odd):
    kept = J.keep_one(odd).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept)
    # 8 and 9 differ in case only, 10 in a few words more; of the rows 6 one goes; texts without words stay.
    assert [x[1] for x in ids] == [1, 2, 3, 4, 5, 6, 6, 8, 11, 12, 0] or [x[1] for x in ids] == [1, 2, 3, 4, 5, 6, 6, 8, 10, 11, 12, 0]
    assert kept[0].asDict().keys() == set(odd.columns)


def test_nothing(nothing):
    assert J.near_duplicates(nothing).count() == 0


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert J.prefix_length(0.8, 0.9999, 20, 8) == 4
    assert J.prefix_length(0.8, 0.5, 20, 8) == 8
    assert J.prefix_length(0.1, 0.9999, 2, 8) == 1
    assert J.prefix_length(0.8, 0.9999, 20, 8, [0] * 8 + [500]) == 4
    assert J.prefix_length(0.8, 0.9999, 20, 8, [0, 0, 0, 1, 0, 20, 0, 0, 500]) == 3
    assert J.prefix_length(0.8, 0.9, 20, 8, [0, 0, 10, 0, 0, 0, 0, 90, 0]) == 7


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, np.uint64)])
    both, first = np.concatenate([a, b]), np.array([0, 1000, 2000])
    signatures = J._signatures(both, first, 400, 4).reshape(2, 400, 4)
    same = [np.mean((signatures[0, :, :k] == signatures[1, :, :k]).all(1)) for k in (1, 2, 4)]
    jaccard = 800 / 1200
    assert all(abs(s - jaccard**k) < 0.08 for s, k in zip(same, (1, 2, 4), strict=True))


@pytest.mark.parametrize("n", [3, 40, 200])
def test_common_shingles(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)]
    sets += [np.unique(np.concatenate([sets[0], s[:1]])) for s in sets]
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    got = J._common(np.concatenate(sets), member, np.arange(len(sets)), len(sets))
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    others = ~np.eye(len(sets), dtype=bool)
    assert (got == np.array(want))[others].all()


def _keyed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return df.withColumn("row_key", J._row_key("doc_id", "text"))


def test_measured_prefixes_are_those_of_all_pairs(spark):
    """All classes fit the sample, so every pair of a class and a similar text that is not equal is counted."""
    rows = _copies()
    keyed = _keyed(spark, rows)
    reps = J._signed(keyed, 5, J.TREES, J.DEPTH).dropDuplicates(["digest"]).withColumn("lead", J.F.struct("row_key"))
    matched = J.measured_prefixes(keyed, reps, 5, J.SIMILARITY, J.TREES, J.DEPTH)
    sets = [shingle_set(t) for _, t in rows]
    classes = {frozenset(s) for s in sets}
    near = sum(a != b and len(a & b) >= J.SIMILARITY * len(a | b) for a in classes for b in sets)
    assert sum(matched) == near > 0
    assert len(matched) == J.DEPTH + 1


def test_shorter_prefixes_lose_nothing(spark, monkeypatch):
    rows = _copies()
    monkeypatch.setattr(J, "measured_prefixes", lambda *a: [0, 0, 1, 0, 0, 0, 0, 0, 0])
    assert _join(spark, rows) == brute_force(rows)


def test_dissimilar_chains_do_not_hang_together(spark):
    """400 texts, each like the next to 0.59: runs chain them, whole signatures take them apart."""
    size, step = 100, 26
    texts = [" ".join(f"w{k}" for k in range(i * step, i * step + size + 4)) for i in range(400)]
    rows = list(enumerate(texts))
    signed = J._signed(_keyed(spark, rows), 5, J.TREES, J.DEPTH)
    found = J._candidates(signed, J.prefix_length(), J.SIMILARITY, J.TREES, J.DEPTH)
    sizes = [r["count"] for r in found.df.groupBy("component").count().collect()]
    found.drop()
    assert max(sizes, default=0) <= 6
    assert _join(spark, rows) == [(i, i, 0) for i in sorted(range(400), key=lambda i: repr((i, i, 0)))]


def test_recall_of_the_forest_on_similar_texts(spark):
    """Pairs close to the threshold, each in texts of their own."""
    rng = np.random.default_rng(5)
    rows = []
    for pair in range(300):
        text = [f"p{pair}w{i}" for i in range(104)]
        other = list(text)
        at = int(rng.integers(0, 100))
        other[at : at + 4] = [f"x{pair}"] * 4 if pair % 2 else other[at : at + 4]
        other += [f"e{pair}y{i}" for i in range(int(rng.integers(1, 14)))]
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(other))]
    assert _join(spark, rows) == brute_force(rows)


def test_many_equal_rows_keep_one(spark):
    """Rows equal in id and text are reduced without a window; rows without words all stay."""
    df = spark.range(3000).selectExpr(
        "IF(id % 3 = 0, 1, id) AS doc_id", "IF(id % 3 = 0, 'one two three four five six seven', IF(id % 3 = 1, '', CONCAT('w', id))) AS text",
        "id AS n", "'x' AS row_key", "'y' AS kept_key",
    )
    kept = J.keep_one(df)
    assert "Window" not in kept._jdf.queryExecution().optimizedPlan().toString()
    rows = kept.collect()
    assert len(rows) == 1 + 1000 + 1000
    assert sum(r.doc_id == 1 and r.text != "" for r in rows) == 1
    assert set(rows[0].asDict()) == {"doc_id", "text", "n", "row_key", "kept_key"}


def test_map_of_keys(spark):
    """No key of the map is missed, few others are taken for one of them."""
    held = J._key_map(spark.range(0, 200_000, 2).selectExpr("CAST(id AS STRING) AS k"), "k")
    df = spark.range(200_000).selectExpr("CAST(id AS STRING) AS k", "id", "'x' AS key_bits")
    out = J._marked(df, "k", held.df, "hit")
    assert out.columns == ["k", "id", "key_bits", "hit"]
    assert out.filter("id % 2 = 0 AND hit").count() == 100_000
    assert out.filter("id % 2 = 1 AND hit").count() < 1000
    held.drop()
