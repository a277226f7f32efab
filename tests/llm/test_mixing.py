from collections import defaultdict

import pytest

from kinweave.llm import mixing as M
from tests.llm.conftest import ODD, VISIBLE


def _targets(sizes, weights=M.WEIGHTS, epochs=M.EPOCHS):
    """Water-filling in plain Python: clamp, share out the rest, repeat."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = {s for s in names if not sizes[s]}
    while True:
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > epochs * sizes[s]}
        if not over:
            return target
        full |= over


def _sizes(rows):
    out = defaultdict(int)
    for _, text, source in rows:
        out[source] += len(VISIBLE.findall(text or ""))
    return dict(out)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, None: 7}, {"a": 0, "b": 5}, {"x": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in M.source_targets(df).df.collect()}
    assert got == pytest.approx(_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_odd_documents(odd):
    rows = M.mix(odd).collect()
    want = _targets(_sizes(ODD))
    sources = {(i, len(VISIBLE.findall(t or ""))): s for i, t, s in ODD}
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, n) for i, n in sources) or len(rows) == len(ODD)
    for r in rows:
        assert r.target == pytest.approx(want[sources[r.doc_id, r.size]])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{i % 30 if i % 3 else 0:02d}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first = M.mix(docs).collect()
    again = M.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    want, got = _targets(_sizes(rows)), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for r in first:
        got[source[r.doc_id]] += r.taken
    assert all(abs(got[s] - want[s]) <= 97 for s in want)
    assert sorted(map(tuple, first)) != sorted(map(tuple, M.mix(docs, seed=18).collect()))


def test_repetitions_are_the_mix(spark, odd):
    docs = odd.withColumnRenamed("kept", "repetition")
    out = M.repeated(docs)
    assert out.columns == [*docs.columns, "repetition_"]
    times = sum(r.times for r in M.mix(docs).collect())
    assert out.count() == times
    assert out.filter("source <=> 'd'").select("repetition_").distinct().count() <= 3


def test_nothing(nothing):
    assert M.mix(nothing).count() == 0 and M.repeated(nothing).count() == 0
