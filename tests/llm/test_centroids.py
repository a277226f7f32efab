"""Integer k-means against plain Python, and the search against all distances."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from kinweave.llm import centroids
from tests.llm.conftest import table


def _brute(rows, k=40, rounds=5, seed=2, dim=64):
    """Rows of vec_id, cluster, distance, cluster_inertia, inertia, digest."""
    kept = []
    for name, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x):
            kept.append((name, [math.floor(256 * v) for v in x]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(r[1]) for r in start[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((far(x, c), i) for i, c in enumerate(cs))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[near(x)[1]].append(x)
        for i, m in members.items():
            cs[i] = [sum(column) // len(m) for column in zip(*m)]
    out = [(name, *near(x)[::-1]) for name, x in kept]
    own = defaultdict(int)
    for _, c, d in out:
        own[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((n, c, d, own[c], sum(own.values()), sha[c]) for n, c, d in out), key=repr)


def test_whole_table(spark, data, rows):
    vectors = table(spark, data, "embeddings")
    assert rows(centroids.clustered(vectors)) == _brute([(r[0], r[1]) for r in vectors.select("vec_id", "embedding").collect()])


def test_odd_vectors(spark, rows):
    """Nulls, wrong lengths, non-finite components, repeated rows and ids, ties, clashing columns."""
    flat = [float(i % 5) for i in range(64)]
    made = [(1, flat), (1, flat), (1, flat[::-1]), (None, flat), (2, None), (3, []), (4, flat[:-1]), (5, [None, *flat[1:]])]
    made += [(6, [math.nan, *flat[1:]]), (7, [math.inf, *flat[1:]]), (8, [-math.inf, *flat[1:]]), (9, [-0.001] * 64), (10, [0.001] * 64)]
    made += [(20 + i, [float((i * j) % 3) for j in range(64)]) for i in range(30)]
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in made], "vec_id bigint, embedding array<double>, cluster int, distance double, vector string")
    for k in (1, 7, 40):
        assert rows(centroids.clustered(df.repartition(3), k=k)) == _brute(made, k=k)
    assert centroids.clustered(df.limit(0)).collect() == []
    assert centroids.clustered(df.filter("vec_id = 3")).collect() == []


def test_components_beyond_the_limit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="beyond the limit"):
        centroids.clustered(df)


@pytest.mark.parametrize("size", [1, 300, 1 << 27])
def test_search_is_exact_and_skips(size):
    """Ties among equal centroids too; far fewer exact distances than all where sums differ."""
    draw = np.random.default_rng(size)
    cs = draw.integers(-size, size + 1, (40, 64)) + draw.integers(-size, size + 1, (40, 1))
    cs = np.clip(cs, -(1 << 27), 1 << 27)
    cs[7] = cs[3]
    xs = np.concatenate([cs, cs + draw.integers(-1, 2, cs.shape), draw.integers(-size, size + 1, (500, 64))])
    search = centroids.Search(cs)
    number, distance = search.nearest(xs)
    full = ((xs[:, None, :] - cs[None]) ** 2).sum(2)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert search.compared < full.size
