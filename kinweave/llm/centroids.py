"""K-means over integer vectors, each assigned by an equal-average equal-variance nearest-neighbour search.

* Components become integers ``floor(scale * x)``, so that distances, sums and centroids are exact and the same whatever
  the order in which tasks add them up.
* Centroids are sorted by the sum of their components. The search of a vector starts beside its own sum and goes outward
  in both directions. With ``n`` components, sums ``S`` and spreads ``D = sqrt(n * sum((x - S / n) ** 2))``,
  ``n * distance >= (S_x - S_c) ** 2 + (D_x - D_c) ** 2``: the first term alone ends a direction, both together reject a
  centroid. The bounds are floating-point numbers with a margin for their rounding; what passes is compared by its exact
  integer distance. Equal distances go to the smaller centroid number.
* A round is one pass over the vectors: tasks hand on one line of sums per centroid, Spark adds them, and the driver holds
  ``k`` centroids. Nothing is shuffled by centroid or by vector, so large clusters and repeated vectors are no skew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import map_batches
from kinweave.sources.shared import SharedTable, materialise

#: Distances between vectors of up to 64 such components fit a long.
LIMIT = 1 << 27
#: Share of the squared lengths by which bounds must exceed a distance to reject.
_MARGIN = 1e-9


class Search:
    """Nearest centroids of many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.order = np.lexsort((np.arange(len(centroids)), centroids.sum(1)))
        self.sorted = centroids[self.order].astype(np.int64)
        self.sums = self.sorted.sum(1)
        self.spreads, self.lengths = _spread(self.sorted)
        #: Exact distances worked out so far.
        self.compared = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid numbers and squared distances of the rows of an integer matrix."""
        n, dim, k = len(vectors), vectors.shape[1], len(self.sorted)
        sums, (spreads, lengths) = vectors.sum(1), _spread(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        start = np.searchsorted(self.sums, sums)
        searching = {1: np.arange(n), -1: np.arange(n)}
        for step in range(k):
            for way in (1, -1):
                rows = searching[way]
                at = start[rows] + step if way == 1 else start[rows] - 1 - step
                inside = (at >= 0) & (at < k)
                rows, at = rows[inside], at[inside]
                limit = dim * (best[rows].astype(float) + _MARGIN * (1 + lengths[rows] + self.lengths[at]))
                mean = (sums[rows] - self.sums[at]).astype(float) ** 2
                open_ = mean <= limit
                rows, at, mean, limit = rows[open_], at[open_], mean[open_], limit[open_]
                searching[way] = rows
                near = mean + (spreads[rows] - self.spreads[at]) ** 2 <= limit
                rows, at = rows[near], at[near]
                self.compared += len(rows)
                distance = ((vectors[rows] - self.sorted[at]) ** 2).sum(1)
                names = self.order[at]
                better = (distance < best[rows]) | ((distance == best[rows]) & (names < number[rows]))
                best[rows[better]], number[rows[better]] = distance[better], names[better]
            if not len(searching[1]) and not len(searching[-1]):
                break
        return number, best


def _spread(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``D`` of each row, and its squared length."""
    dim = vectors.shape[1]
    centred = vectors - vectors.sum(1, keepdims=True) / dim
    return np.sqrt(dim * (centred**2).sum(1)), (vectors.astype(float) ** 2).sum(1)


def whole_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, vector``: rows with exactly ``dim`` components, none null or non-finite, as integers ``floor(scale * x)``.

    Repeated rows and ids stay, a null id too. A component beyond ``LIMIT`` is an error, as no long may hold distances."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.transform(F.col(embedding), lambda v: v.cast("double")).alias("x"))
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    kept = rows.filter(F.coalesce((F.size("x") == dim) & finite, F.lit(False)))
    beyond = F.raise_error(F.lit("component beyond the limit")).cast("int")
    # The double is compared before it is cast, so that no cast can overflow.
    whole = F.transform("x", lambda v: F.when(F.abs(v) * scale > LIMIT, beyond).otherwise(F.floor(v * scale).cast("int")))
    return kept.select("vec_id", whole.alias("vector"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with smallest SHA-256 of ``seed:vec_id``, in that order; of equal ids (a null id is like an empty
    text) the smaller vectors first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r[0] for r in whole.orderBy(name, "vector").limit(k).select("vector").collect()], np.int64)


def _matrix(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(whole: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Number and sum of the vectors of each centroid that has any."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Search(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            vectors = _matrix(batch, 0, dim)
            number, _ = search.nearest(vectors)
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(vectors[order], first, axis=0)
                counts += np.bincount(number, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    partial = whole.select("vector").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    long = partial.select("cluster", "n", F.posexplode("sums").alias("position", "part"))
    totals = long.groupBy("cluster", "position").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for row in totals:  # k times dim lines
        n, total = out.setdefault(row["cluster"], (row["n"], np.zeros(dim, np.int64)))
        total[row["position"]] = row["total"]
    return out


def fit(whole: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """Centroids after ``rounds`` rounds: every vector goes to the nearest one, and each that has vectors becomes their
    componentwise floor(sum / count). Fewer than ``k`` vectors: as many centroids. None: an empty array."""
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for cluster, (n, total) in _sums(whole, centroids).items():
            centroids[cluster] = total // n
    return centroids


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every row of ``vec_id, vector``."""
    schema = T.StructType([whole.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    search = Search(centroids)

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        yield [batch.column(0), *search.nearest(_matrix(batch, 1, centroids.shape[1]))]

    return map_batches(whole.select("vec_id", "vector"), of_batch, schema)


def clustered(vectors: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256, **columns: str) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every row that ``whole_vectors`` keeps.

    The two inertias are sums of distances, over the cluster and over all; the digest is of the cluster's last centroid,
    its components joined by commas. No rows, or none with whole vectors: no rows.
    """
    whole = materialise(whole_vectors(vectors, dim=dim, scale=scale, **columns), "vectors")
    centroids = fit(whole.df, k=k, rounds=rounds, seed=seed)
    assigned: SharedTable = materialise(assign(whole.df, centroids), "assigned")
    whole.drop()
    own = {r[0]: r[1] for r in assigned.df.groupBy("cluster").agg(F.sum("distance")).collect()}  # k lines
    lines = [(c, d, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(own.items())]
    named = assigned.df.sparkSession.createDataFrame(lines, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.df.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
