"""Centroid clustering in whole numbers, with Ptolemy's inequality over pivot pairs to leave out centroids.

Vectors are put on a grid of integers. Distances of every vector to a few fixed pivots are
worked out once and kept beside it. In a round the distances of the centroids to the pivots
are known as well, and for each pair of pivots p, q

    d(x, c) * d(p, q)  >=  | d(x, p) * d(c, q)  -  d(x, q) * d(c, p) |,

so the largest such bound over the pairs tells which centroids cannot be nearest. Bounds are
rounded downwards by more than doubles can err; what they leave is compared in exact integers,
so the result is that of a comparison with every centroid. Rows meet only as sums for each
centroid, made in each task before the shuffle; a hot cluster is a sum like any other.

Defined results: a vector that is null, of another length, or holds nulls, NaN or infinities
is left out. Equal rows are vectors of their own, each in the result. A null id hashes like an empty one. Start vectors
whose ids tie go by their components. Fewer vectors than centroids: as many centroids as vectors. Equal distances: the
smaller number. An empty centroid stays where it is. An empty table gives an empty result. Other columns,
whatever their names, are not read. A component above 2**21 is an error, since the squared distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweave.llm.common import cut, passing
from cardweave.llm.vectors import finite, matrix, packed

#: Pivots, and of how many vectors (the first by hash) they are the farthest from each other. The bounds hold for any pivots.
PIVOTS, AMONG = 8, 256
#: Relative errors of the bounds' doubles stay below a tenth of this.
SLACK = 64 * np.finfo(np.float64).eps
#: Rows compared at a time.
BLOCK = 2048
LARGEST = 2.0**21


def grid(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors with ``dim`` finite components, each component floor(scale * component)."""
    fit = vectors.filter(finite(vector_col) & (F.size(vector_col) == dim))
    too_large = F.raise_error(F.lit("a component is too large for squared distances that fit a long"))

    def step(c):
        c = c.cast("double")
        return F.when(F.abs(c) >= LARGEST, too_large.cast("long")).otherwise(F.floor(c * F.lit(float(scale))))

    return fit.select(F.col(id_col).alias("id"), F.transform(vector_col, step).alias("x"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that belong together."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, as doubles next to the exact roots."""
    return np.stack([np.sqrt(_squares(x, p[None, :]).astype(np.float64)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 0))


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those before; never two at one place."""
    if not len(sample):
        return sample
    chosen, near = [0], _squares(sample, sample[:1])
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _squares(sample, sample[chosen[-1]][None, :]))
    return sample[chosen]


def lower_bounds(to_pivots: np.ndarray, of_centroids: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each vector and centroid a number not above their distance (Ptolemy's inequality over all pivot pairs)."""
    out = np.zeros((len(to_pivots), len(of_centroids)))
    for p in range(between.shape[0]):
        for q in range(p):
            a, b = to_pivots[:, p, None] * of_centroids[None, :, q], to_pivots[:, q, None] * of_centroids[None, :, p]
            np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / (between[p, q] * (1 + SLACK)), out=out)
    return out


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each vector, and how many distances were worked out for that."""
    of_centroids, between = pivot_distances(centroids, pivots), pivot_distances(pivots, pivots)
    cluster, distance, tried = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), 0
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        low = lower_bounds(to_pivots[at : at + BLOCK], of_centroids, between)
        rows, first = np.arange(len(part)), low.argmin(1)
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        exact[rows, first] = best = _squares(part, centroids[first])
        left = low * low * (1 - SLACK) <= best[:, None].astype(np.float64) * (1 + SLACK)
        left[rows, first] = False
        r, c = np.nonzero(left)
        exact[r, c] = _squares(part[r], centroids[c])
        cluster[at : at + BLOCK] = exact.argmin(1)  # the first of equal ones
        distance[at : at + BLOCK] = exact.min(1)
        tried += len(part) + len(r)
    return cluster, distance, tried


def _with_pivots(points: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            far = pivot_distances(x, pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary())], ["id", "x", "far"])

    return points.mapInArrow(keep, f"id {points.schema['id'].dataType.simpleString()}, x binary, far binary")


def _sums(points: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors nearest to each centroid."""
    k, dim = centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = packed(b.column(0), "<i4", dim).astype(np.int64)
            cluster = nearest(x, packed(b.column(1), np.float64, len(pivots)), centroids, pivots)[0]
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array([total[i].tolist() for i in some], pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = points.select("x", "far").mapInArrow(part, "cluster int, n long, s array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(dim))).alias("s"))
    return {r["cluster"]: (r["n"], [int(v) for v in r["s"]]) for r in added.collect()}  # a row for each centroid


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every vector, the final centroids).

    Start: the ``k`` vectors with the smallest SHA-256 of salt + id. Each round assigns
    every vector and moves each centroid to the floor of its vectors' mean.
    """
    spark = vectors.sparkSession
    points = grid(vectors, dim, scale, id_col, vector_col)
    by_hash = points.withColumn("h", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    sample = np.array([r["x"] for r in by_hash.orderBy("h", "x").limit(max(k, AMONG)).collect()], np.int64).reshape(-1, dim)
    if not len(sample):
        return spark.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, cluster int, distance long"), []
    centroids, pivots = sample[:k], choose_pivots(sample)
    with passing():
        kept = cut(_with_pivots(points, pivots, dim))
        for _ in range(rounds):
            centroids = centroids.copy()
            for c, (n, s) in _sums(kept, centroids, pivots).items():
                centroids[c] = [v // n for v in s]

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cluster, distance, _ = nearest(packed(b.column(1), "<i4", dim).astype(np.int64), packed(b.column(2), np.float64, len(pivots)), centroids, pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

        out = cut(kept.mapInArrow(last, f"id {points.schema['id'].dataType.simpleString()}, cluster int, distance long"), outlive=True)
    return out, centroids.tolist()


def cluster_digest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors with their cluster, squared distance, the distances' sums, and a hash of the cluster's centroid."""
    found, centroids = cluster_vectors(vectors, id_col=id_col, vector_col=vector_col)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    total = sum(sums.values())
    rows = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(sums.items())]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
