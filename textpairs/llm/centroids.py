"""Centroid clustering of integer vectors by scalar lookup tables (operator 12).

Vectors with the right number of components, all finite, are turned into
integers ``floor(64 * x)``.  A round assigns every vector to its nearest
centroid (squared Euclidean distance, the smaller number on ties) and replaces
each centroid by the exact floor of its vectors' mean.

Distances are not computed component by component: for each dimension the
squared differences between every integer value that occurs there and every
centroid are tabulated, and a vector's distances are the sum of the rows that
its values pick from the tables.  Tables are made for the values of a slice of
an Arrow batch, so their size is bounded by the slice however wide the values
range: a dense span of values is indexed directly, a wide one through its
sorted distinct values.

Each round is one pass over the table.  A task adds up its vectors per centroid
and hands on at most ``k`` rows a batch; Spark adds those, and ``k`` sums of
``dim`` numbers reach the driver.  The table is never shuffled; a lost executor
costs its tasks only, as a pass depends on nothing but the table and ``k``
centroids.

Defined cases: a vector that is null, of another length, or holds a null, NaN or
infinity is left out; a component beyond +-2^27 after scaling counts as that
bound, so that every distance fits a long; sums of distances beyond a long
count as the greatest long; fewer than ``k`` vectors make as many centroids;
rows that repeat an id are vectors of their own, and as starts follow their
components; a null id comes last among the starts; an empty table (or one
without a usable vector) gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters.
K = 16
DIM = 64
ROUNDS = 3
SCALE = 64
SLICE_ROWS = 8192
DENSE_SPAN = 4096

_BOUND = 1 << 27
_LONG = (1 << 63) - 1


def integer_vectors(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """``(kept row numbers, their integer vectors)`` of an Arrow list column."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component becomes NaN
    good = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(values[good] * scale)
    return rows[good], np.clip(scaled, -_BOUND, _BOUND).astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids): squared distances, gathered from a table per dimension."""
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1]):
        own = vectors[:, d]
        low, high = int(own.min()), int(own.max())
        if high - low < DENSE_SPAN:
            values, at = np.arange(low, high + 1), own - low
        else:
            values, at = np.unique(own, return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        out += table[at]
    return out


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the smaller number on ties) and the squared distance."""
    apart = distances(vectors, centroids)
    nearest = apart.argmin(axis=1)
    return nearest, apart[np.arange(len(apart)), nearest]


def _slices(batch: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        rows, vectors = integer_vectors(part.column(1), dim, scale)
        if len(rows):
            yield part, rows, vectors


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: int) -> np.ndarray:
    """The ``k`` usable vectors with the smallest hash of their id, in that order."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows, whole in _slices(b, dim, scale):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(list(whole), pa.list_(pa.int64()))], names=["id", "v"])

    found = vectors.mapInArrow(usable, "id long, v array<long>")
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    top = found.orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in top], np.int64).reshape(-1, dim)


def _totals(vectors: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """``cluster -> (vectors, component sums, distance sum)`` of the assignment to these centroids."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, whole in _slices(b, dim, scale):
                nearest, apart = assign(whole, centroids)
                present = np.unique(nearest)
                sums = [whole[nearest == c].sum(axis=0) for c in present]
                far = [sum(apart[nearest == c].tolist()) for c in present]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present, pa.int32()), pa.array(np.bincount(nearest)[present], pa.int64()),
                     pa.array(sums, pa.list_(pa.int64())), pa.array([x >> 32 for x in far], pa.int64()),
                     pa.array([x & 0xFFFFFFFF for x in far], pa.int64())],
                    names=["cluster", "n", "sums", "far_high", "far_low"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>, far_high long, far_low long")
    exact = "decimal(38,0)"
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d)).cast(exact)) for d in range(dim)]).alias("sums"),
        F.sum(F.col("far_high").cast(exact)).alias("high"), F.sum(F.col("far_low").cast(exact)).alias("low"))
    return {r["cluster"]: (r["n"], [int(x) for x in r["sums"]], (int(r["high"]) << 32) + int(r["low"]))
            for r in added.collect()}  # at most k rows


def cluster_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
                    dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    centroids = first_centroids(vectors, k, dim, scale)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], (
            "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string, centroid array<long>"))
    for _ in range(rounds):
        for c, (n, sums, _) in _totals(vectors, centroids, scale).items():
            centroids[c] = [s // n for s in sums]
    last = _totals(vectors, centroids, scale)
    inertia = min(sum(x for _, _, x in last.values()), _LONG)
    of = pa.array([min(last.get(c, (0, [], 0))[2], _LONG) for c in range(len(centroids))], pa.int64())
    sha = pa.array([sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    whole = pa.array(centroids.tolist(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows, own in _slices(b, dim, scale):
                nearest, apart = assign(own, centroids)
                at = pa.array(nearest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(nearest, pa.int32()), pa.array(apart, pa.int64()),
                     of.take(at), pa.array(np.full(len(rows), inertia), pa.int64()), sha.take(at), whole.take(at)],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                   "centroid_sha256 string, centroid array<long>")
