"""Clustering around centroids with Drake's adaptive bounds.

Each vector carries an upper bound of the distance to its centroid, lower bounds of the distances to its next nearest
ones, in their order, and one lower bound for all others. When centroids have moved, bounds move by as much; a vector
whose upper bound is below every lower one keeps its cluster unread. Else its own distance is told exactly, then those
of the listed centroids that the bounds cannot rule out, and all distances only if the bound of the others doesn't
hold either. Bounds are rounded away from certainty, so equal distances are always told exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import operator, pick, saved

#: Lower bounds that a vector keeps of single centroids; the others share one.
LISTED = 4
#: Components are whole numbers below this in magnitude, so that squared distances of 64 of them fit a long.
LARGEST = 1 << 27
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12

STATE = "vec_id long, v array<int>, cluster int, was int, upper double, listed array<int>, lower array<double>, rest double, read int"
_STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("was", pa.int32()), ("upper", pa.float64()), ("listed", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())), ("rest", pa.float64()), ("read", pa.int32())])


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v and of c, pairwise by broadcasting."""
    d = v - c
    if d.size and max(int(d.max()), -int(d.min())) < 1 << 22:  # 64 squares below 2^44 add up exactly
        d = d.astype(np.float64)
        return np.einsum("...i,...i->...", d, d).astype(np.int64)
    return np.einsum("...i,...i->...", d, d)


def _ranked(v: np.ndarray, centroids: np.ndarray, listed: int):
    """All distances: cluster, upper, listed, lower, rest of each vector."""
    d = np.stack([squared(v, c) for c in centroids], 1)
    order = np.argsort(d, 1, kind="stable")  # ties to the smaller number
    roots = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    k = order.shape[1]
    rest = roots[:, listed + 1] * _DOWN if k > listed + 1 else np.full(len(v), np.inf)
    return order[:, 0], roots[:, 0] * _UP, order[:, 1 : listed + 1], roots[:, 1 : listed + 1] * _DOWN, rest


def reassigned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, centroids: np.ndarray, moved: np.ndarray):
    """The state of vectors after centroids moved by `moved`; centroids: where they are now. The last value is how many
    distances each vector took."""
    cluster, near, read = cluster.copy(), near.copy(), np.zeros(len(v), np.int32)
    upper = (upper + moved[cluster]) * _UP
    lower = lower - moved[near] * _UP
    # One bound for the others, less the farthest that any of them may have come.
    rest = rest - moved.max() * _UP
    floor = np.minimum(np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1], rest[:, None]) if near.shape[1] else np.empty((len(v), 0))
    least = floor[:, 0] if near.shape[1] else rest
    open_ = np.flatnonzero(upper >= least)
    if len(open_):
        upper[open_] = np.sqrt(squared(v[open_], centroids[cluster[open_]]).astype(np.float64)) * _UP
        read[open_] += 1
        open_ = open_[upper[open_] >= least[open_]]
    full = open_[upper[open_] >= rest[open_]]
    some = open_[upper[open_] < rest[open_]]
    if len(some):
        # Listed centroids up to the last one that the bounds of it and all behind it don't rule out.
        floors = floor[some]
        many = (upper[some][:, None] >= floors).sum(1)
        for q in np.unique(many):
            at = some[many == q]
            who = np.concatenate([cluster[at][:, None], near[at, :q]], 1)
            d = np.stack([squared(v[at], centroids[who[:, j]]) for j in range(q + 1)], 1)
            order = np.lexsort((who, d), axis=1)
            who, d = np.take_along_axis(who, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            cluster[at], upper[at] = who[:, 0], d[:, 0] * _UP
            near[at, :q], lower[at, :q] = who[:, 1:], d[:, 1:] * _DOWN
            read[at] += q
    if len(full):
        cluster[full], upper[full], near[full], lower[full], rest[full] = _ranked(v[full], centroids, near.shape[1])
        read[full] += len(centroids)
    return cluster, upper, near, lower, rest, read


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)


def _batch(ids, v, cluster, was, upper, near, lower, rest, read) -> pa.RecordBatch:
    def lists(x, kind):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))

    cols = [ids, v, pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), lists(near.astype(np.int32), pa.int32()), lists(lower, pa.float64()), pa.array(rest), pa.array(read.astype(np.int32))]
    return pa.RecordBatch.from_arrays(cols, schema=_STATE)


def _first(centroids: np.ndarray, listed: int):
    def task(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), centroids.shape[1], np.int64)
                cluster, upper, near, lower, rest = _ranked(v, centroids, listed)
                yield _batch(b.column(0), b.column(1), cluster, np.full(len(v), -1), upper, near, lower, rest, np.full(len(v), len(centroids)))

    return task


def _next(centroids: np.ndarray, moved: np.ndarray, listed: int):
    def task(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), centroids.shape[1], np.int64)
                was, upper, rest = (b.column(i).to_numpy() for i in (2, 4, 7))
                out = reassigned(v, was, upper, _matrix(b.column(5), listed, np.int64), _matrix(b.column(6), listed, np.float64), rest, centroids, moved)
                yield _batch(b.column(0), b.column(1), out[0], was, *out[1:])

    return task


def _moves(k: int, dims: int):
    """What vectors that changed their cluster bring to it and take from the one they left: cluster, dim, total; dim -1 counts."""

    def task(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            if b.num_rows:
                v = np.concatenate([_matrix(b.column(0), dims, np.int64), np.ones((b.num_rows, 1), np.int64)], 1)
                for column, sign in ((b.column(1), 1), (b.column(2), -1)):
                    at = column.to_numpy()
                    for c in np.unique(at[at >= 0]):
                        total[c] += sign * v[at == c].sum(0)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d])], names=["cluster", "dim", "total"])

    return task


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the vector's components times scale, rounded down; see clusters() for those left out."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("x"))
    fit = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (x >= -LARGEST) & (x < LARGEST), F.lit(False)))
    return rows.where((F.size("x") == dims) & fit).select("vec_id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))


def seeds(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of the seed, a colon and vec_id; rows that repeat an id by their components."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.orderBy(key, "v").limit(k).select("v").collect()], np.int64)


@operator
def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, listed: int = LISTED, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components) and read (distances that the last
    assignment took) of each vector with exactly `dims` components.

    Components are times `scale`, rounded down. Vectors that are null, have another length, hold a null or non-finite
    component, or one whose scaled value is 2^27 or more in magnitude (a squared distance would fit no long) take no part.
    Rows that repeat an id are vectors of their own; a null vec_id counts as the empty text where seeds are chosen. Fewer
    than k vectors are all centroids; no vector gives an empty result. Other columns are left out whatever their names.
    The driver holds centroids and their sums (k times dims) alone.
    """
    spark = vectors.sparkSession
    kept = saved(whole_vectors(vectors, dims, scale), "vectors")
    centroids = seeds(kept, k, seed)
    k = len(centroids)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>, read int"
    if not k:
        return spark.createDataFrame([], out)
    listed = min(listed, k - 1)
    state = saved(kept.mapInArrow(_first(centroids, listed), STATE), "clusters")
    sums = np.zeros((k, dims + 1), np.int64)
    for _ in range(rounds):
        changed = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_moves(k, dims), "cluster int, dim int, total long")
        for r in changed.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect():  # k times dims rows
            sums[r.cluster, r.dim] += r.total
        full = sums[:, dims] > 0
        after = centroids.copy()
        after[full] = sums[full, :dims] // sums[full, dims:]
        moved = np.sqrt(squared(after, centroids).astype(np.float64)) * _UP
        centroids = after
        state = saved(state.mapInArrow(_next(centroids, moved, listed), STATE), "clusters")

    def told(batches):
        for b in batches:
            at = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(squared(_matrix(b.column(3), dims, np.int64), centroids[at])), b.column(2)], names=["vec_id", "read", "distance", "cluster"])

    exact = state.select("vec_id", "read", "cluster", "v").mapInArrow(told, "vec_id long, read int, distance long, cluster int")
    per = {r.cluster: r.d for r in exact.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    total = sum(per.values())
    known = spark.createDataFrame([(c, per.get(c, 0), total, centroids[c].tolist()) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return exact.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "read")

