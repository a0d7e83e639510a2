"""Centroid clustering of integer vectors with Drake's adaptive bounds: exact assignments, few distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove_written, written

STATE = "vec_id long, vector array<long>, cluster int, upper double, near array<int>, lower array<double>, rest double, distance long, scanned int"
#: Bounds are loosened by this part of what they are made of, so that rounding never certifies a wrong order.
SLACK = 1e-9
#: Components up to these have squared distances of 64 of them that doubles, and 64-bit integers, hold exactly.
EXACT_DOUBLE, EXACT_LONG = 1 << 22, 1 << 27


@dataclass(frozen=True)
class Clustering:
    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    scale: int = 256
    seed: str = "2:"


@dataclass
class Bounds:
    """State of some vectors: the centroid, the distance to it from above, and bounds from below on the distances to others."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray  # the nearest other centroids
    lower: np.ndarray  # bounds on their distances
    rest: np.ndarray  # bound on the distances to all centroids besides those

    @staticmethod
    def unknown(size: int, kept: int) -> Bounds:
        return Bounds(np.zeros(size, np.int32), np.full(size, np.inf), np.zeros((size, kept), np.int32), np.zeros((size, kept)), np.zeros(size))

    def move(self, drift: np.ndarray, kept: int) -> None:
        """Loosen by how far the centroids moved; bounds beyond `kept` go into the remainder."""
        self.upper = (self.upper + drift[self.cluster]) * (1 + SLACK)
        low = self.lower - drift[self.near]
        self.lower = low - SLACK * np.abs(self.lower)
        self.rest = self.rest - drift.max(initial=0) - SLACK * np.where(np.isfinite(self.rest), np.abs(self.rest), 0)
        if kept < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, kept:].min(axis=1))
            self.near, self.lower = self.near[:, :kept], self.lower[:, :kept]

    def needed(self) -> np.ndarray:
        """How many of the nearest centroids have to be scanned besides the own one; one more than are kept stands for all."""
        least = np.minimum.accumulate(np.concatenate((self.lower, self.rest[:, None]), axis=1)[:, ::-1], axis=1)[:, ::-1]
        certain = self.upper[:, None] < least
        return np.where(certain.any(axis=1), certain.argmax(axis=1), self.near.shape[1] + 1)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows (n, d) and centroids (k, d), or (n, q, d) of each row's own."""
    if centroids.ndim == 2:
        return (vectors * vectors).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (vectors @ centroids.T)
    gap = vectors[:, None, :] - centroids
    return (gap * gap).sum(2)


def assign(vectors: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Make `bounds` those of the nearest centroids (ties: the smaller number); gives how many centroids each row scanned.

    A row whose own centroid is certainly nearest stays. Others get the exact distance to their own one;
    if that doesn't certify it, the first so many of the kept ones are scanned, or all where the remainder
    isn't certified. Scanned ones are ordered anew and their bounds are exact again.
    """
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if largest > EXACT_LONG:
        raise ValueError("a component is too large for distances of 64 bits")
    kind = np.float64 if largest <= EXACT_DOUBLE else np.int64
    vectors, centroids = vectors.astype(kind), centroids.astype(kind)
    kept = bounds.near.shape[1]
    scanned = np.zeros(len(vectors), np.int32)
    open_ = np.flatnonzero(bounds.needed() > 0)
    sure = open_[np.isfinite(bounds.upper[open_])]
    own = squared(vectors[sure], centroids[bounds.cluster[sure]][:, None, :])[:, 0]
    bounds.upper[sure] = np.sqrt(own.astype(np.float64))
    scanned[sure] = 1
    need = np.zeros(len(vectors), np.int64)
    need[open_] = bounds.needed()[open_]
    for q in np.unique(need[need > 0]):
        rows = np.flatnonzero(need == q)
        if q <= kept:
            ids = np.concatenate((bounds.cluster[rows, None], bounds.near[rows, :q]), axis=1)
            found = squared(vectors[rows], centroids[ids])
        else:
            ids = np.broadcast_to(np.arange(len(centroids), dtype=np.int32), (len(rows), len(centroids)))
            found = squared(vectors[rows], centroids)
        order = np.lexsort((ids, found), axis=1)
        ids, found = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(found, order, 1).astype(np.float64))
        bounds.cluster[rows], bounds.upper[rows] = ids[:, 0], found[:, 0]
        held = min(q, kept)
        bounds.near[rows, :held], bounds.lower[rows, :held] = ids[:, 1 : held + 1], found[:, 1 : held + 1]
        if q > kept:
            bounds.rest[rows] = found[:, kept + 1] if found.shape[1] > kept + 1 else np.inf
        scanned[rows] = ids.shape[1]
    return scanned


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    size, width = values.shape
    return pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * np.int32(width), pa.array(values.reshape(-1), kind))


def _round(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, before: int, kept: int, last: bool) -> DataFrame:
    """One assignment; without `drift` nothing is known yet. Exact distances are given in the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            vectors = _matrix(column["vector"], centroids.shape[1], np.int64)
            if drift is None:
                bounds = Bounds.unknown(batch.num_rows, kept)
            else:
                flat = {k: column[k].to_numpy(zero_copy_only=False).copy() for k in ("cluster", "upper", "rest")}
                bounds = Bounds(flat["cluster"], flat["upper"], _matrix(column["near"], before, np.int32), _matrix(column["lower"], before, np.float64), flat["rest"])
                bounds.move(drift, kept)
            scanned = assign(vectors, centroids, bounds)
            gap = vectors - centroids[bounds.cluster] if last else np.zeros((batch.num_rows, 1), np.int64)
            columns = [column["vec_id"], column["vector"], pa.array(bounds.cluster, pa.int32()), pa.array(bounds.upper), _lists(bounds.near, pa.int32()), _lists(bounds.lower, pa.float64()), pa.array(bounds.rest), pa.array((gap * gap).sum(1), pa.int64()), pa.array(scanned, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "cluster", "upper", "near", "lower", "rest", "distance", "scanned"])

    return state.mapInArrow(run, STATE)


def _integers(vectors: DataFrame, rule: Clustering, id_col: str, vector_col: str) -> DataFrame:
    """Rows whose vectors are whole and finite, as integers floor(scale * component)."""
    as_double = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), as_double.alias("v")).filter((F.size("v") == rule.dimensions) & finite)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * rule.scale)).alias("vector"))


def _means(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The new centroids (empty ones stay), and the most kept bounds that a row of less than a full scan used.

    A task gives a row for each cluster and component; Spark sums them up.
    """
    size, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, used = np.zeros(size, np.int64), np.zeros((size, width), np.int64), 0
        for batch in batches:
            cluster, scanned = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("cluster", "scanned"))
            counts += np.bincount(cluster, minlength=size)
            np.add.at(sums, cluster, _matrix(batch.column("vector"), width, np.int64))
            used = max(used, int(scanned[scanned < size].max(initial=1)) - 1)
        cluster, place = np.divmod(np.arange(size * width, dtype=np.int32), width)
        columns = {"cluster": cluster, "place": place, "n": np.repeat(counts, width), "s": sums.reshape(-1), "used": np.full(size * width, used, np.int32)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    parts = state.select("cluster", "vector", "scanned").mapInArrow(run, "cluster int, place int, n long, s long, used int")
    rows = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("used").alias("used")).collect()  # a row for each component
    new = centroids.copy()
    for row in rows:
        if row["n"]:
            new[row["cluster"], row["place"]] = row["s"] // row["n"]
    return new, max((r["used"] for r in rows), default=0)


def cluster_vectors(vectors: DataFrame, rule: Clustering = Clustering(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is whole and finite.

    Components become floor(scale * x). The rows with the smallest SHA-256 of seed and id are the first
    centroids (rows of equal or null id in the order of their components, null ids last); fewer rows than
    clusters make fewer clusters. Every round assigns all vectors and moves each centroid to the floor of
    its mean. The state of a vector (its centroid, an upper bound, bounds on its nearest other centroids
    and one on the remainder) is a row of a table in the shared folder, written by each round in place of
    the last; only centroids, and sums with one row a cluster, come to the driver. After each round fewer
    bounds are kept if fewer were needed. Null, short, long or non-finite vectors have no row; repeated
    rows are vectors of their own; extra columns aren't read; an empty table gives an empty result. A
    component beyond 2 ** 27 after scaling raises an error, because its distances don't fit 64 bits.
    """
    spark = vectors.sparkSession
    state = written(_integers(vectors, rule, id_col, vector_col), "vectors")
    order = F.sha2(F.concat(F.lit(rule.seed), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    first = state.orderBy(order, "vector").limit(rule.clusters).select("vector").collect()  # at most `clusters` rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["vector"] for r in first], np.int64)
    kept = before = min(max(rule.clusters // 4, 1), len(centroids) - 1)
    drift = None
    for i in range(rule.rounds + 1):
        last = state
        state = written(_round(last, centroids, drift, before, kept, i == rule.rounds), "vector-state")
        remove_written(last)
        if i < rule.rounds:
            new, used = _means(state, centroids)
            drift = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
            centroids, before, kept = new, kept, min(kept, max(used, rule.clusters // 8))
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each cluster
    total = sum(r["cluster_inertia"] for r in sums)
    named = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
