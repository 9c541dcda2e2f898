"""Exact centroid clustering of integer vectors by annulus search.

Distances obey the triangle inequality: a centroid nearer to x than some bound u has a norm between |x| - u and
|x| + u. With centroids in the order of their norms, the candidates of a vector are one stretch of that order,
found by two binary searches; u is the distance to the centroid that the vector had in the round before (at first
to the one with the nearest norm). Candidates are compared by exact whole numbers, both ends of the stretch included,
so ties go to the smaller number as if all had been compared.

A round reads each vector once and writes it with its centroid; each task ends with one row a cluster that holds
its counts and sums, so a hot cluster is added up before anything is gathered. The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import lent, remove, small_batches, written

#: Components beyond this cannot give distances that fit a long; such vectors are left out like non-finite ones.
LARGEST = 1 << 27

_STATE = "vec_id long, v binary, cluster int, distance long, n long, sums array<long>, inertia decimal(38,0)"


def _usable(vector: Column, dims: int, scale: float) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & whole, F.lit(False))


def _points(vectors: DataFrame, dims: int, scale: float) -> DataFrame:
    at = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", at.alias("embedding")).where(_usable(F.col("embedding"), dims, scale))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("int")).alias("point"))


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.number], centroids[self.number]
        self.rank = np.argsort(self.number)

    def nearest(self, x: np.ndarray, hint: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid, ties to the smaller number; how many distances it took."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        if hint is None:
            right = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
            left = np.maximum(right - 1, 0)
            first = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        else:
            first = self.rank[hint]
        best, found = self._distance(x, first), self.number[first]
        bound = np.sqrt(best.astype(np.float64)) * (1 + 1e-12) + 1e-9 * (1 + norm)
        low, high = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        took = len(x)
        for step in range(int((high - low).max(initial=0))):
            rows = np.flatnonzero((low + step < high) & (low + step != first))
            at = low[rows] + step
            far = self._distance(x[rows], at)
            nearer = (far < best[rows]) | (far == best[rows]) & (self.number[at] < found[rows])
            rows, at = rows[nearer], at[nearer]
            best[rows], found[rows] = far[nearer], self.number[at]
            took += len(nearer)
        return found, best, took

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        off = x - self.sorted[at]
        return np.einsum("ij,ij->i", off, off)


def _round(batches: Iterator[pa.RecordBatch], held, dims: int, count: int) -> Iterator[pa.RecordBatch]:
    centroids = Annulus(held.value)
    size, sums, inertia = np.zeros(count, np.int64), np.zeros((count, dims), np.int64), [0] * count
    kinds = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.decimal128(38, 0))])
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        if "point" in batch.schema.names:
            raw, hint = batch["point"].flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(rows, dims), None
            packed = pa.array([x.tobytes() for x in raw], pa.binary())
        else:
            packed = batch["v"]
            raw, hint = np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(rows, dims), batch["cluster"].to_numpy()
        x = raw.astype(np.int64)
        found, far, _ = centroids.nearest(x, hint)
        np.add.at(size, found, 1)
        np.add.at(sums, found, x)
        for c in np.unique(found):
            inertia[c] += sum(far[found == c].tolist())
        nothing = [None] * rows
        yield pa.RecordBatch.from_arrays([batch["vec_id"], packed, pa.array(found, pa.int32()), pa.array(far, pa.int64()), pa.array(nothing, pa.int64()), pa.array(nothing, kinds.field("sums").type), pa.array(nothing, pa.decimal128(38, 0))], schema=kinds)
    full = np.flatnonzero(size)
    if len(full):
        nothing = [None] * len(full)
        yield pa.RecordBatch.from_arrays([pa.array(nothing, pa.int64()), pa.array(nothing, pa.binary()), pa.array(full, pa.int32()), pa.array(nothing, pa.int64()), pa.array(size[full]), pa.array([x.tolist() for x in sums[full]], kinds.field("sums").type), pa.array([inertia[c] for c in full], pa.decimal128(38, 0))], schema=kinds)


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row of a table (vec_id, embedding).

    A usable vector has `dims` components, none null, NaN, infinite or, scaled, at or beyond LARGEST; it becomes the
    floors of its scaled components. The first centroids are those k with the smallest sha256 of `seed:vec_id`, in that
    order (rows of one id: by their components). Each round hands all vectors to their nearest centroid and sets it to the
    floors of its vectors' means; then all are handed out once more. With fewer than k usable vectors, each is a centroid;
    with none the result is empty. Rows without an id are clustered but are no first centroids; repeated rows
    count each time; further columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    points = _points(vectors, dims, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id is not null").select(hashed.alias("h"), "point").orderBy("h", "point").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["point"] for r in sorted(first, key=lambda r: (r["h"], r["point"]))], np.int64)
    state, count = points, len(centroids)
    for turn in range(rounds + 1):
        columns = ["vec_id", "point"] if state is points else ["vec_id", "v", "cluster"]
        given = state if state is points else state.where("n is null")
        with lent(spark, centroids) as held:
            after = written(given.select(columns).mapInArrow(lambda batches, h=held: _round(batches, h, dims, count), _STATE), "clusters")
        if state is not points:
            remove(spark, state.plotwise_path)
        state = after
        totals = _totals(state, dims)
        if turn < rounds:
            for c, n, sums, _ in totals:
                centroids[c] = [s // n for s in sums]
    whole = sum(int(t[3]) for t in totals)
    report = [(c, int(i), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, _, _, i in totals]
    facts = spark.createDataFrame(report, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.where("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _totals(state: DataFrame, dims: int) -> list[tuple]:
    """Cluster, count, sums and inertia of every cluster that has vectors: k rows, from one row a task and cluster."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = state.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *sums).collect()
    return [(r["cluster"], int(r["n"]), [int(r[f"s{i}"]) for i in range(dims)], r["inertia"]) for r in rows]
