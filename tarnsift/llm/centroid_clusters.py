"""Centroid clustering in whole numbers, with most centroids screened out by bounds from block norms.

A vector of d components becomes whole numbers once and is written with a sketch: for each segment of SEGMENT
components its sum over the root of its length, and the norm of what the mean of the segment leaves over. By the
inequality of Cauchy and Schwarz, segment by segment, the squared distance of two sketches is at most that of the
vectors. A task visits the centroids of each vector by ascending bound and takes exact distances, in 64-bit whole
numbers, until the next bound is above the best; bounds are lowered by more than rounding can add to them, so that
ties and near ties are always decided exactly. A round is one narrow pass: each task returns one row of sums for each
centroid at most, which are added up by centroid. Centroids are the only thing that the driver holds (K rows).

Defined cases: vectors that are null, of another length, or with a null, a NaN or an infinite component are left out.
Components beyond +-LIMIT after scaling count as +-LIMIT, so that distances fit 64 bits; a sum of distances that does
not is null. With fewer than K vectors each starts a centroid. Rows without vec_id are assigned but start none; rows of
one vec_id start one each, in the order of their vectors. Repeated rows are rows of their own. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing

#: Components of a vector, centroids, rounds, scale, and the number that the starting hash begins with.
DIMS, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256.0, 2
SEGMENT = 8
LIMIT = 1 << 26
#: Share of the squared norms that bounds are lowered by; sketches are single precision, off by under a tenth of it.
SLACK = 1e-6


def sketches(x: np.ndarray) -> np.ndarray:
    """Per segment of each row: sum over root of length, norm of the rest. Their squares add up to those of the row."""
    n, d = x.shape
    size = SEGMENT if d % SEGMENT == 0 else d
    parts = x.reshape(n, d // size, size).astype(np.float64)
    sums = parts.sum(axis=2)
    rest = np.linalg.norm(parts - sums[:, :, None] / size, axis=2)
    return np.concatenate([sums / np.sqrt(size), rest], axis=1).astype(np.float32)


def nearest(x: np.ndarray, sketch: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each row (ties: the smaller), its squared distance, exact distances taken."""
    a, b = sketch.astype(np.float64), sketches(centroids).astype(np.float64)
    norms = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    bounds = norms - 2.0 * (a @ b.T) - SLACK * norms - 1.0
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1)
    best = np.full(len(x), np.iinfo(np.int64).max)
    near = np.full(len(x), len(centroids))
    rows, taken = np.arange(len(x)), 0
    for k in range(len(centroids)):
        rows = rows[bounds[rows, k] <= best[rows]]
        if not len(rows):
            break
        taken += len(rows)
        to = order[rows, k]
        gap = x[rows] - centroids[to]
        exact = (gap * gap).sum(axis=1)
        better = (exact < best[rows]) | ((exact == best[rows]) & (to < near[rows]))
        best[rows[better]], near[rows[better]] = exact[better], to[better]
    return near, best, taken


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _pack(dims: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip(np.floor(_matrix(batch.column("x"), dims, np.float64) * scale), -LIMIT, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _lists(x), _lists(sketches(x))], ["vec_id", "vector", "sketch"])

    return run


def _assigned(centroids: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = _matrix(batch.column("vector"), centroids.shape[1], np.int64)
    sketch = batch.column("sketch")
    near, distance, _ = nearest(x, _matrix(sketch, len(sketch.flatten()) // max(1, len(x)), np.float32), centroids)
    return x, near, distance


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row (cluster, n, sums) for each centroid that a task's vectors go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            x, near, _ = _assigned(centroids, batch)
            if len(x):
                by = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[by], prepend=-1))
                sums[near[by][first]] += np.add.reduceat(x[by], first, axis=0)
                n += np.bincount(near, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), _lists(sums[used])], ["cluster", "n", "sums"])

    return run


def _distances(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, near, distance = _assigned(centroids, batch)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def packed(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """(vec_id, vector, sketch) of the vectors that can be clustered."""
    x = F.col("embedding").cast("array<double>")
    whole = F.coalesce((F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.filter(whole).select("vec_id", x.alias("x")).mapInArrow(_pack(dims, scale), f"vec_id {kind}, vector array<int>, sketch array<float>")


def starts(table: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids."""
    named = table.filter(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector")
    return [r["vector"] for r in named.orderBy("hash", "vector").limit(k).collect()]


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of what went to each; those that got nothing stay."""
    dims = centroids.shape[1]
    parts = table.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of (vec_id, embedding)."""
    spark = vectors.sparkSession
    with releasing(spark):
        table = materialize(packed(vectors, dims, scale), "cluster-vectors")
        centroids = np.array(starts(table, k, seed), dtype=np.int64).reshape(-1, dims)
        for _ in range(rounds if len(centroids) else 0):
            centroids = moved(table, centroids)
        kind = vectors.schema["vec_id"].dataType.simpleString()
        found = table if len(centroids) else table.limit(0)
        found = materialize(found.mapInArrow(_distances(centroids), f"vec_id {kind}, cluster int, distance long"), "cluster-assigned", keep=True)
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    total = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, sums[j], total, names[j]) for j in sorted(sums)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
