"""Centroid clustering of whole-number vectors: distances by one matrix product a block, sums by treeAggregate.

|x|² - 2x·c + |c|² is exact in double precision while every partial sum stays below 2^53. Rows and centroids whose components
are small enough for that go through BLAS; the others are computed in 64-bit integers, and beyond those in Python's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

SCALE = 256
#: Vectors in a block: what a task holds at a time, as double 4 MB.
BLOCK = 8192
LONGEST = (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, v (array of double): rows with exactly `dim` components, none null or non-finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == dim)
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole(x: float) -> int:
    """floor(256 * x), exactly, whatever the size."""
    return int(np.floor(x * SCALE)) if abs(x) < 2.0**900 else int(x) * SCALE


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """kind, ids, missing, v (binary): blocks of vectors. Whole numbers as 'h' or 'i' (16 or 32 bits) if they fit, else the vectors as they are ('d')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, v = part["vec_id"], part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                large = np.abs(v).max(axis=1) >= 2.0**31 / SCALE - 1
                for some, kind in ((~large, ""), (large, "d")):
                    if some.any():
                        own = v[some] if kind else np.floor(v[some] * SCALE)
                        kind = kind or ("h" if np.abs(own).max() < 2**15 else "i")
                        mine = ids.filter(pa.array(some))
                        yield pa.RecordBatch.from_pydict(
                            {"kind": [kind], "ids": [mine.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], "missing": [mine.is_null().to_numpy(zero_copy_only=False).tobytes()], "v": [own.astype(f"<{ {'h': 'i2', 'i': 'i4', 'd': 'f8'}[kind]}").tobytes()]}
                        )

    return rows.mapInArrow(run, "kind string, ids binary, missing binary, v binary")


def unpacked(kind: str, v: bytes, dim: int) -> np.ndarray:
    """Whole numbers of a block: int64, or Python's integers where a row was too large."""
    if kind == "d":
        return np.array([[whole(x) for x in row] for row in np.frombuffer(v, "<f8").reshape(-1, dim).tolist()], object)
    return np.frombuffer(v, "<i2" if kind == "h" else "<i4").reshape(-1, dim).astype(np.int64)


def most(a: np.ndarray) -> int:
    return int(max(abs(int(a.min())), abs(int(a.max())))) if a.size else 0


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and c: by matrix product while 2^53 bounds every partial sum, else in integers."""
    reach = x.shape[1] * (most(x) + most(c)) ** 2
    if reach < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a**2).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b**2).sum(axis=1)[None]).astype(np.int64)
    kind = np.int64 if reach < 1 << 63 else object
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def assigned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the smaller number, and the squared distance. Large centroids are computed apart,
    so that one of them leaves the others to the matrix product."""
    every = np.array(centroids, object)
    near = np.array([max(map(abs, c)) < 1 << 22 for c in centroids])
    out = np.empty((len(x), len(centroids)), object if not near.all() or x.dtype == object else np.int64)
    for some in (near, ~near):
        if some.any():
            out[:, some] = squared(x, every[some].astype(np.int64) if near[some].all() else every[some])
    best = out.argmin(axis=1)
    return best, out[np.arange(len(x)), best]


def sums_of(x: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each cluster, as Python's integers; by matrix product while 2^53 bounds it."""
    if x.dtype != object and len(x) * most(x) < 1 << 53:
        member = (best == np.arange(k)[:, None]).astype(np.float64)
        return (member @ x.astype(np.float64)).astype(np.int64).astype(object)
    out = np.zeros((k, x.shape[1]), object)
    for i in range(k):
        out[i] = x[best == i].astype(object).sum(axis=0) if (best == i).any() else 0
    return out


def totals(blocks: DataFrame, centroids: list[list[int]], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and squared distances of each cluster; combined by treeAggregate, k rows a task."""
    k = len(centroids)
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def add(total: tuple | None, row) -> tuple:
        x = unpacked(row.kind, row.v, dim)
        best, distance = assigned(x, shared.value)
        inertia = np.array([int(distance[best == i].astype(object).sum()) for i in range(k)], object)
        return join(total, (np.bincount(best, minlength=k).astype(object), sums_of(x, best, k), inertia))

    def join(a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else tuple(p + q for p, q in zip(a, b, strict=True))

    found = blocks.rdd.treeAggregate(None, add, join)
    return found or (np.zeros(k, object), np.zeros((k, dim), object), np.zeros(k, object))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of vectors (vec_id, embedding) of `dim` components.

    Components become floor(256 * x). The k rows with the smallest SHA-256 of `seed:vec_id` are the first centroids (equal
    ids: smaller vectors first; null ids last). Each round moves every centroid that has vectors to their mean, cut down to
    whole numbers; then vectors are assigned once more. Rows with another number of components, or with null or non-finite
    ones, are left out; repeated rows count as often as they stand; fewer than k rows are as many centroids. An empty table
    gives no rows. Distances and sums are exact; one beyond a long is given as the largest long.

    Vectors are packed and written once; each round reads them, and the driver holds k centroids and their sums.
    """
    small_batches(vectors.sparkSession)
    rows = kept(vectors, dim)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), "v").limit(k).collect()
    centroids = [[whole(x) for x in r.v] for r in first]
    blocks = written(packed(rows, dim), "blocks")
    if not centroids:
        return blocks.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        count, total, _ = totals(blocks, centroids, dim)
        centroids = [[int(s) // int(n) for s in own] if n else c for n, own, c in zip(count, total, centroids, strict=True)]
    inertia = totals(blocks, centroids, dim)[2]
    told = [(min(int(i), LONGEST), min(int(inertia.sum()), LONGEST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in zip(inertia, centroids, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, ids, missing, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best, distance = assigned(unpacked(kind, v, dim), centroids)
                own = [told[b] for b in best]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(missing, bool)), pa.array(best.astype(np.int32)), pa.array([min(int(d), LONGEST) for d in distance], pa.int64()),
                        pa.array([o[0] for o in own], pa.int64()), pa.array([o[1] for o in own], pa.int64()), pa.array([o[2] for o in own]),
                    ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(run, RESULT)
