"""Centroid clustering (operator 12): |x|^2 - 2 x.c + |c|^2 by blocked matrix products, exact.

Components become whole numbers floor(scale * x). Vectors are written once as blocks of rows, packed whole numbers in one binary column, and every
round reads these blocks. A round is one treeAggregate over the RDD of blocks: a block's distances are one product of float64 matrices, and counts and
componentwise sums of each cluster go up the tree. Nothing else reaches the driver: sums of k times the dimension.

A product of float64 matrices is exact in any order of adding as long as no partial sum reaches 2^53, which d (max|x| + max|c|)^2 bounds. Each block
is judged by its own greatest component: what stays below the bound goes to BLAS, what stays below 2^63 is added in 64-bit integers, and the rest in
Python's whole numbers. Rows with components beyond 2^62 are packed as decimal text, in blocks of their own.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite component take no part. Rows without vec_id are
clustered, and come last among the first centroids. Rows that share a vec_id are clustered each by its own vector; among them the first centroids go by
the vectors' order. With fewer rows than k, there are as many centroids as rows. Ties go to the smaller number; an empty cluster keeps its centroid.
Distances and inertias beyond a long come out as its greatest value. An empty table gives an empty result. Other columns are ignored.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, written

K, ROUNDS, DIMENSION, SCALE = 16, 3, 64, 64
BLOCK = 4096  # rows of a block
EXACT, LONG = 1 << 53, (1 << 63) - 1
WIDE = 1 << 62
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly: a double of that size is a whole number, whose product may be no finite double."""
    return int(x) * scale if abs(x) >= EXACT else math.floor(x * scale)


def packed(d: int, scale: int):
    """(vec_id, v) to blocks: ids, n, wide (decimal text instead of packed whole numbers), values."""

    def block(ids: pa.Array, wide: bool, values: bytes) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, pa.array([len(ids)], pa.int32()), pa.array([wide]), pa.array([values], pa.binary())], ["ids", "n", "wide", "values"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                ids, v = batch.column(0).slice(i, BLOCK), batch.column(1).slice(i, BLOCK)
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
                big = (np.abs(x) * scale >= WIDE).any(1)
                narrow = np.floor(x[~big] * scale).astype(np.int64)
                if len(narrow):
                    yield block(ids.filter(pa.array(~big)), False, narrow.tobytes())
                if big.any():
                    rows = "\n".join(",".join(str(whole(y, scale)) for y in row) for row in x[big].tolist())
                    yield block(ids.filter(pa.array(big)), True, rows.encode())

    return run


def unpacked(n: int, wide: bool, values: bytes) -> np.ndarray:
    """The matrix of a block: int64, or Python's whole numbers where they are wide."""
    if wide:
        return np.array([[int(y) for y in row.split(",")] for row in values.decode().split("\n")], object).reshape(n, -1)
    return np.frombuffer(values, np.int64).reshape(n, -1)


def greatest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from those of c: float64, int64 or Python's whole numbers, as the bound demands."""
    bound = x.shape[1] * (greatest(x) + greatest(c)) ** 2
    if bound < EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)
    elif bound <= LONG:
        x, c = x.astype(np.int64), c.astype(np.int64)
    else:
        x, c = x.astype(object), c.astype(object)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the nearest rows of c, and the distance from it, of each row of x."""
    d = distances(x, c)
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(d)), at]


def totals(x: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Sums of x (whole numbers) by group as Python's whole numbers, k rows."""
    out = np.zeros((k, x.shape[1]), object)
    order = np.argsort(groups, kind="stable")
    have, first = np.unique(groups[order], return_index=True)
    if len(have):
        exact = x if greatest(x) * len(x) <= LONG else x.astype(object)
        out[have] = np.add.reduceat(exact[order], first, axis=0).astype(object)
    return out


def rounds_of(blocks: DataFrame, c: np.ndarray, inertia: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of each cluster of one assignment: componentwise, or with inertia of the distances. One treeAggregate."""
    k = len(c)
    sent = blocks.sparkSession.sparkContext.broadcast(c)

    def add(have, row):
        x = unpacked(row["n"], row["wide"], bytes(row["values"]))
        at, d = nearest(x, sent.value)
        if inertia:
            x = (d if d.dtype == object else d.astype(np.int64))[:, None]
        n, sums = np.bincount(at, minlength=k), totals(x, at, k)
        return (n, sums) if have is None else (have[0] + n, have[1] + sums)

    def join(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    out = blocks.select("n", "wide", "values").rdd.treeAggregate(None, add, join)
    sent.unpersist()
    return (np.zeros(k, np.int64), np.zeros((k, 1 if inertia else c.shape[1]), object)) if out is None else out


def moved(c: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' mean, or where they were if they have none."""
    new = c.astype(object)
    for j in np.flatnonzero(n):
        new[j] = [s // int(n[j]) for s in sums[j]]
    return fitted(new)


def fitted(c: np.ndarray) -> np.ndarray:
    return c.astype(np.int64) if greatest(c) < WIDE else c.astype(object)


def assigned(c: np.ndarray, inertias: list[int], hashes: list[str]):
    """Blocks to rows of RESULT."""
    within = lambda x: min(int(x), LONG)
    total = within(sum(inertias))
    each, names = np.array([within(x) for x in inertias], np.int64), np.array(hashes, object)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = unpacked(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), batch.column(3)[row].as_py())
                at, d = nearest(x, c)
                d = np.array([within(y) for y in d], np.int64) if d.dtype == object else d.astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(at.astype(np.int32)), pa.array(d), pa.array(each[at]), pa.array(np.full(len(at), total)), pa.array(names[at], pa.string())], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of df (vec_id, embedding) that takes part."""
    spark = df.sparkSession
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.filter((F.size("v") == dimension) & F.forall("v", finite))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = v.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    c = fitted(np.array([[whole(x, scale) for x in row["v"]] for row in first], object).reshape(len(first), dimension))
    blocks = written(v.mapInArrow(released(packed(dimension, scale)), "ids array<long>, n int, wide boolean, values binary"), "blocks")
    for _ in range(rounds):
        c = moved(c, *rounds_of(blocks, c, False))
    inertias = [int(x) for x in rounds_of(blocks, c, True)[1][:, 0]]
    hashes = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in c]
    return blocks.mapInArrow(released(assigned(c, inertias, hashes)), RESULT)
