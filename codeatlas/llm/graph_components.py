"""Connected components of a graph given as a DataFrame of edges, by alternating large-star and small-star steps.

The edges stay distributed: each step is a grouped minimum and a join, so a node with very many edges costs no task more than
its partial minimum, and skewed joins are split by adaptive execution. Every task first reduces its own edges to a spanning forest;
only if at most FINISH edges are left after that, which is counted, one task finishes them in bounded memory, instead of rounds of shuffles.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


#: Edges (of 16 bytes) that one task may finish.
FINISH = 1 << 22


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph and the smallest node of each one's component, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        live = low < high
        if not live.any():
            break
        x, y = x[live], y[live]
        np.minimum.at(up, high[live], low[live])
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def forest(batches):
    """Arrow batches of edges (a, b) to stars: one edge from each node to the smallest of its component within these batches."""
    a, b, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        nodes, least = roots(np.concatenate([a, *[h[0] for h in held]]), np.concatenate([b, *[h[1] for h in held]]))
        return nodes[nodes != least], least[nodes != least]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += len(batch.column(0))
        if n > max(1 << 20, len(a)):  # what is held stays in proportion to the nodes
            (a, b), held, n = merged(), [], 0
    a, b = merged()
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])


def star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over edges (a, b), a > b. Large: every larger neighbour of a node moves to its smallest neighbour. Small: the same for the smaller ones."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("a", "m"))
    moved = both.join(least, "a")
    if small:
        out = moved.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    else:
        out = moved.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    return out.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, most: int = 60, finish: int = FINISH) -> DataFrame:
    """(node, component) of every node of edges (src, dst): component is the smallest node that can be reached."""
    e = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).mapInArrow(forest, "a long, b long")
    e, before = written(e, "edges"), None
    if e.count() <= finish:
        e = written(e.coalesce(1).mapInArrow(forest, "a long, b long"), "components")
        return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    for _ in range(most):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, e = now, written(star(star(e, False), True), "edges")
    raise RuntimeError(f"no fixed point of the components after {most} steps")
