"""Exact top-k search (operator 3) with a vector-approximation file.

Components become whole numbers floor(scale * x). Cells of each dimension are cut at quantiles of at most SAMPLE vectors (those of the
smallest hashes), the outer ones reach to the least and greatest component of all. Every vector's cells are written once, a byte a
dimension, in a file of their own; exact vectors stay in another one.

A search scans the cells alone: groups of cells and of queries of bounded size are units of work, which give lower and upper bounds of
inner products and pass on what may be among a query's k best; one of them is scanned first, and its kth lower bounds are the floor of all others. The
kth lower bound over all units then cuts the candidates of each query.
Exact vectors are read in two steps, from the highest bounds down: first those of the 2 k best upper bounds, then those whose upper bound
still reaches the kth exact score, so the k best are certain.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither as queries nor as candidates; nor
do rows without vec_id. Only vectors of a query's dimension are its candidates. A query never meets rows of its own vec_id. Repeated
query rows are one query; repeated candidate rows are one candidate, and an id with several vectors counts by its best one. Scores are exact
whole numbers; those beyond the range of a long come out as its nearest end, and tie there. Ties go to the smaller vec_id. With fewer than k
candidates, all are returned. An empty table gives an empty result. Other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, released, small, written

K, CELLS, SAMPLE = 20, 256, 20_000
#: Rows of a group of vectors and of a group of queries, and queries whose bounds are held at once.
VECTORS, QUERIES, BLOCK = 8192, 2048, 256
LONG = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) with v an array of whole numbers in doubles, for the rows that take part."""
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  larger doubles are whole
    x = df.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda c: whole(F.lit(float(scale)) * c.cast("double"))).alias("v"), F.col("embedding").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = x.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & F.forall("v", lambda c: F.abs(c) < float("inf"))).select("vec_id", "v")
    return rows.distinct().withColumn("tag", F.xxhash64("v")).withColumn("d", F.size("v"))


def edges(v: DataFrame, cells: int = CELLS) -> dict[int, np.ndarray]:
    """For each dimension d of vectors the borders of cells of each component, as d rows of cells + 1 values."""
    ends = v.select("d", F.posexplode("v").alias("at", "x")).groupBy("d", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()  # a row a component
    drawn = v.orderBy(F.xxhash64("vec_id", "tag"), "vec_id", "tag").limit(SAMPLE).select("d", "v").toPandas()
    out = {}
    for d, own in ends.groupby("d"):
        own = own.sort_values("at")
        sample = drawn[drawn["d"] == d]["v"]
        inner = np.quantile(np.stack(sample.to_numpy()), np.linspace(0, 1, cells + 1)[1:-1], axis=0, method="lower").T if len(sample) else np.repeat(own[["low"]].to_numpy(float), cells - 1, 1)
        low, high = own["low"].to_numpy(float)[:, None], own["high"].to_numpy(float)[:, None]
        out[int(d)] = np.concatenate([low, np.clip(inner, low, high), high], 1)
    return out


def coded(borders: dict[int, np.ndarray]):
    """(vec_id, tag, d, v) to (vec_id, tag, d, code): the cell of each component, whose borders hold it between them."""

    def run(batches):
        for batch in batches:
            codes = []
            for d, v in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                codes.append(bytes(np.minimum((borders[d][:, 1:-1] <= x[:, None]).sum(1), borders[d].shape[1] - 2).astype(np.uint8)) if d else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(codes, pa.binary())], ["vec_id", "tag", "d", "code"])

    return run


def bounds(q: np.ndarray, codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with vectors, from the middles and half widths of their cells."""
    at = np.arange(codes.shape[1])
    low, high = borders[at, codes], borders[at, codes + 1]
    middle, half = q @ ((low + high) / 2).T, np.abs(q) @ ((high - low) / 2).T
    # far above what rounding can do to sums of this size
    half += 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-9
    return np.clip(middle - half, *map(float, LONG)), np.clip(middle + half, *map(float, LONG))


def scanned(k: int, borders: dict[int, np.ndarray]):
    """The scan of one unit: cells (vec_id, tag, code) and queries (vec_id, v, floor) to what may be among a query's k best: query_id, qtag, vec_id, tag, low, high.

    floor: a score that the query's kth best is known to reach.
    """

    def unit(cells: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cells) and len(asked):
            d, cells = int(cells["d"].iloc[0]), cells.sort_values(["vec_id", "tag"])
            ids, tags = cells["vec_id"].to_numpy(), cells["tag"].to_numpy()
            codes = np.frombuffer(b"".join(cells["code"]), np.uint8).reshape(len(ids), d).astype(np.int64)
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            q, q_ids, q_tags = np.stack(asked["v"].to_numpy()).reshape(len(asked), d), asked["vec_id"].to_numpy(), asked["qtag"].to_numpy()
            floors = asked["floor"].to_numpy(dtype=float)
            for i in range(0, len(q), BLOCK):
                low, high = bounds(q[i : i + BLOCK], codes, borders.get(d, np.zeros((0, 2))))
                own = ids[None, :] == q_ids[i : i + BLOCK, None]
                low[own], high[own] = -np.inf, -np.inf
                each = np.maximum.reduceat(low, first, axis=1)  # an id with several vectors counts once
                floor = np.maximum(np.partition(each, -k, 1)[:, -k] if len(first) > k else -np.inf, floors[i : i + BLOCK])
                r, c = np.nonzero((high >= floor[:, None]) & (high > -np.inf))
                out.append(pd.DataFrame({"query_id": q_ids[i + r], "qtag": q_tags[i + r], "vec_id": ids[c], "tag": tags[c], "low": low[r, c], "high": high[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, t) for c, t in zip(("query_id", "qtag", "vec_id", "tag", "low", "high"), ("i8",) * 4 + ("f8",) * 2, strict=True)})

    return unit


def product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, at the nearest long."""
    size = (np.abs(q) * np.abs(v)).sum(1) if len(q) else np.zeros(0)
    if size.max(initial=0) < 1 << 52:
        return np.einsum("nd,nd->n", q, v).astype(np.int64)
    return np.array([min(LONG[1], max(LONG[0], sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x, y in zip(q, v, strict=True)], np.int64)


def exactly(batches):
    """(query_id, qtag, vec_id, q, v) to (query_id, qtag, vec_id, score)."""
    for batch in batches:
        a, b = (batch.column(k).to_pandas() for k in (3, 4))
        score = np.zeros(batch.num_rows, np.int64)
        sizes = a.map(len).to_numpy() if len(a) else score
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            score[at] = product(np.stack(a.iloc[at].to_numpy()).reshape(len(at), d), np.stack(b.iloc[at].to_numpy()).reshape(len(at), d))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score)], ["query_id", "qtag", "vec_id", "score"])


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(query_id, kth): the kth greatest value of each query over its ids, where it has so many."""
    best = rows.groupBy("query_id", "vec_id").agg(F.max(value).alias("value"))
    best = best.withColumn("n", F.expr("row_number() over (partition by query_id order by value desc)")).filter(F.col("n") <= k)
    return best.groupBy("query_id").agg(F.min("value").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k).select("query_id", "kth")


def candidates(df: DataFrame, is_query, k: int = K, scale: int = 64, cells: int = CELLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written exact vectors, the queries, and what cells alone leave over: (query_id, qtag, vec_id, tag, high)."""
    v = written(whole_numbers(df, scale), "vectors")
    borders = edges(v, cells)  # dimensions times cells
    codes = written(v.select("vec_id", "tag", "d", "v").mapInArrow(released(coded(borders)), "vec_id long, tag long, d int, code binary"), "cells")
    queries = v.filter(is_query).withColumnRenamed("tag", "qtag")
    n, nq = v.count(), queries.count()
    groups_v = max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // 1024), -(-n // VECTORS))
    groups_q = max(1, -(-nq // QUERIES))
    deal = lambda g: F.pmod(F.xxhash64("vec_id"), F.lit(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    left = codes.withColumn("gv", deal(groups_v)).withColumn("gq", every(groups_q))
    asked = queries.withColumn("gq", deal(groups_q))

    def bounded(cells: DataFrame, floors: DataFrame, units) -> DataFrame:
        right = floors.withColumn("gv", units)
        both = cells.repartition(parts(df), "gv", "gq", "d").groupBy("gv", "gq", "d").cogroup(right.groupBy("gv", "gq", "d"))
        return written(both.applyInPandas(scanned(k, borders), "query_id long, qtag long, vec_id long, tag long, low double, high double"), "bounds")

    # one unit's kth bound of each query first, so that all other units hand on only what may still be better
    found = bounded(left.filter("gv = 0"), asked.withColumn("floor", F.lit(float("-inf"))), F.lit(0))
    if groups_v > 1:
        floors = asked.join(small(written(kth(found, "low", k).withColumnRenamed("kth", "floor"), "floors")), asked["vec_id"] == F.col("query_id"), "left").drop("query_id").na.fill(float("-inf"), ["floor"])
        found = found.unionByName(bounded(left.filter("gv > 0"), floors, F.explode(F.sequence(F.lit(1), F.lit(groups_v - 1)))))
    left_over = found.join(small(written(kth(found, "low", k), "kth-bound")), "query_id", "left").filter(F.col("high") >= F.coalesce("kth", F.lit(float("-inf"))))
    return v, queries, left_over.select("query_id", "qtag", "vec_id", "tag", "high")


def top_k(df: DataFrame, is_query, k: int = K, scale: int = 64, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row of df (vec_id, embedding) for which is_query holds."""
    v, queries, found = candidates(df, is_query, k, scale, cells)
    found = written(found.withColumn("n", F.expr("row_number() over (partition by query_id order by high desc, vec_id, tag)")), "candidates")
    asked = queries.select(F.col("vec_id").alias("query_id"), "qtag", F.col("v").alias("q"))

    def scored(rows: DataFrame) -> DataFrame:
        both = rows.select("query_id", "qtag", "vec_id", "tag").join(v.select("vec_id", "tag", "v"), ["vec_id", "tag"]).join(asked, ["query_id", "qtag"])
        return both.select("query_id", "qtag", "vec_id", "q", "v").mapInArrow(released(exactly), "query_id long, qtag long, vec_id long, score long")

    first = written(scored(found.filter(F.col("n") <= 2 * k)), "scores")
    certain = small(written(kth(first, "score", k), "kth-score"))
    rest = found.filter(F.col("n") > 2 * k).join(certain, "query_id", "left").filter(F.col("high") >= F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    pairs = first.unionByName(scored(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
