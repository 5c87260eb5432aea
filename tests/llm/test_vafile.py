import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import vafile


def brute(rows, k):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen.setdefault(i, set()).add(tuple(math.floor(64 * float(np.float32(x))) for x in v))
    out = []
    for q, qs in seen.items():
        if q % 20 == 0:
            best = {c: max(s) for c, vs in seen.items() if c != q if (s := [sum(a * b for a, b in zip(x, y, strict=True)) for x in qs for y in vs if len(x) == len(y)])}
            out += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k])]
    return sorted(out)


def test_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(8)]) for k in range(500)]
    rows += [(k, rows[k % 7][1]) for k in range(500, 700)] + rows[:30]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2000, [1.0, 2.0]), (2001, [0.5, 2.0]), (2020, []), (2021, []), (40, [r.gauss(0, 1) for _ in range(8)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("d", F.lit("x")).repartition(4)
    got = sorted(tuple(x) for x in vafile.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 20)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(20 * k, [1.0 * k]) for k in range(n)], "vec_id long, embedding array<float>")
    assert vafile.top_k(df, F.col("vec_id") % 20 == 0).count() == n * max(0, n - 1)


def test_large_components_are_exact(spark):
    """Scores far above 2 ** 53 differ by their last digits; scores beyond a long come out as its end."""
    r = random.Random(3)
    rows = [(k, [float(np.float32(r.choice([-1, 1]) * 2.0**24 + r.randrange(2**20) * 2.0)), r.gauss(0, 2**20), r.gauss(0, 1)]) for k in range(120)]
    rows += [(200 + k, [2.0**20 + k, 0.0, 0.5]) for k in range(9)] + [(300, [1e30, -1e30, 1.0]), (320, [1e30, 1e30, 3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(x) for x in vafile.top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
    low, high = vafile.LONG
    want = {}
    for q, _, c, s in brute(rows, 10**6):
        want.setdefault(q, []).append((-min(high, max(low, s)), c))
    assert got == sorted((q, n + 1, c, -s) for q, own in want.items() for n, (s, c) in enumerate(sorted(own)[:20]))


def test_cells_leave_few_vectors_to_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v, queries, found = vafile.candidates(df, F.col("vec_id") % 20 == 0)
    assert found.count() < 0.1 * v.count() * queries.count()
    assert found.groupBy("query_id").count().agg(F.min("count")).first()[0] >= vafile.K
