import hashlib
import math
import random

import numpy as np
import pytest

from codeatlas.llm import centroids

LONG = (1 << 63) - 1


def brute(rows, k=16, rounds=3, dimension=64, scale=64):
    v = [(i, [int(y) * scale if abs(y) >= 1 << 53 else math.floor(scale * y) for y in map(float, x)], x) for i, x in rows if x is not None and len(x) == dimension and all(y is not None and math.isfinite(y) for y in x)]
    first = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))[:k]
    c = [x for _, x, _ in first]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        held = {}
        for _, x, _ in v:
            held.setdefault(near(x)[1], []).append(x)
        for j, xs in held.items():
            c[j] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    got = [(i, *near(x)[::-1]) for i, x, _ in v]
    each = [sum(d for _, j, d in got if j == n) for n in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, j, min(LONG, d), min(LONG, each[j]), min(LONG, sum(each)), sha[j]) for i, j, d in got], key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def table_of(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as cluster", "'x' as v", "2 as n", "3 as ids").repartition(5)


def test_odd_rows(spark):
    """Nulls, other lengths, repeated rows and ids, ties, negative components."""
    r = random.Random(1)
    rows = [(k, [r.choice([-1.5, -0.01, 0.0, 0.3, 2.0]) for _ in range(4)]) for k in range(150)]
    rows += rows[:9] + [(3, [9.0, 9.0, 9.0, 9.0]), (3, [-9.0, 9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, None), (500, None), (501, [1.0]), (502, []), (503, [1.0] * 5), (504, [None, 1.0, 1.0, 1.0]), (505, [float("nan"), 1.0, 1.0, 1.0]), (506, [float("-inf"), 1.0, 1.0, 1.0])]
    got = rows_of(centroids.cluster(table_of(spark, rows), dimension=4))
    assert got == brute(rows, dimension=4) and len(got) == 162


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_rows(spark, n):
    rows = [(k, [float(k % 3)] * 64) for k in range(n)]
    assert rows_of(centroids.cluster(table_of(spark, rows))) == brute(rows)


def test_all_without_id(spark):
    rows = [(None, [float(k)] * 64) for k in range(20)]
    assert rows_of(centroids.cluster(table_of(spark, rows))) == brute(rows)


def test_empty_cluster_stays(spark):
    """Equal first centroids: the later ones get nothing and don't move."""
    rows = [(k, [1.0] * 64) for k in range(40)]
    got = rows_of(centroids.cluster(table_of(spark, rows)))
    assert got == brute(rows) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("size", [2.0**18, 2.0**24, 2.0**30, 2.0**61, 1e300])
def test_large_components_are_exact(spark, size):
    """Beyond 2^53 in integers, beyond 2^63 in Python's whole numbers; one block mixes small and large rows."""
    r = random.Random(int(math.log2(size)))
    rows = [(k, [r.uniform(-size, size) for _ in range(3)]) for k in range(60)] + [(100 + k, [r.uniform(-1, 1) for _ in range(3)]) for k in range(30)]
    assert rows_of(centroids.cluster(table_of(spark, rows), k=4, dimension=3)) == brute(rows, k=4, dimension=3)


def test_float64_is_used_only_where_exact():
    x = np.array([[2**20, 1], [3, 4]])
    assert centroids.distances(x, x).dtype == np.float64
    for top, kind in ((2**27, np.int64), (2**32, object)):
        y = np.array([[top, 1], [top - 1, 0]])
        d = centroids.distances(y, y)
        assert d.dtype == kind and [[int(z) for z in row] for row in d] == [[0, 2], [2, 0]]


def test_whole_table(spark):
    from codeatlas.llm.queries import QUERIES

    place = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{place}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(QUERIES["op12_gemm_centroids"](spark, place)) == brute(rows)
