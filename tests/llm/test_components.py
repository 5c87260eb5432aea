import random

import pytest

from codeatlas.llm.graph_components import components


def brute(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("finish", [0, 1 << 22])
def test_components(spark, finish):
    r = random.Random(1)
    edges = [(r.randint(-40, 400), r.randint(-40, 400)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(200)] + [(7, 7)]
    df = spark.createDataFrame(edges * 2, "src long, dst long").repartition(5)
    got = {x["node"]: x["component"] for x in components(df, finish=finish).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
