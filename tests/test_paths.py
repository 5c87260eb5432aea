"""Trails against brute-force enumeration on small random graphs, shortest chains, upserts, and change states."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeatlas.graph import Graph
from codeatlas.operators import changes, paths, upserts


def brute(edges, start, least, most):
    out, level = [], [(start, (start,), frozenset())]
    for depth in range(most + 1):
        if depth >= least:
            out += [(n, depth, list(p)) for n, p, _ in level]
        level = [(b, (*p, b), used | {(a, b)}) for n, p, used in level for a, b in edges if a == n and (a, b) not in used]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trails(spark, seed):
    r = random.Random(seed)
    edges = sorted({(str(r.randrange(6)), str(r.randrange(6))) for _ in range(9)})
    df = spark.createDataFrame(edges, "a string, b string")
    found = paths.trails(df, spark.createDataFrame([("0",)], "start string"), 0, 4)
    assert sorted((x["node"], x["depth"], list(x["path"])) for x in found.collect()) == brute(edges, "0", 0, 4)


def test_chains_are_shortest(spark):
    r = random.Random(7)
    edges = sorted({(f"m{r.randrange(12)}", f"m{r.randrange(12)}") for _ in range(22)})
    nodes = spark.createDataFrame([(f"m{k}",) for k in range(12)], "name string")
    g = Graph(nodes, nodes, nodes, nodes, {"DEPENDS_ON": spark.createDataFrame(edges, "src string, dst string")})
    got = {x["target"]: (x["depth"], list(x["path"])) for x in paths.dependency_chains(g, "m0", 6).collect()}
    want = {}
    for node, depth, path in brute(edges, "m0", 1, 6):
        if node != "m0" and len(set(path)) == len(path):
            want[node] = min(want.get(node, (99, [])), (depth, path))
    assert {k: v for k, v in got.items() if k != "m0"} == want
    with pytest.raises(ValueError):
        paths.dependency_chain(g, "m0", "m0")


def graph_of(spark, edges, n):
    nodes = spark.createDataFrame([(f"m{k}",) for k in range(n)], "name string")
    return Graph(nodes, nodes, nodes, nodes, {"DEPENDS_ON": spark.createDataFrame(edges, "src string, dst string")})


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_between_two(spark, seed):
    """Each pair's chain from two fronts is that of the search from one side; no row where there is none or it is too long."""
    r = random.Random(seed)
    edges = sorted({(f"m{r.randrange(14)}", f"m{r.randrange(14)}") for _ in range(24)})
    g = graph_of(spark, edges, 14)
    want = {x["target"]: (list(x["path"]), x["depth"]) for x in paths.dependency_chains(g, "m1", 4).collect()}
    for target in ("m0", "m2", "m5", "m9", "m13", "unknown"):
        got = [(list(x["path"]), x["depth"]) for x in paths.dependency_chain(g, "m1", target, 4).collect()]
        assert got == ([want[target]] if target in want else [])


def reach(edges):
    out = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
    while True:
        new = {a: bs | {c for b in bs for c in out[b]} for a, bs in out.items()}
        if new == out:
            return out
        out = new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = sorted({(f"m{r.randrange(20)}", f"m{r.randrange(20)}") for _ in range(26)})
    to = reach(edges)
    own = {a: {b for b in to[a] if a in to[b]} for a in to}
    want = {(a, min(bs), len(bs)) for a, bs in own.items() if len(bs) > 1}
    assert {tuple(x) for x in paths.dependency_components(graph_of(spark, edges, 20)).collect()} == want
    inside = {tuple(x) for x in paths.cyclic_arcs(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert inside == {(a, b) for a, b in edges if a == b or a in to[b]}


def test_no_cycles(spark):
    g = graph_of(spark, [("m0", "m1"), ("m1", "m2"), ("m0", "m2")], 3)
    assert paths.dependency_components(g).count() == 0 and paths.dependency_cycles(g).count() == 0 and paths.dependency_cycles(g, by_component=True).count() == 0


@pytest.mark.parametrize(("most", "by_component"), [(5, False), (6, True), (1, False)])
def test_cycles_from_two_halves(spark, most, by_component):
    r = random.Random(most)
    edges = sorted({(f"m{r.randrange(8)}", f"m{r.randrange(8)}") for _ in range(16)} | {("m3", "m3")})
    got = sorted((x["module"], x["cycle_length"], list(x["cycle_path"])) for x in paths.dependency_cycles(graph_of(spark, edges, 8), most, by_component).collect())
    assert got == sorted((s, d, p) for s in {a for a, _ in edges} for n, d, p in brute(edges, s, 1, most) if n == s)


ROW = st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.sampled_from("xyz"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=8), st.lists(ROW, max_size=8))
def test_upsert_is_idempotent(spark, rows, old, new):
    make = lambda x: spark.createDataFrame(x, "k string, t int, v string")
    base = upserts.last_writer(make(old), ["k"], ["t", "v"])
    once = upserts.upsert(base, make(new), ["k"], ["t", "v"])
    want = {k: (t, v) for k, t, v in sorted(old)} | {k: (t, v) for k, t, v in sorted(new)}
    assert rows(once) == sorted((k, t, v) for k, (t, v) in want.items())
    assert rows(upserts.upsert(once, make(new), ["k"], ["t", "v"])) == rows(once)


def test_states_of_shared_trackers(spark, rows):
    known = spark.createDataFrame([("m1/a", "1"), ("m1/b", "1"), ("m2/c", "1")], "path string, hash string")
    now = spark.createDataFrame([("m1/a", "2"), ("m1/d", "1")], "path string, hash string")
    state, counts = changes.process(known, now, lambda df: df.filter(F.col("path") != "m1/d"), prefix="m1/")
    assert rows(state) == [("m1/a", "2"), ("m2/c", "1")]
    assert rows(counts) == [("deleted", 1), ("modified", 1), ("new", 1)]
    assert rows(changes.deleted(known, now)) == [("m1/b",), ("m2/c",)]
