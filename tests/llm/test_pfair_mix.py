from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeatlas.llm import pfair_mix as p


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {None: 1, "x": 1}, {"a": 1000, "b": 1}, {f"s{k}": k + 1 for k in range(30)}])
def test_less_than_one_block_from_target(weights):
    period = 128
    slots = p.shares(weights, period)
    assert sum(slots.values()) == period and min(slots.values()) >= 1
    done = defaultdict(int)
    for n, (s, k, t) in enumerate(p.layout(slots, period)):
        assert (n, done[s]) == (t, k)
        done[s] += 1
        assert all(abs(done[x] - slots[x] * (t + 1) / period) < 1 for x in slots)


def test_odd_documents(odd, odd_documents):
    weights = {"web": 3.0, None: 1.0, "book": 2.0}
    found = p.mix(odd, weights, block_chars=2000, period=60).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in found), key=repr) == sorted(((d[0], d[3], len(d[1] or "")) for d in odd_documents), key=repr)
    slots, plan = p.shares(weights, 60), {}
    for s, k, t in p.layout(p.shares(weights, 60), 60):
        plan[s, k] = t
    sizes = defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
    for source in weights:
        at = sorted((r["start"], r["block"], r["slot"], r["size"]) for r in found if r["source"] == source)
        last = max(0, -(-sizes[source] // 2000) - 1)
        for start, block, slot, _ in at:
            assert block == min(start // 2000, last)
            q = slots[source]
            assert slot == block // q * 60 + plan[source, block % q]
        places = sorted((a[0], a[3]) for a in at if a[3])
        assert all(x[0] + x[1] == y[0] for x, y in zip(places, places[1:], strict=False)) and (not places or places[0][0] == 0)
    blocks = {s: max(1, -(-sizes[s] // 2000)) for s in weights}
    horizon = min(b // slots[s] * 60 + plan[s, b % slots[s]] for s, b in blocks.items())
    assert all(r["in_mix"] == (r["slot"] < horizon) for r in found)


def test_odd_documents_by_exact_weights(odd, odd_documents):
    """The form of the registered query: every row has a place, blocks of a source follow its sizes, and each slot holds one block, in the order of schedule()."""
    weights = {"web": 3.0, None: 1.0, "book": 2.0}
    found = p.mix(odd, weights, block_chars=2000).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in found), key=repr) == sorted(((d[0], d[3], len(d[1] or "")) for d in odd_documents), key=repr)
    sizes = defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
    whole = p.whole(weights)
    plan = list(p.schedule([(s, whole[s], max(1, -(-sizes[s] // 2000))) for s in weights]))
    at = {(s, k): t for s, k, t, real in plan if real}
    end = next((t for _, _, t, real in plan if not real), None)
    assert len(set(at.values())) == len(at)
    for r in found:
        assert r["block"] == min(r["start"] // 2000, max(0, -(-sizes[r["source"]] // 2000) - 1)) and r["slot"] == at[r["source"], r["block"]]
        assert r["in_mix"] == (end is None or r["slot"] < end)
    for s in weights:
        places = sorted((r["start"], r["size"]) for r in found if r["source"] == s and r["size"])
        assert not places or places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))


def test_sources_without_weight(odd):
    r = p.mix(odd, {"web": 1.0}, period=8).filter("source = 'book'").first()
    assert r["slot"] is None and r["in_mix"] is False


def test_carried_columns_and_empty_table(odd, none):
    assert p.mix(odd, p.tempered(odd), carry=tuple(odd.columns)).select("carried.*").columns == odd.columns
    assert p.mix(none, p.tempered(none)).count() == 0
    assert p.mix(none, {"web": 1.0}).count() == 0


def test_target_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("x"), 50).alias("text"))
    found = p.mix(docs, {"a": 1.0, "b": 1.0}, block_chars=500, period=16).filter("in_mix")
    n = {r["source"]: r["n"] for r in found.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert abs(n["a"] - n["b"]) <= 1000


@pytest.mark.parametrize("weights", [{f"s{k:02}": w for k, w in enumerate([0.2, 0.0001, 0.0999] + [0.7 / 17] * 17)}, {f"s{k}": (k + 1) ** 0.7 for k in range(1500)}, {"a": 0.9, **{f"b{k}": 0.001 for k in range(100)}}])
def test_less_than_one_block_from_exact_target(weights):
    n = p.whole(weights)
    total, done = sum(n.values()), dict.fromkeys(weights, 0)
    for t, (s, k, slot, real) in enumerate(p.schedule([(s, x, 10**9) for s, x in n.items()])):
        assert real and slot == t and done[s] == k
        done[s] += 1
        if t % 7 == 0 or t < 50:
            assert all(abs(done[x] * total - n[x] * (t + 1)) < total for x in n)
        if t > 5000:
            break
    # a row of every block, whatever its source's weight, inside its window; before the horizon no slot is empty
    blocks = {s: 1 + k % 5 for k, s in enumerate(weights)}
    plan = list(p.schedule([(s, n[s], blocks[s]) for s in weights]))
    end = [t for *_, t, real in plan if not real]
    real = [x[:3] for x in plan if x[3]]
    assert len(end) == 1 and sorted(x[:2] for x in real) == sorted((s, k) for s in weights for k in range(blocks[s]))
    assert all(k * total // n[s] <= t < -(-(k + 1) * total // n[s]) for s, k, t in real)
    assert [t for _, _, t in real][: end[0]] == list(range(end[0]))


def test_many_sources_keep_their_exact_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 600).alias("source"), F.repeat(F.lit("x"), 50).alias("text"))
    weights = {f"s{k}": 1.0 + (k % 3) for k in range(600)}
    found = p.mix(docs, weights, block_chars=50).collect()
    total, slots = sum(weights.values()), sorted((r["slot"], r["source"], r["in_mix"]) for r in found)
    assert len({x[0] for x in slots}) == len(found) == 6000
    done = defaultdict(int)
    for t, s, inside in slots:
        if inside:
            done[s] += 1
            if t % 100 == 0:
                assert all(abs(done[x] - w / total * (t + 1)) < 1 + 1e-9 for x, w in weights.items())
    assert sum(done.values()) == max(t for t, _, inside in slots if inside) + 1
