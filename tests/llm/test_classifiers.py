"""The quality classifier and the toxicity network: held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import quality_gam, toxicity_gru

DATA = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    _, inverse, n = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    pos = y[order] == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out(spark, result, label, place=DATA):
    labels = spark.read.parquet(f"{place}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = result.filter("held_out").join(labels, "doc_id").select("score", "y").toPandas()
    return auc(rows["score"].to_numpy(), rows["y"].to_numpy())


def test_quality_held_out(spark):
    found = quality_gam.quality(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert held_out(spark, found, "quality") > 0.9


def test_toxicity_held_out(spark):
    place = "/root/testdata/sf0.1"  # the smaller tables have under 30 toxic texts to learn from
    found = toxicity_gru.toxicity(spark.read.parquet(f"{place}/documents.parquet"), spark.read.parquet(f"{place}/labels.parquet"))
    assert held_out(spark, found, "toxic", place) > 0.9


@pytest.mark.parametrize(("operator", "modulus", "held"), [(quality_gam.quality, 5, 0), (toxicity_gru.toxicity, 3, 1)])
def test_odd_rows(spark, odd, odd_documents, none, operator, modulus, held):
    labels = spark.createDataFrame([(d[0], int(k % 2), int(k % 4 == 0)) for k, d in enumerate(odd_documents)] + [(None, 1, 1), (1, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = operator(odd, labels).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((d[0] for d in odd_documents), key=repr)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
    assert len({r["score"] for r in got if r["doc_id"] in (200, 201, 202, 203)}) == 1
    assert operator(none, labels).count() == 0
    no_labels = operator(odd, labels.limit(0)).select("score").distinct().collect()
    assert len(no_labels) == 1


def test_additive_model_learns_an_interaction():
    r = np.random.RandomState(0)
    x = r.rand(3000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.AdditiveModel(rounds=30, pair_rounds=60).fit(x[:2000], y[:2000])
    assert auc(model.score(x[2000:]), y[2000:]) > 0.95


def test_joined_vocabulary(monkeypatch, odd_documents):
    """A vocabulary made from slices reads the same words and grams as one made at once."""
    import pyarrow as pa

    from codeatlas.llm.shared import slices, text_bytes

    texts = text_bytes(pa.array([d[1] for d in odd_documents], pa.string()))
    whole = toxicity_gru.Vocabulary(*texts)
    monkeypatch.setattr(toxicity_gru, "slices", lambda offsets: slices(offsets, 5000))
    joined = toxicity_gru.Vocabulary.joined(*texts)
    for k in ("hashes", "word", "at", "first", "counts", "sizes", "begin", "owner", "grams"):
        assert (getattr(whole, k) == getattr(joined, k)).all(), k


def test_network_gradients():
    text = "one two three four two one five six"
    data = np.frombuffer(text.encode(), np.uint8)
    v = toxicity_gru.Vocabulary(data, np.array([0, len(data)]))
    _, at = v.windows()
    net, y = toxicity_gru.ToxicNet(3), np.array([1.0], np.float32)
    loss = lambda: float(np.log1p(np.exp(-net.run(net.project(net.inputs(v)), at).astype(float)))[0])
    g, _, _ = net.gradients(v, at, y)
    for k in ("out", "att_v", "rec_f", "in_b", "rec_b", "in_f"):
        k = k if k in g else "in_b_f"
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        i, eps = len(flat) // 2, 1e-2
        keep = flat[i]
        flat[i] = keep + eps
        up = loss()
        flat[i] = keep - eps
        down = loss()
        flat[i] = keep
        assert abs((up - down) / (2 * eps) - grad[i]) < 2e-3


SOME = ["", "one", "a b a b a b c", "Ein Satz, über viele Wörter! Und noch | einer.\n\n  Und noch | einer.\n", "x" * 300 + " 12 3,4 A|B #tag\tTAB", " \n\t", "日本 の 文 the the the THE\nthe\nthe\n", "word " * 500]


def plain_features(text):
    """The features of one text, by loops over words and lines."""
    import math
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    n, size = max(len(words), 1), max(len(text.encode()), 1)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    count = lambda chars: sum(text.count(c) for c in chars)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    n_lines = text.count("\n") + 1
    return [math.log1p(len(words)), sum(map(len, words)) / n, count("#*$%&|<>") / n, (len(lines) - len(set(lines))) / n_lines, len(again) / n, count(upper) / max(count(upper + lower), 1), count("!") / n, count("|") / n, count("0123456789") / size, count(".") / n, count(",") / n, sum(ord(c) > 127 for c in text) / size, len(set(words)) / n, math.log1p(len(words) / n_lines), sum(len(w.encode()) <= 2 for w in words) / n]


def test_quality_against_plain_python(spark):
    """Features by loops, and a score summed from the tables entry by entry."""
    from bisect import bisect_right
    from math import exp

    place = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{place}/documents.parquet"), spark.read.parquet(f"{place}/labels.parquet")
    model = quality_gam.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()][:40] + list(enumerate(SOME))
    got = quality_gam.features(*bytes_of([t for _, t in rows]))
    for (_, text), x in zip(rows, got, strict=True):
        plain = plain_features(text or "")
        assert np.allclose(x, plain, rtol=1e-9, atol=1e-12), [(f, a, b) for f, a, b in zip(quality_gam.FEATURES, x, plain, strict=True) if abs(a - b) > 1e-9]
        f = model.base + sum(float(t[bisect_right(list(e), v)]) for e, t, v in zip(model.edges, model.tables, plain, strict=True))
        f += sum(float(t[bisect_right(list(model.rough[i]), plain[i])][bisect_right(list(model.rough[j]), plain[j])]) for i, j, t in model.pairs)
        assert abs(model.score(x[None])[0] - 1 / (1 + exp(-f))) < 1e-6


def bytes_of(texts):
    import pyarrow as pa

    from codeatlas.llm.shared import text_bytes

    return text_bytes(pa.array(texts, pa.string()))


def test_toxicity_against_plain_python(odd_documents):
    """The score of whole texts by a loop over windows, places and gates, one number at a time where the network has vectors."""
    r = np.random.RandomState(2)
    net = toxicity_gru.ToxicNet(5)
    net.trained, H, SPAN = True, toxicity_gru.H, toxicity_gru.SPAN
    texts = [*SOME[:7], " ".join(r.choice(["you", "are", "fine", "x", "über", "and", "so-on"], 150))]
    got = toxicity_gru.scores(net, *bytes_of(texts))
    squash, p = lambda x: 1 / (1 + np.exp(-np.asarray(x, float))), net.p
    for text, score in zip(texts, got, strict=True):
        words = text.split()  # the same words, for these texts
        best = 0.0
        for begin in range(0, max(len(words) - SPAN, 0) + toxicity_gru.STRIDE if words else 0, toxicity_gru.STRIDE):
            own = words[begin : begin + SPAN]
            if not own or begin and begin >= len(words) - SPAN + toxicity_gru.STRIDE:
                continue
            xs = [net.inputs(toxicity_gru.Vocabulary(*bytes_of([w])))[0].astype(float) for w in own]
            states = {}
            for d in "fb":
                h, out = np.zeros(H), []
                for x in xs if d == "f" else xs[::-1]:
                    g, u = x @ p[f"in_{d}"] + p[f"in_b_{d}"], h @ p[f"rec_{d}"]
                    z, reset = squash(g[:H] + u[:H]), squash(g[H : 2 * H] + u[H : 2 * H])
                    h = (1 - z) * np.tanh(g[2 * H :] + reset * u[2 * H :]) + z * h
                    out.append(h)
                states[d] = out if d == "f" else out[::-1]
            both = [np.concatenate([a, b]) for a, b in zip(states["f"], states["b"], strict=True)]
            weight = np.exp([float(np.tanh(s @ p["att"] + p["att_b"]) @ p["att_v"]) for s in both])
            pooled = sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True))
            best = max(best, float(squash(pooled @ p["out"] + p["bias"][0])))
        assert abs(score - best) < 1e-4


def test_training_texts_are_drawn_by_runs(spark, odd):
    """Whole texts below the bound; above it about the same share of each text's runs, words in their order, and no giant words."""
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(64 * 100))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, "y" * 70_000, None]), pa.array([1, 0, 0], pa.int32())], ["doc_id", "text", "y"])
    (got,) = toxicity_gru.drawn(0.5)(iter([batch]))
    words = got.column(1)[0].as_py().split()
    assert 30 * 64 <= len(words) <= 70 * 64 and words == sorted(words, key=lambda w: int(w[1:])) and all(int(a[1:]) % 64 == 0 for a in words[::64])
    assert got.column(1)[1].as_py() == "" and got.column(1)[2].as_py() == ""
    labels = odd.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    assert toxicity_gru.fit(odd, labels, most_bytes=20_000).trained
