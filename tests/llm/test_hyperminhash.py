import random
import re

import numpy as np
from pyspark.sql import functions as F

from codeatlas.llm import hyperminhash as h


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=85, size=3):
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=repr)


def check(df, rows, threshold=85, size=3, bands=h.BANDS):
    got = sorted((tuple(r) for r in h.near_duplicates(df, threshold, size, bands).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute(rows, threshold, size)


def test_odd_documents(odd, odd_documents):
    check(odd, [(d[0], d[1]) for d in odd_documents])


def test_chains_and_copies(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for size in (40, 300, 3, 4, 90):
        text = [r.choice(words) for _ in range(size)]
        for step in range(12):
            rows.append((k, " ".join(text)))
            k += r.randint(1, 3)
            if step % 3:
                text = text[:]
                text[r.randrange(len(text))] = r.choice(words)
    rows += [(k + 1, rows[0][1].upper()), (k + 2, "\n".join(rows[3][1].split()))]
    rows += [(k + 100 + n, f"a b c d e f g h {n}") for n in range(40)]
    r.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_block_units(spark, monkeypatch):
    """Families larger than a block are verified over all pairs of blocks."""
    monkeypatch.setattr(h, "BLOCK_ROWS", 4)
    r = random.Random(4)
    base = [r.choice("abcdefghijklmnop") + str(r.randint(0, 999)) for _ in range(60)]
    rows = []
    for k in range(50):
        text = base[:]
        text[k % 60] = f"new{k}"
        rows.append((k, " ".join(text)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_families_of_several_parts(spark, monkeypatch):
    """Texts around the threshold: the first comparisons leave parts over, which units of small blocks must join exactly."""
    monkeypatch.setattr(h, "BLOCK_ROWS", 5)
    r, rows = random.Random(12), []
    for group in range(3):
        base = [f"g{group}w{k}" for k in range(90)]
        for _ in range(45):
            text = base[:]
            for _ in range(r.randint(2, 6)):
                text[r.randrange(90)] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    real = h.units
    monkeypatch.setattr(h, "units", lambda *given: seen.append(real(*given)) or seen[-1])
    check(df, rows)
    assert [x.count() > 0 for x in seen] == [True, True]


def test_weak_ties_make_no_family(spark, monkeypatch):
    """Thousands of texts that share bands in one long chain, nearly all far below the threshold: few of them reach full sets."""
    words = [f"w{k}" for k in range(60_000)]
    rows = [(k, " ".join(words[20 * k : 20 * k + 70])) for k in range(2900)] + [(5000 + k, " ".join([*words[400 * k : 400 * k + 69], "end"])) for k in range(40)]
    df, seen, real = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), [], h.units
    monkeypatch.setattr(h, "units", lambda *given: seen.append(real(*given)) or seen[-1])
    got = {r["doc_id"]: r["component_id"] for r in h.near_duplicates(df).collect()}
    assert got == {k: k for k in range(2900)} | {5000 + k: 20 * k for k in range(40)}
    assert seen[0].count() > 1000 and seen[1].count() < 200


def test_five_words_and_four_fifths(spark):
    r, rows = random.Random(2), []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(120)]
        rows += [(len(rows) + k, " ".join(base[: 120 - cut])) for k, cut in enumerate((0, 12, 23, 25, 40))]
    r.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, 80, 5, (32, 4))


def test_keep_one(spark, odd, odd_documents):
    """One row of each group stays, whole: of several rows of the least doc_id one, and all rows without a doc_id."""
    found = h.keep_one(odd)
    assert found.columns == odd.columns
    least = {d: c for d, _, c, _ in brute([(d[0], d[1]) for d in odd_documents])}
    stays = sorted((d[0] for d in odd_documents if d[0] is None or least[d[0]] == d[0]), key=repr)
    want = [d for k, d in enumerate(stays) if d is None or d != stays[k - 1]]
    assert sorted((r["doc_id"] for r in found.collect()), key=repr) == want
    text = "a few words that two rows share word by word".replace(" ", "  ")
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (None, text, "c"), (3, "", "d"), (3, "something else entirely is written here", "e"), (4, "something else entirely is written here", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rejected_id string")
    assert sorted((r["doc_id"] or 0, r["rejected_id"]) for r in h.keep_one(df).collect()) == [(0, "c"), (1, "a"), (3, "d")]


def test_empty(none):
    assert h.near_duplicates(none).count() == 0


def test_compressed_registers_keep_order_and_estimate():
    r = np.random.RandomState(1)
    for share in (0.5, 0.85, 0.95):
        errors = []
        for _ in range(30):
            n = 400
            both = r.randint(0, 1 << 62, int(n * 2 * share / (1 + share))).astype(np.uint64)
            rest = n - len(both)
            a, b = (np.unique(np.concatenate([both, r.randint(0, 1 << 62, rest).astype(np.uint64)])) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            c = h.collision(len(a), len(b))
            errors.append((((h.registers(a) == h.registers(b)).mean() - c) / (1 - c)) - true)
        assert abs(np.mean(errors)) < 0.03


def test_whole_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text"))
    check(docs, [tuple(r) for r in docs.collect()])
