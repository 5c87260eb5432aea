import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codeatlas.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]


def brute(rows, least=10, top=10):
    """Rows of (lang, source, text)."""
    n, held, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        sources[lang].add(source)
        found = terms(text)
        n[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, k in held[lang].items() if k >= least)
        whole = Counter()
        for s in own:
            whole.update({t: n[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept} if kept else {}
        ps, q = {s: share(n[lang, s]) for s in own}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in own if o != s)
            term = sorted((-f(ps[s][t], q[t]), t) for t in kept if n[lang, s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -value, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (value, item) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def many():
    r = random.Random(13)
    words = "The the THE und über ÜBER 日本 naïve x a_b don't foo3bar é ß zz common rare".split() + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(r.choice(["en", "en", "en", "de"]), f"s{r.randrange(9)}", " ".join(r.choice(words[: 5 + k % 30]) for _ in range(r.randint(0, 40)))) for k in range(400)]
    rows += [("en", "silent", ""), ("en", "silent", "1 2 3"), ("en", None, "the the the"), (None, None, None), ("", "", "the"), ("xx", "only", "the word " * 12), ("yy", "a", "few"), ("yy", "b", "none"), ("yy", "", None)]
    return rows + rows[:5]


@pytest.mark.parametrize(("unit", "block"), [(1 << 16, 256), (7, 3), (40, 1)])
def test_against_brute_force(spark, many, unit, block):
    """With one unit for each language, and with many units and blocks of sources."""
    df = spark.createDataFrame(many, "lang string, source string, text string").selectExpr("*", "1 as n", "'x' as term", "2 as idx", "3 as tb").repartition(4)
    got = rows_of(sd.audit(df, unit_rows=unit, block=block))
    assert got == brute(many) and {r[2] for r in got} == {"pair", "term"}


def test_odd_documents(spark, odd, odd_documents):
    assert rows_of(sd.audit(odd, least_docs=3)) == brute([(r[2], r[3], r[1]) for r in odd_documents], least=3)


def test_empty(spark, none):
    got = sd.audit(none)
    assert tuple(got.columns) == COLUMNS and got.count() == 0 and dict(got.dtypes)["value"] == "bigint"


def test_whole_table(spark):
    from codeatlas.llm.queries import QUERIES

    place = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{place}/documents.parquet").select("lang", "source", "text").collect()]
    assert rows_of(QUERIES["op13_source_divergence"](spark, place)) == brute(rows)


@pytest.mark.parametrize("hash_", [lambda b: len(b) % 3, lambda b: 7, sd.xxhash.xxh3_64_intdigest])
def test_equal_hashes_are_told_apart(many, hash_):
    """Counts don't depend on the hash."""
    rows = [tuple(x or "" for x in r) for r in many]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for b in sd.counted(hash_)(iter([batch])):
        for lang, source, term, k, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n[lang, source, term] += k
            docs[lang, source, term] += d
    want, want_docs = Counter(), Counter()
    for lang, source, text in rows:
        want.update((lang, source, t) for t in terms(text))
        want_docs.update((lang, source, t) for t in set(terms(text)))
    assert n == want and docs == want_docs


def test_large_counts_are_exact():
    n = np.array([0, 5, 10**12, 9 * 10**17])
    total, v = np.full(4, 10**18), np.full(4, 10**6)
    assert sd.share(n, total, v).tolist() == [1 + 10**9 * (int(k) + 2) // (10**18 + 2 * 10**6) for k in n]
