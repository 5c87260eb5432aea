import hashlib
import random

import numpy as np
import pytest

from codeatlas.llm import line_bloom, words

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows, least=20, docs=3):
    """Rows of (doc_id, text) to (doc_id, lines, dropped, kept)."""
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= docs and d != max(h))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


@pytest.fixture(scope="module")
def lines_and_rows():
    r = random.Random(11)
    common = [" The quick brown fox jumps over", "\tthe QUICK brown fox jumps over \r", "über die Straße und 日本 zurück nach Haus", "ÜBER die Straße und 日本 zurück nach Haus", "x" * 19, "y" * 20, "é" * 20, "é" * 19, "\x0bstripped on both its own ends\x0c", "stripped on both its own ends", " stripped on both its own ends", " " * 40, "", "a line of only two documents here"]
    rows = [(k, "\n".join(r.choice(common[:-1] + [f"own line number {k} {j} of this text"]) for j in range(r.randint(0, 9)))) for k in range(80)]
    rows += [(200, common[-1]), (201, common[-1] + "\n" + common[-1]), (202, common[0]), (203, "\n" + common[0] + "\n\n" + common[1] + "\n"), (204, "\n\n\n"), (205, None), (206, "")]
    rows += [(None, common[0] + "\n" + "z" * 30), (None, "z" * 30), (None, "z" * 30), (None, None), rows[3], rows[3], (4, "z" * 30), (4, "z" * 30 + "\nsame id, other text and more"), (300, ("long line, said again and again\n" * 4000) + "end"), (301, "long line, said again and again"), (302, "LONG line, said again and again "), (303, "w" * 300_000), (304, "w" * 300_000), (305, "w" * 300_000 + " ")]
    return rows


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("size", [1 << 30, 1 << 13])
def test_against_brute_force(spark, lines_and_rows, few, size):
    """With confirmed keys broadcast and joined; with filters of full size, and so small that nearly all lines are suspects."""
    df = spark.createDataFrame(lines_and_rows, "doc_id long, text string").selectExpr("*", "'x' as tag", "1 as hash", "'k' as key", "0 as kept").repartition(5)
    assert rows_of(line_bloom.drop_repeats(df, broadcast_keys=10**6 if few else 0, most_bits=size)) == brute(lines_and_rows)


@pytest.mark.parametrize("few", [True, False])
def test_odd_documents(spark, odd, odd_documents, few):
    assert rows_of(line_bloom.drop_repeats(odd, broadcast_keys=10**6 if few else 0)) == brute([(r[0], r[1]) for r in odd_documents])


def test_empty(spark, none):
    got = line_bloom.drop_repeats(none)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"] and got.count() == 0


def test_whole_table(spark):
    """The registered query over sf0.01, against plain Python."""
    from codeatlas.llm.queries import QUERIES

    place = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    got = [tuple(r) for r in QUERIES["op11_line_bloom_dedup"](spark, place).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in want) > 100


def test_filters_shuffle_few_lines(spark):
    """Nearly all suspects are true repeats."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.selectExpr("doc_id", "xxhash64(text) as tag", "text")
    doubtful, sure = line_bloom.repeated_keys(texts)
    held = {}
    for d, k in doubtful.select("doc_id", "key").collect():
        held.setdefault(k, set()).add(d)
    assert 100 * sum(len(x) == 1 for x in held.values()) <= docs.selectExpr("explode(split(text, '\\n')) as line").distinct().count() and sure.count() == sum(len(x) >= 3 for x in held.values())


def test_filters_add_up():
    """A key of two tasks, or of two rows of one, is in the second filter; one of a single row isn't (but for chance)."""
    import pyarrow as pa

    batch = lambda *t: pa.RecordBatch.from_arrays([pa.array(t)], ["text"])
    run = line_bloom.filters(1 << 16, 4, 8, 5)
    sent = [b for task in ([batch("alpha one", "beta two"), batch("alpha one")], [batch("beta two", "gamma\ngamma")]) for b in run(iter(task))]
    twice = np.zeros(1 << 13, np.uint8)
    for b in line_bloom.added(iter(sent)):
        j = b.column(0)[0].as_py()
        twice[j * 1024 : (j + 1) * 1024] = np.frombuffer(line_bloom.zlib.decompress(b.column(1)[0].as_py()), np.uint8)
    keys = [b"alpha one", b"beta two", b"gamma"]
    data, offsets = np.frombuffer(b"".join(keys), np.uint8), np.array([0, 9, 17, 22])
    h = words.Spans(words.BYTE[data]).hash(offsets[:-1], offsets[1:])
    assert list(line_bloom.marked(twice, line_bloom.bits(h, 1 << 16, 4)).all(1)) == [True, True, False]


def test_equal_slices():
    r = np.random.RandomState(1)
    a = r.randint(0, 2, 5000).astype(np.uint8)
    b = a.copy()
    b[r.randint(0, 5000, 40)] ^= 1
    starts, lengths = r.randint(0, 4000, 300), r.randint(0, 900, 300)
    want = [bool((a[s : s + n] == b[s : s + n]).all()) for s, n in zip(starts, lengths, strict=True)]
    for most in (64, 1000, 1 << 20):
        assert list(words.equal_slices(a, starts, b, starts, lengths, most)) == want
