import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeatlas.llm import repair_grammar as g
from codeatlas.llm.queries import vocabulary_file

PATH = vocabulary_file("word_bpe_49k.json")


def ids_of(text):
    return [*g.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, g.END]


def test_positions(odd, odd_documents):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"], r["start"]) for r in g.token_positions(g.write_shards(odd, PATH, 5000)).collect())
    want, start = [], 0
    import xxhash

    signed = lambda t: 42 if t is None else int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)  # noqa: E731  Spark's xxhash64
    for doc, text, *_ in sorted(odd_documents, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1]), d[1] is not None, (d[1] or "").encode())):
        ids = ids_of(text)
        want.append((doc is not None, doc or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), start))
        start += len(ids)
    assert got == sorted(want)


def test_empty_table(none):
    assert g.token_positions(g.write_shards(none, PATH)).count() == 0


def test_compression_round_trip():
    r = random.Random(3)
    phrases = [[r.randint(2, 900) for _ in range(r.randint(2, 9))] for _ in range(30)]
    ids = np.array([x for _ in range(600) for x in [*r.choice(phrases), *([g.END] if r.random() < 0.1 else [])]] + [7] * 301 + [g.END], np.int32)
    symbols, rules, base, lengths = g.compress(ids)
    grammar = g.Grammar(rules, base, lengths)
    assert (grammar.expand(symbols) == ids).all()
    assert [len(grammar.expand(np.array([x]))) for x in range(base, base + len(rules))] == lengths.tolist()
    assert len(symbols) < len(ids) / 2
    assert len(symbols) + 2 * len(rules) < len(ids)


def test_random_access(odd):
    shards = g.write_shards(odd, PATH, 4000)
    row = max(shards.collect(), key=lambda r: sum(r["n_ids"])).asDict()
    grammar = g.Grammar(np.array(row["rules"], np.int32).reshape(-1, 2), row["base"], np.array(row["lengths"], np.int64))
    symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2").astype(np.int64)
    for (_, k, ids), end, n in zip(g.shard_documents(row), np.cumsum(row["n_symbols"]), row["n_symbols"], strict=True):
        own = symbols[end - n : end]
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids))):
            assert (grammar.span(own, a, b) == ids[a:b]).all()
            assert (g.document(row, k, a, b) == ids[a:b]).all()


def apart(symbols, last):
    """The largest number of places, no two of them overlapping, of any pair whose first symbol doesn't end a document."""
    places = {}
    for i, (a, b) in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        if last[a] != g.END:
            own = places.setdefault((a, b), [])
            if not own or own[-1] < i - 1:
                own.append(i)
    return max(map(len, places.values()), default=0)


@given(st.lists(st.sampled_from([1, 2, 2, 2, 3, 3, 4, 50_000]), max_size=300))
@settings(max_examples=150, deadline=None)
def test_any_ids(ids):
    ids = np.array([*ids, g.END], np.int32)
    symbols, rules, base, lengths = g.compress(ids)
    grammar = g.Grammar(rules, base, lengths)
    assert (grammar.expand(symbols) == ids).all()
    last = {x: int(grammar.expand(np.array([x]))[-1]) for x in set(symbols.tolist())}
    assert apart(symbols, last) < 2


def test_rare_phrases_are_replaced():
    """Thousands of phrases that occur a few times each: none of their pairs is left twice."""
    r = random.Random(9)
    phrases = [[r.randint(2, 40_000) for _ in range(6)] for _ in range(4000)]
    order = [p for p in phrases for _ in range(5)]
    r.shuffle(order)
    ids = np.array([x for p in order for x in p] + [g.END], np.int32)
    symbols, rules, base, lengths = g.compress(ids)
    grammar = g.Grammar(rules, base, lengths)
    assert (grammar.expand(symbols) == ids).all()
    assert apart(symbols, {x: int(grammar.expand(np.array([x]))[-1]) for x in set(symbols.tolist())}) < 2
    assert len(symbols) <= len(order) + 1


def test_words_that_share_a_hash(monkeypatch):
    from codeatlas.llm import segment

    monkeypatch.setattr(segment.Spans, "hash", lambda self, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["The cat sat on the mat, and the dog ran.", "", "dog dog cat"]
    assert [[*x, g.END] for x in map(np.ndarray.tolist, g.WordEncoder(PATH)(texts))] == [ids_of(t) for t in texts]


def test_no_pair_is_left():
    """Copies shrink to a symbol or so each, however rare their ids are, and no pair that may be replaced occurs twice."""
    r = random.Random(4)
    copy = [r.randint(2, 40_000) for _ in range(400)]
    ids = np.array([x for k in range(200) for x in [*copy, *(r.randint(2, 40_000) for _ in range(20)), g.END]] + [3] * 999 + [g.END], np.int32)
    symbols, rules, base, lengths = g.compress(ids)
    grammar = g.Grammar(rules, base, lengths)
    assert (grammar.expand(symbols) == ids).all()
    inner = [grammar.expand(np.array([x]))[:-1] for x in range(base, base + len(rules))]
    assert not any((x == g.END).any() for x in inner)  # never across the end of a document
    assert apart(symbols, {x: int(grammar.expand(np.array([x]))[-1]) for x in set(symbols.tolist())}) < 2
    assert len(symbols) < 200 * 26


def test_every_code_point(spark):
    """Ids equal to the library's for each code point between letters and alone; Python's tables are older than the library's for some thousand."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    tok, encode = g.tokenizer(PATH), g.WordEncoder(PATH)
    for i in range(0, len(texts), 1024):
        want = [e.ids for e in tok.encode_batch(texts[i : i + 1024], add_special_tokens=False)]
        assert [x.tolist() for x in encode(texts[i : i + 1024])] == want
    df = spark.createDataFrame([(1, "a\u1c89b word"), (2, "plain"), (3, "\ua7cb \U000105c0x")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in g.token_positions(g.write_shards(df, PATH)).collect()}
    assert got == {d: zlib.crc32(np.array(ids_of(t), "<u4").tobytes()) for d, t in df.collect()} and got[1] == 2097660701


def test_rows_of_one_id_are_shared(spark):
    """Rows without doc_id, a third of all or more, don't meet in one task."""
    df = spark.createDataFrame([(None, f"text {k}") for k in range(400)], "doc_id long, text string").repartition(4)
    assert len({r["part"] for r in g.write_shards(df, PATH).select("part").collect()}) > 1


WORDS = ["a" * 14, "a" * 15, "a" * 16, "b" * 8, "b" * 7, "b" * 8 + "a", "é" * 7, "é" * 7 + "b", "é" * 8, "\0", "\0" * 2, "\0" * 15, "\0" * 16, "\x1c", "x\x1cy", "٣٤", "𝟘𝟙", "Ⅷ", "日本語" * 4, "ΑΣ", "it's", "it'", "'s", "'LL", "é'd", "e\u0301", "\u0301", "\x7f\x80", "\xa0\xad", "\u2003\u2028", "𐐀x"]


def test_words_of_every_length():
    """Words about as long as two values hold, of NUL and other control characters, and of code points of two to four bytes."""
    r = random.Random(2)
    texts = [*WORDS, "", " ", *(r.choice(("", " ", "\n")).join(r.choices(WORDS, k=r.randint(1, 40))) for _ in range(400))]
    encode = g.WordEncoder(PATH)
    for _ in range(2):  # new words, then known ones
        assert [[*x, g.END] for x in map(np.ndarray.tolist, encode(texts))] == [ids_of(t) for t in texts]


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_any_texts(texts):
    assert [[*x, g.END] for x in map(np.ndarray.tolist, g.encoder(PATH)(texts))] == [ids_of(t) for t in texts]


def test_short_words_that_share_a_place(monkeypatch):
    monkeypatch.setattr(g.ShortWords, "home", lambda self, low, high: np.zeros(len(low), np.int64) + int(self.mask))
    texts = ["The cat sat on the mat, and the dog ran.", "", "dog dog cat", " ".join(f"w{k}x" for k in range(300))]
    encode = g.WordEncoder(PATH)
    for _ in range(2):
        assert [[*x, g.END] for x in map(np.ndarray.tolist, encode(texts))] == [ids_of(t) for t in texts]


def test_many_words_are_kept(monkeypatch):
    """The table grows with its words, and is emptied beyond KNOWN."""
    r = random.Random(5)
    encode = g.WordEncoder(PATH)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(3, 20))) for _ in range(30_000)) for _ in range(2)]
    want = [e.ids for e in encode.tok.encode_batch(texts, add_special_tokens=False)]
    assert [encode([t])[0].tolist() for t in texts] == want
    n = encode.count
    assert len(encode.short.place) > 1 << 16 and [encode([t])[0].tolist() for t in texts] == want and encode.count == n
    monkeypatch.setattr(g, "KNOWN", 1000)
    assert encode(texts[:1])[0].tolist() == want[0] and encode.count < n


def test_known_words_are_cheap():
    """Coding known words costs less CPU time than only listing the distinct ones as strings, which the encoder used to do for each slice."""
    from codeatlas.llm.segment import Distinct

    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 12))) for _ in range(100_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    encode, least = g.WordEncoder(PATH), []
    for run in (lambda: encode(texts), lambda: Distinct(texts, False).words()):
        run()
        spent = []
        for _ in range(7):
            begin = time.process_time()
            run()
            spent.append(time.process_time() - begin)
        least.append(min(spent))
    assert least[0] < least[1]


@given(st.lists(st.sampled_from([1, 2, 2, 2, 3, 3, 4, 50_000]), max_size=300), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_symbols_that_stay(ids, copies):
    """The same symbols and rules whether symbols move together after each round, stay after the first, or stay once few pairs are left."""
    r = random.Random(len(ids))
    ids = np.array([*ids, g.END, *[x for _ in range(copies) for x in [*range(100, 160), r.randint(2, 90), g.END]]], np.int32)
    found, few = [], g.FEW
    try:
        for g.FEW in (1 << 40, 1, few):
            found.append(g.compress(ids))
    finally:
        g.FEW = few
    for other in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0], other, strict=True))
    symbols, rules, base, lengths = found[1]
    assert (g.Grammar(rules, base, lengths).expand(symbols) == ids).all()


def test_digests_are_those_of_ids(odd):
    shards = g.write_shards(odd, PATH, 5000)
    want = sorted((r["part"], r["shard"], r["before"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in g.read_shards(shards).collect())
    assert sorted(tuple(r)[1:] for r in g.read_shards(shards, digest=True).collect()) == want
