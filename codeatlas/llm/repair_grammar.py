"""Token-ID output (operator 8): ids in Re-Pair grammar compression, written by Spark, with random access.

Documents are range-partitioned and sorted by doc_id (rows of equal doc_ids by a hash of their texts); each partition encodes its texts and writes shards of about SHARD_IDS ids. A
shard repeatedly replaces its most frequent pairs of ids by nonterminals, until no pair can be replaced twice, and never across the end
of a document. Its row stores rules, the expansion length of each rule, the symbols, and for each document its number of symbols and of
ids, so that one document, or a range of its ids, is decoded alone.

Defined results: null and empty texts have only the end id. Rows with a null doc_id come first, equal doc_ids in the order of hashes of their
texts; repeated rows are written each. A text is never split between shards. An empty table gives no shards and an empty result.
Other columns are ignored.
"""

import codecs
import functools
import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segment import byte_classes, cut, unknown
from .shared import parts, slices, small, text_bytes, written
from .words import BASE, U, mix

END, SHARD_IDS, SHARE, FEW = 1, 1 << 18, 4, 4
KNOWN = 500_000  # words whose ids a process remembers
SLICE = 2 << 20  # bytes of text that are cut into words at once


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The characters that the tokenizer's vocabulary has for bytes; a blank stays one between words, in which it never is.
PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = "".join(chr(b) if b in PLAIN or b == 32 else chr(256 + sum(x not in PLAIN for x in range(b))) for b in range(256))


@functools.cache
def word_coder(path: str):
    """The same model for words that are already cut, lower-cased and spelt in LETTERS, with blanks between them."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    return Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))


class WordEncoder:
    """Ids of texts under a tokenizer that lower-cases, drops white space and codes each word on its own; words are coded once.

    Texts with special tokens, or with code points that Python's tables don't know, go whole to the library.
    """

    def __init__(self, path: str):
        self.tok, self.path = tokenizer(path), path
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special]
        self.ends = np.array([w.endswith("</w>") for w, _ in sorted(self.tok.get_vocab().items(), key=lambda x: x[1])])
        self.clear()

    def clear(self) -> None:
        self.short, self.long = ShortWords(), {}  # the numbers of words
        self.flat, self.begin, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0  # word k has flat[begin[k] : begin[k + 1]]

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # without the rule for final sigma

    def learn(self, words: list[bytes]) -> None:
        """Codes new words, some hundred in one text: a word's last id, and only that, is one that ends words."""
        for i in range(0, len(words), 1 << 16):
            part, k = words[i : i + (1 << 16)], self.count
            found = word_coder(self.path).encode_batch_fast([codecs.charmap_decode(b" ".join(part[a : a + 256]), "strict", LETTERS)[0] for a in range(0, len(part), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer doesn't code words on their own")
            at = int(self.begin[k])
            while at + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while k + len(part) + 1 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.flat[at : at + len(ids)] = ids
            self.begin[k + 1 : k + 1 + len(part)] = at + stops
            self.count += len(part)

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word; new ones are coded first."""
        row, n = np.empty(len(starts), np.int64), ends - starts
        short = np.flatnonzero(n <= SHORT)
        low, high = spelling(data, starts[short], n[short])
        found = self.short.find(low, high)
        new = np.flatnonzero(found < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            one = order[first]
            found[order] = self.count - 1 + np.cumsum(first)
            self.short.add(low[one], high[one], found[one])
            self.learn([data[a:b] for a, b in zip(starts[short[one]].tolist(), ends[short[one]].tolist(), strict=True)])
        row[short] = found
        if len(short) < len(row):
            rest = np.flatnonzero(n > SHORT)
            words = [data[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            new = [w for w in dict.fromkeys(words) if w not in self.long]
            self.long.update(zip(new, range(self.count, self.count + len(new)), strict=True))
            self.learn(new)
            row[rest] = np.fromiter(map(self.long.__getitem__, words), np.int64, len(words))
        return row

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if "<" in t and any(s in t for s in self.special)} | unknown(texts)
        if self.count > KNOWN:
            self.clear()
        coded = [self.normal(t).encode() if k not in odd else b"" for k, t in enumerate(texts)]
        data, offsets = b"".join(coded), np.append(0, np.cumsum([len(t) for t in coded], dtype=np.int64))
        points = np.frombuffer(data, np.uint8)
        starts, stops = cut(points, offsets, False, byte_classes(points))
        row = self.numbers(data, starts, stops)
        start = self.begin[row]
        n = self.begin[row + 1] - start
        ends = np.append(0, np.cumsum(n))
        every = self.flat[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
        ends = ends[np.searchsorted(starts, offsets)].tolist()
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32) if k in odd else every[ends[k] : ends[k + 1]] for k, t in enumerate(texts)]


SHORT = 15  # bytes of a word that fit two 64-bit values together with their number
LOW, HIGH, SIZE = (np.array([f(n) for n in range(SHORT + 1)], np.uint64) for f in (lambda n: (1 << 8 * min(n, 8)) - 1, lambda n: (1 << 8 * max(n - 8, 0)) - 1, lambda n: n << 56))


def spelling(data: bytes, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values that hold the bytes of each word, SHORT at most, and their number: equal for equal words only."""
    eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))  # the eight bytes from each place on
    low, high = eight[starts], eight[starts + 8]
    low &= LOW[n]
    high &= HIGH[n]
    high |= SIZE[n]
    return low, high


class ShortWords:
    """Numbers of words by their spelling, for many words at once: a table of places where a word stands at its hash or behind it."""

    def __init__(self):
        self.low, self.high, self.numbers = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32))
        self.table()

    def table(self) -> None:
        size = max(1 << 16, 1 << (4 * len(self.low)).bit_length())
        self.mask, self.place = U(size - 1), np.zeros(size, np.int32)  # 0: free, else a word's place among all plus 1
        self.put(0)

    def put(self, first: int) -> None:
        """Enters the words from that place on, all of them new."""
        place = np.arange(first + 1, len(self.low) + 1, dtype=np.int32)
        at = self.home(self.low[first:], self.high[first:])
        while len(place):
            free = self.place[at] == 0
            self.place[at[free]] = place[free]
            left = self.place[at] != place
            place, at = place[left], (at[left] + 1) & int(self.mask)

    def home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ high * BASE) & self.mask).astype(np.int64)

    def add(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        first = len(self.low)
        self.low, self.high, self.numbers = np.append(self.low, low), np.append(self.high, high), np.append(self.numbers, numbers.astype(np.int32))
        if 2 * len(self.low) > len(self.place):
            self.table()
        else:
            self.put(first)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is new."""
        out, at, left = np.full(len(low), -1, np.int64), self.home(low, high), np.arange(len(low))
        while len(left):
            place = self.place[at]
            taken = np.flatnonzero(place)
            left, at, place, low, high = (x[taken] for x in (left, at, place - 1, low, high))
            same = (self.low[place] == low) & (self.high[place] == high)
            out[left[same]] = self.numbers[place[same]]
            left, at, low, high = left[~same], (at[~same] + 1) & int(self.mask), low[~same], high[~same]
        return out


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder a process: a later task finds the words of earlier ones."""
    return WordEncoder(path)


def places(at: np.ndarray, ends: np.ndarray, pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Those of the places `at` (ascending) of pairs, with places `ends` of their second symbols, that are replaced: where pairs overlap, the one of the highest rank, in a run of one pair every second."""
    near = at[1:] == ends[:-1]
    taken = np.ones(len(at), bool)
    taken[1:] &= ~near
    taken[:-1] &= ~near
    left = np.flatnonzero(~taken)  # only those beside another one need ranks
    rank = rank[pair[at[left]]]
    while len(left):
        near = at[left[1:]] == ends[left[:-1]]
        up, down = near & (rank[1:] > rank[:-1]), near & (rank[1:] < rank[:-1])
        win = np.ones(len(left), bool)
        win[:-1] &= ~up
        win[1:] &= ~down
        same = near & ~up & ~down
        if same.any():
            k = np.arange(len(left))
            win &= (k - np.maximum.accumulate(np.where(np.append(False, same), 0, k))) % 2 == 0
        taken[left[win]] = True
        done = win.copy()
        done[1:] |= win[:-1] & near
        done[:-1] |= win[1:] & near
        left, rank = left[~done], rank[~done]
    return at[taken]


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Symbols, rules (two symbols each), the number of the first nonterminal, and the length in ids of each rule's expansion.

    Pairs are replaced until none can be replaced twice; what ends with END never is the first of a pair. Each position holds the number of its
    pair, and only positions beside a replaced pair get new ones. A round takes the most frequent pairs: those over half as frequent as the first,
    and more of them if these hold under a SHAREth of all positions. Among overlapping pairs the more frequent one goes first; the others wait.
    Symbols move together after a round until pairs that occur twice hold under one in FEW positions; then they stay, and a round looks at those alone.
    """
    s = ids.astype(np.int32)
    base = max(int(s.max(initial=0)), END) + 1
    ends, size = np.zeros(base, bool), np.ones(base, np.int64)  # whether a symbol ends a document; its length in ids
    ends[END] = True
    rules, many, left = [np.zeros((0, 2), np.int32)], 0, len(s)
    after = before = live = None  # once symbols stay: their neighbours, len(s) and -1 for none, and the positions of pairs with a number

    def follower(at: np.ndarray) -> np.ndarray:
        return at + 1 if after is None else after[at]

    def numbered(at: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers from `first` on for the pairs at these positions, -1 for a pair that occurs once; the symbols and counts of the numbered ones."""
        wide, n = (base + many).bit_length(), len(at).bit_length()
        if 2 * wide + n < 63:  # pairs with their places behind them: sorting values is faster than sorting places by values
            key = np.sort((s[at].astype(np.int64) << wide | s[follower(at)]) << n | np.arange(len(at)))
            order, key = key & ((1 << n) - 1), key >> n
        else:
            key = s[at].astype(np.int64) << wide | s[follower(at)]
            order = np.argsort(key)
            key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
        n = np.diff(np.append(new, len(key)))
        often, out = n > 1, np.empty(len(at), np.int64)
        out[order] = np.repeat(np.where(often, first - 1 + np.cumsum(often), -1), n)
        key = key[new[often]]
        return out, np.stack([key >> wide, key & ((1 << wide) - 1)], 1).astype(np.int32), n[often]

    pair = np.full(len(s), -1, np.int64)
    at = np.flatnonzero(~ends[s[:-1]])
    pair[at], symbols, count = numbered(at, 0)
    while (top := int(count.max(initial=0))) > 1:
        few = np.bincount(np.minimum(count, 4096))
        held = np.cumsum((few * np.arange(len(few)))[::-1])[::-1]  # positions of pairs of at least that count
        least = max(2, min(top // 2 + 1, int(np.flatnonzero(held >= min(held[2], left // SHARE))[-1])))
        wanted, at = np.flatnonzero(count >= least), live
        wanted = wanted[np.argsort(count[wanted], kind="stable")]
        while len(wanted):
            rank = np.zeros(len(count) + 1, np.int32)  # the last one is that of -1
            rank[wanted] = np.arange(1, len(wanted) + 1)
            at = np.flatnonzero((rank > 0)[pair]) if at is None else at[rank[pair[at]] > 0]
            taken = places(at, follower(at), pair, rank)
            ranks = rank[pair[taken]]
            used = np.bincount(ranks, minlength=len(wanted) + 1)[1:]
            if used.min() > 1:
                break
            if used[-1] < 2:  # the first choice lost places to itself only: a run of one symbol, which never will be worth a rule
                own = symbols[wanted, 0] == symbols[wanted, 1]
                count[wanted if own.all() else wanted[-1:]] = 0
            wanted = wanted[used > 1]
        if not len(wanted):
            continue
        made = symbols[wanted]
        rules.append(made)
        ends, size = np.append(ends, ends[made[:, 1]]), np.append(size, size[made].sum(1))
        name = base + many - 1 + ranks
        many += len(wanted)
        gone = follower(taken)
        first = taken[taken > 0] - 1 if after is None else before[taken][before[taken] >= 0]
        lost = []
        for beside in (taken, gone, first):
            lost.append(pair[beside])
            pair[beside] = -2
        lost = np.concatenate(lost)
        count = np.maximum(count - np.bincount(lost[lost >= 0], minlength=len(count)), 0)
        s[taken], left = name, left - len(taken)
        if after is None:
            keep = np.ones(len(s), bool)
            keep[gone] = False
            keep = np.flatnonzero(keep)
            s, pair = s[keep], pair[keep]
            at = np.flatnonzero(pair == -2)
            if held[2] < left // FEW:
                after, before, live = np.arange(1, left + 1), np.arange(-1, left), np.flatnonzero(pair >= 0)
                kept = np.ones(left, bool)
        else:
            kept[gone], pair[gone] = False, -1
            after[taken] = after[gone]
            before[after[gone]] = taken
            at = np.sort(np.concatenate([taken, first[pair[first] == -2]]))
        pair[at] = -1
        at = at[follower(at) < len(s)]
        at = at[~ends[s[at]]]
        pair[at], more, n = numbered(at, len(count))
        symbols, count = np.concatenate([symbols, more]), np.concatenate([count, n])
        if after is not None:
            live = np.sort(np.concatenate([live, at]))
            live = live[pair[live] >= 0]
            live = live[count[pair[live]] > 1]
            live = live[np.append(True, live[1:] != live[:-1])[: len(live)]]
    return s if after is None else s[kept], np.concatenate(rules), base, size[base:]


class Grammar:
    """Expansion of symbols from the top down: each step splits all nonterminals that are left, so work and memory follow the ids that are asked for."""

    def __init__(self, rules: np.ndarray, base: int, lengths: np.ndarray):
        self.rules, self.base = rules.astype(np.int64), base
        self.size = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])  # of every symbol's expansion

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.size[symbols])
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        symbols, at = symbols.astype(np.int64), ends - self.size[symbols]
        while len(symbols):
            leaf = symbols < self.base
            out[at[leaf]] = symbols[leaf]
            symbols, at = self.halves(symbols[~leaf], at[~leaf])
        return out

    def halves(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two symbols of each nonterminal, and where their expansions begin."""
        both = self.rules[symbols - self.base]
        return both.ravel(), np.stack([at, at + self.size[both[:, 0]]], 1).ravel()

    def span(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """The ids start to stop of a document, expanding only what covers them."""
        ends = np.cumsum(self.size[symbols])
        stop = max(start, min(stop, int(ends[-1]) if len(ends) else 0))
        out, symbols, at = np.empty(stop - start, np.int32), symbols.astype(np.int64), ends - self.size[symbols]
        while len(symbols):
            inside = (at < stop) & (at + self.size[symbols] > start)
            symbols, at = symbols[inside], at[inside]
            leaf = symbols < self.base
            out[at[leaf] - start] = symbols[leaf]
            symbols, at = self.halves(symbols[~leaf], at[~leaf])
        return out


SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("n_symbols", pa.list_(pa.int64())), ("base", pa.int32()), ("rules", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())), ("wide", pa.bool_()), ("symbols", pa.binary())])
SHARD_DDL = "part int, shard int, doc_ids array<long>, n_ids array<long>, n_symbols array<long>, base int, rules array<int>, lengths array<long>, wide boolean, symbols binary"


def pack(part: int, shard: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    n = np.array([len(x) for x in ids], np.int64)
    symbols, rules, base, lengths = compress(np.concatenate(ids))
    # END is last in each document, so the ends of documents in symbols are where their ids end
    ends = np.searchsorted(np.cumsum(Grammar(rules, base, lengths).size[symbols]), np.cumsum(n)) + 1
    wide = base + len(rules) > 1 << 16
    row = (part, shard, docs, n, np.diff(ends, prepend=0), base, rules.ravel(), lengths, wide, symbols.astype("<u4" if wide else "<u2").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SHARD, strict=True)], schema=SHARD)


def sharding(path: str, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, shard, encode, docs, ids, n = TaskContext.get().partitionId(), 0, encoder(path), [], [], 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, SLICE):
                for doc, x in zip(batch.column(0).slice(i, j - i).to_pylist(), encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]), strict=True):
                    docs.append(doc), ids.append(np.append(x, np.int32(END)))
                    n += len(x) + 1
                    if n >= shard_ids:
                        yield pack(part, shard, docs, ids)
                        shard, docs, ids, n = shard + 1, [], [], 0
        if docs:
            yield pack(part, shard, docs, ids)

    return run


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes docs (doc_id, text) and writes their shards to the shared folder; the rows of the written table."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # with a hash of the text in the range's key, rows of one doc_id or without any are shared by tasks too
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = rows.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order, "text")
    return written(dealt.mapInArrow(sharding(path, shard_ids), SHARD_DDL), "token-shards")


def grammar_of(row: dict) -> tuple[Grammar, np.ndarray]:
    """The grammar and the symbols of a shard row."""
    as_array = lambda x: x.values.to_numpy() if isinstance(x, pa.ListScalar) else np.array(x)
    symbols = row["symbols"].as_buffer() if isinstance(row["symbols"], pa.BinaryScalar) else row["symbols"]
    return Grammar(as_array(row["rules"]).astype(np.int32).reshape(-1, 2), row["base"], as_array(row["lengths"])), np.frombuffer(symbols, "<u4" if row["wide"] else "<u2")


def shard_documents(row: dict):
    """(doc_id, position in the shard, ids) of each document of one shard row."""
    grammar, symbols = grammar_of(row)
    ids, ends = grammar.expand(symbols), np.cumsum(row["n_ids"], dtype=np.int64).tolist()
    for k, (doc, a, b) in enumerate(zip(row["doc_ids"], [0, *ends[:-1]], ends, strict=True)):
        yield doc, k, ids[a:b]


def document(row: dict, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids, or those from start to stop, of the k-th document of a shard row: only its own symbols are read."""
    grammar, symbols = grammar_of(row)
    a = sum(row["n_symbols"][:k])
    return grammar.span(symbols[a : a + row["n_symbols"][k]], start, row["n_ids"][k] if stop is None else stop)


def read_shards(shards: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, part, shard, before, ids): each document's little-endian 32-bit ids, and the number of ids before it in its shard.

    digest: n_tokens and ids_crc32 instead, so that ids that are only counted and summed up don't leave the task.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f.name: batch.column(k)[i] if f.name in ("rules", "lengths", "symbols") else batch.column(k)[i].as_py() for k, f in enumerate(batch.schema)}
                docs, before, ids, sums, n = [], [], [], [], 0
                for doc, _, x in shard_documents(row):
                    x = x.astype("<i4", copy=False)
                    docs.append(doc), before.append(n), ids.append(len(x) if digest else x.tobytes())
                    n += len(x)
                    if digest:
                        sums.append(zlib.crc32(x))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([row["part"]] * len(docs), pa.int32()), pa.array([row["shard"]] * len(docs), pa.int32()), pa.array(before, pa.int64()), *([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())] if digest else [pa.array(ids, pa.binary())])], names)

    names = ["doc_id", "part", "shard", "before", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]
    return shards.mapInArrow(run, "doc_id long, part int, shard int, before long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary"))


def token_positions(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards alone."""
    totals = written(shards.select("part", "shard", F.expr("aggregate(n_ids, 0L, (a, x) -> a + x)").alias("n")), "shard-totals")
    before = lambda order, within="": F.expr(f"coalesce(sum(n) over ({within} order by {order} rows between unbounded preceding and 1 preceding), 0L)")
    parts_before = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", before("part").alias("of_parts"))  # one row a partition
    starts = totals.withColumn("first", before("shard", "partition by part")).join(F.broadcast(parts_before), "part").select("part", "shard", (F.col("first") + F.col("of_parts")).alias("first"))
    return read_shards(shards, digest=True).join(small(written(starts, "shard-starts")), ["part", "shard"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
