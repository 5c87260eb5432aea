"""Byte-level BPE encoding and decoding (operator 5) by a shuffle of the distinct words of the whole corpus.

Texts are cut into pre-tokens with their positions. Documents are taken in lists of about LIST_BYTES of text; a document's row keeps, for
each position, the number of its word in the list. The distinct words of a list are exploded to PACKS rows by their hash, each with a packed
array of words and their numbers. These rows are shuffled and sorted by pack, so each distinct word of the corpus is encoded once, beside
all lists that have it; its ids are joined back to these, and every list reassembles its documents by position. Positions are written
once, bucketed by list, so that they never move again (the catalogue holds that table only until the result is planned). Decoding looks ids up in the table of token bytes, whose size the vocabulary fixes.

Defined results: null and empty texts have no tokens and hash as empty bytes. Repeated rows and repeated or null doc_ids give one
result row each. Texts are taken whole at any length. An empty table gives an empty result. Other columns are ignored.
"""

import base64
import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segment import Distinct, ragged
from .shared import parts, released, shared_dir, slices, text_bytes
from .words import Spans, mix

#: Bytes of text whose words share one list, and bytes of text that are cut at once.
LIST_BYTES, PIECE = 16 << 20, 1 << 18
#: Distinct words that are hashed at once.
HASHED = 1 << 14
#: Bytes of ids and text that a task hands on at once.
OUT_BYTES = 4 << 20


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


#: Parts of all words by hash: a task remembers the words of one of them.
PACKS = 1024
LISTED = "list long, doc_id long, at array<int>, pack int, words binary, sizes binary, numbers binary"
LISTED_ARROW = pa.schema([("list", pa.int64()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("pack", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("numbers", pa.binary())])


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, all first ones before all second ones and so on, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unsqueeze(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_of(words: list[bytes]) -> np.ndarray:
    """The pack of each word, by a hash of its bytes; HASHED words at once, as hashes take some fifty times the memory of what they are made of."""
    out = np.empty(len(words), np.int32)
    for i in range(0, len(words), HASHED):
        some = words[i : i + HASHED]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(sizes)
        h = Spans(mix(np.frombuffer(b"".join(some), np.uint8).astype(np.uint64) + np.uint64(1))).hash(ends - sizes, ends)
        out[i : i + HASHED] = h % np.uint64(PACKS)
    return out


def listing(batches):
    """(doc_id, text) to rows of documents (list, doc_id, at) and rows of words (list, pack, words, sizes, numbers): at holds the numbers of a document's words, in order.

    A list's words are numbered by falling frequency, so that most numbers are small.
    """
    from pyspark import TaskContext

    number, place, ids, places, sizes, held = TaskContext.get().partitionId() << 32, {}, [], [], [], 0
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets, PIECE):
            found = Distinct([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()], True)
            to = np.fromiter((place.setdefault(w, len(place)) for w in found.words()), np.int32, len(found))
            places.append(to[found.at]), sizes.extend(np.diff(found.first).tolist()), ids.extend(batch.column(0).slice(i, j - i).to_pylist())
            held += int(offsets[j] - offsets[i])
            if held >= LIST_BYTES:
                yield from listed(number, place, ids, places, sizes)
                number, place, ids, places, sizes, held = number + 1, {}, [], [], [], 0
    if ids:
        yield from listed(number, place, ids, places, sizes)


def listed(number: int, place: dict[str, int], ids: list, places: list[np.ndarray], sizes: list[int]):
    at = np.concatenate(places)
    places.clear()
    often = np.argsort(-np.bincount(at, minlength=len(place)), kind="stable")
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    at, words = rank[at], list(place)
    place.clear()
    words = [words[k].encode() for k in often.tolist()]
    pack = pack_of(words)
    order = np.argsort(pack, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(pack[order], prepend=-1)), len(order))
    rows = []
    for i, j in itertools.pairwise(cuts.tolist()):
        own = [words[k] for k in order[i:j].tolist()]
        rows.append((pack[order[i]], squeeze(np.frombuffer(b"".join(own), np.uint8)), squeeze(np.fromiter(map(len, own), np.uint32, j - i)), squeeze(order[i:j].astype(np.uint32))))
    if rows:
        yield columns(list=np.full(len(rows), number), **dict(zip(("pack", "words", "sizes", "numbers"), zip(*rows, strict=True), strict=True)))
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(OUT_BYTES // 4, ends[-1] + OUT_BYTES // 4, OUT_BYTES // 4), "right") if len(ends) else []
    for i, j in itertools.pairwise(sorted({0, *np.minimum(np.asarray(cuts, np.int64) + 1, len(ids)).tolist(), len(ids)})):
        first = ends[i] - sizes[i]
        offsets = np.append(0, ends[i:j] - first).astype(np.int32)
        yield columns(list=np.full(j - i, number), doc_id=ids[i:j], at=pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[first : ends[j - 1]])))


def columns(**given) -> pa.RecordBatch:
    """A batch of LISTED; columns that aren't given are null."""
    n = len(given["list"])
    return pa.RecordBatch.from_arrays([given[f.name] if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in LISTED_ARROW], schema=LISTED_ARROW)


def coding(path: str, pattern: str):
    """Rows (list, pack, words, sizes, numbers), sorted by pack, to (list, numbers, ids, counts): each word of a pack is encoded once."""

    def run(batches):
        encode, table, last, known = encoding(path, pattern).encode_ordinary, ranks(path), None, {}

        def ids_of(w: bytes) -> tuple[int, ...]:
            found = known.get(w)
            if found is None:
                found = known[w] = (table[w],) if w in table else tuple(encode(w.decode()))
            return found

        for batch in batches:
            out = []
            for pack, data, sizes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if pack != last:
                    last, known = pack, {}
                raw, ends = unsqueeze(data, np.uint8).tobytes(), np.cumsum(unsqueeze(sizes, np.uint32).astype(np.int64)).tolist()
                found = [ids_of(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                n = np.fromiter(map(len, found), np.uint32, len(found))
                out.append((squeeze(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum()))), squeeze(n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *(pa.array([x[k] for x in out], pa.binary()) for k in (0, 1))], ["of", "numbers", "ids", "counts"])

    return run


@functools.cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of all tokens by id, their bytes one after another, and where each begins."""
    out = [b""] * (max(ranks(path).values()) + 1)
    for w, r in ranks(path).items():
        out[r] = w
    n = np.fromiter(map(len, out), np.int64, len(out))
    return n, np.frombuffer(b"".join(out), np.uint8), np.cumsum(n) - n


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the lists' sizes."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def joined(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a column of squeezed arrays."""
    return np.concatenate([np.zeros(0, np.uint32), *(unsqueeze(x, np.uint32) for x in column.to_pylist())])


def reassembling(path: str):
    """The documents of one list (doc_id, at) and the ids of its words (numbers, ids, counts) to one row for each document."""

    def run(_key, docs: pa.Table, words: pa.Table) -> pa.Table:
        rows, done, held = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

        length, table, begin = token_bytes(path)
        ids, n = joined(words.column("ids")).astype(np.int32), joined(words.column("counts")).astype(np.int64)
        row = np.empty(len(n), np.int64)
        row[joined(words.column("numbers"))] = np.arange(len(n))
        first = np.cumsum(n) - n
        at, sizes = flat(docs.column("at")) if docs.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        end = 0
        for doc, size in zip(docs.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
            own = ragged(n, row[at[end : end + size]], ids, first).astype("<u4") if size else np.zeros(0, "<u4")
            rows.append((doc, len(own), own.tobytes(), ragged(length, own, table, begin).tobytes()))
            end, held = end + size, held + 8 * len(own)
            if held >= OUT_BYTES:
                done.append(batch())
                rows, held = [], 0
        if rows:
            done.append(batch())
        return pa.Table.from_batches(done, OUT)

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and decoded (bytes) for each row of docs (doc_id, text)."""
    spark, n = docs.sparkSession, parts(docs)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    name = f"lists_{uuid.uuid4().hex}"
    # a table bucketed by list: the join by list below finds the positions where they are
    texts.mapInArrow(released(listing), LISTED).write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, "list").saveAsTable(name)
    made = spark.table(name)
    words = made.filter("pack is not null").select("list", "pack", "words", "sizes", "numbers").repartition(n, "pack").sortWithinPartitions("pack")
    ids = words.mapInArrow(released(coding(path, pattern)), "of long, numbers binary, ids binary, counts binary")
    places = made.filter("at is not null").select("list", "doc_id", "at")
    done = places.groupBy("list").cogroup(ids.groupBy("of")).applyInArrow(reassembling(path), "doc_id long, n_tokens long, ids binary, decoded binary")
    spark.sql(f"DROP TABLE {name}")  # the catalogue forgets it; its files, which the plan has resolved, stay in the shared folder
    return done
