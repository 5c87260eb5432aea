"""Line dedup (operator 11) with two Bloom filters, of keys seen once and seen twice.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends, A-Z in lower case. Keys of at least `least_chars` code points that are
found in at least `least_docs` documents lose all their lines but those in the largest doc_id that holds them.

Three passes over the texts, none of which moves a text to another task:
1. Each task puts the distinct keys of every row into a filter of its own: bits hit once, and bits hit twice or more. Filters travel as
   compressed segments, and a segment's task adds up what it gets: a bit counts as hit twice if any task says so or two tasks hit it.
   A key of two rows has all its bits in the second filter, so no repeat is ever missed.
2. Lines whose bits are all in the second filter are suspects. Only these are shuffled, with their keys: documents are counted exactly, by key and doc_id.
3. Lines are dropped. Confirmed keys are looked up in a broadcast while they are few (BROADCAST_KEYS, BROADCAST_BYTES), and compared byte by byte;
   beyond that, the hashes that a row loses are joined to it, with the same result.

The filters have at least BITS_A_LINE bits for each line, up to MOST_BITS, which bounds what is broadcast and what a task holds. Beyond that more
lines are suspects: that costs shuffling and changes no result.

Defined results: a null or empty text is one empty line. A document is a doc_id: rows that share one count as one document. Rows without doc_id
count for no key and hold none, but lose lines as others do. Equal rows have equal results, each its own row. An empty table gives an empty
result. Other columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, pieces, released, written
from .words import BYTE, LOWER, SPACE, Spans, U, equal_slices, mix

LEAST_CHARS, LEAST_DOCS = 20, 3
BITS_A_LINE, MOST_BITS, SEGMENTS = 8, 1 << 30, 1024
BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 32 << 20


class Lines:
    """Lines of texts, given as bytes and offsets: starts, ends, doc of each; at: those long enough to count, with keys low[first:last] and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least_chars: int):
        breaks = np.flatnonzero(data == 10)
        self.data, self.offsets = data, offsets
        self.counts = 1 + np.diff(np.searchsorted(breaks, offsets))
        n = int(self.counts.sum())
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        opening = np.cumsum(self.counts) - self.counts
        self.closing = opening + self.counts - 1
        self.starts, self.ends, inner = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool)
        self.starts[opening], inner[opening] = offsets[:-1], False
        self.starts[inner] = breaks + 1
        inner[:] = True
        self.ends[self.closing], inner[self.closing] = offsets[1:], False
        self.ends[inner] = breaks
        at = np.flatnonzero(self.ends - self.starts >= least_chars)
        solid, heads = np.flatnonzero(~SPACE[data]), np.flatnonzero((data & 0xC0) != 0x80)
        a, b = np.searchsorted(solid, self.starts[at]), np.searchsorted(solid, self.ends[at])
        at, a, b = at[a < b], a[a < b], b[a < b]
        first, last = solid[a], solid[b - 1] + 1
        full = np.searchsorted(heads, last) - np.searchsorted(heads, first) >= least_chars
        self.at, self.first, self.last = at[full], first[full], last[full]
        self.low = LOWER[data]
        self.hashes = Spans(BYTE[self.low]).hash(self.first, self.last) if len(self.at) else np.zeros(0, U)

    def distinct(self) -> np.ndarray:
        """Positions in at of one line for each key of each text."""
        return np.unique(np.stack([self.doc[self.at].astype(U), self.hashes]), axis=1, return_index=True)[1] if len(self.at) else np.zeros(0, np.int64)


def bits(hashes: np.ndarray, size: int, k: int) -> np.ndarray:
    """k positions below size, a power of two, of each hash: one row of positions a hash."""
    a, step = mix(hashes), mix(hashes + U(0x632BE59BD9B4E019)) | U(1)
    return ((a[:, None] + step[:, None] * np.arange(k, dtype=U)) & U(size - 1)).astype(np.int64)


def marked(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def mark(filter_: np.ndarray, at: np.ndarray) -> None:
    """Sets bits at sorted positions without repeats."""
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        filter_[byte[first]] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), first)


def filters(size: int, k: int, segments: int, least_chars: int):
    """A task's texts to its two filters: (segment, once, twice)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size >> 3, np.uint8), np.zeros(size >> 3, np.uint8)
        for batch in batches:
            for _, data, offsets in pieces(batch):
                lines = Lines(data, offsets, least_chars)
                at, times = np.unique(bits(lines.hashes[lines.distinct()], size, k), return_counts=True)
                mark(twice, at[(times > 1) | marked(once, at)])
                mark(once, at)
        width = (size >> 3) // segments
        for i in range(0, segments, 64):
            full = [j for j in range(i, min(i + 64, segments)) if once[j * width : (j + 1) * width].any()]
            packed = [[zlib.compress(x[j * width : (j + 1) * width].tobytes(), 1) for j in full] for x in (once, twice)]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["segment", "once", "twice"])

    return run


def added(batches) -> Iterator[pa.RecordBatch]:
    """Segments of many tasks to one of each: (segment, twice)."""
    have: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for j, *packed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
            if j not in have:
                have[j] = [once.copy(), twice.copy()]
            else:
                have[j][1] |= twice | (have[j][0] & once)
                have[j][0] |= once
    for j, (_, twice) in have.items():
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["segment", "twice"])


def suspects(twice, size: int, k: int, least_chars: int):
    """(doc_id, tag, text) to the lines whose bits were all hit twice: doc_id, tag, hash, key; once for each key of a row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                lines = Lines(data, offsets, least_chars)
                at = lines.distinct()
                at = at[marked(twice.value, bits(lines.hashes[at], size, k)).all(1)]
                if len(at):
                    doc = pa.array(lines.doc[lines.at[at]])
                    low = lines.low.tobytes()
                    keys = pa.array([low[a:b] for a, b in zip(lines.first[at].tolist(), lines.last[at].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(doc), rows.column(1).take(doc), pa.array(lines.hashes[at].view(np.int64)), keys.cast(pa.string())], ["doc_id", "tag", "hash", "key"])

    return run


def without(lines: Lines, drop: np.ndarray) -> pa.Array:
    """The texts without the lines of a mask, the others joined by line feeds."""
    data, n = lines.data, len(lines.data)
    edge = np.zeros(n + 1, np.int8)
    edge[lines.starts[drop]] += 1
    edge[lines.ends[drop]] -= 1
    keep = np.cumsum(edge[:n], dtype=np.int8) == 0
    final = np.zeros(len(drop), bool)
    final[lines.closing] = True
    keep[lines.ends[drop & ~final]] = False
    kept = np.flatnonzero(~drop)
    tail = kept[np.append(lines.doc[kept][1:] != lines.doc[kept][:-1], True)] if len(kept) else kept
    keep[lines.ends[tail[~final[tail]]]] = False
    offsets = np.concatenate([[0], np.cumsum(keep)])[lines.offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])]).cast(pa.string())


class Known:
    """Confirmed keys, their hashes sorted, with the document that keeps each."""

    def __init__(self, hashes: np.ndarray, last: np.ndarray, keys: list[bytes]):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.last = hashes[order], last[order]
        sizes = np.array([len(x) for x in keys], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.blob, self.starts, self.sizes = np.frombuffer(b"".join(keys), np.uint8), starts[order], sizes[order]
        self.twins = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # keys of one hash at most

    def drops(self, lines: Lines, ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Which of lines.at are lost by their documents."""
        out = np.zeros(len(lines.at), bool)
        doc = lines.doc[lines.at]
        first = np.searchsorted(self.hashes, lines.hashes)
        for shift in range(self.twins):
            at = np.flatnonzero(first + shift < len(self.hashes))
            at = at[self.hashes[first[at] + shift] == lines.hashes[at]]
            know = first[at] + shift
            size = self.sizes[know]
            right = size == lines.last[at] - lines.first[at]
            at, know, size = at[right], know[right], size[right]
            same = equal_slices(lines.low, lines.first[at], self.blob, self.starts[know], size)
            out[at[same]] = (~valid[doc[at]] | (ids[doc[at]] != self.last[know]))[same]
        return out


def dropped(known, least_chars: int):
    """(doc_id, text, drops) to doc_id, n_lines, n_dropped, kept. known: a broadcast of Known, or None where drops has a row's lost hashes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                lines, drop = Lines(data, offsets, least_chars), np.zeros(0, bool)
                if known is not None:
                    ids = rows.column(0)
                    drop = known.value.drops(lines, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False))
                else:
                    lost = [np.array(x or [], np.int64).view(U) for x in rows.column(2).to_pylist()]
                    pairs = np.stack([np.repeat(np.arange(len(lost)), [len(x) for x in lost]).astype(U), np.concatenate([*lost, np.zeros(0, U)])])
                    drop = found(np.stack([lines.doc[lines.at].astype(U), lines.hashes]), pairs)
                mask = np.zeros(len(lines.doc), bool)
                mask[lines.at[drop]] = True
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lines.counts.astype(np.int64)), pa.array(np.bincount(lines.doc[mask], minlength=len(lines.counts)).astype(np.int64)), without(lines, mask)], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def found(pairs: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which columns of pairs are columns of among."""
    if not among.shape[1]:
        return np.zeros(pairs.shape[1], bool)
    _, code = np.unique(np.concatenate([pairs, among], axis=1), axis=1, return_inverse=True)
    code = code.reshape(-1)
    return np.isin(code[: pairs.shape[1]], code[pairs.shape[1] :])


def repeated_keys(texts: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """texts: (doc_id, tag, text). The written suspects, and the keys confirmed of them: hash, key, last (the document that keeps it)."""
    spark = texts.sparkSession
    n = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = min(most_bits, 1 << max(13, (BITS_A_LINE * n - 1).bit_length()))
    k, segments = max(1, min(4, size // max(n, 1))), min(SEGMENTS, size >> 13)
    own = texts.select("text").mapInArrow(released(filters(size, k, segments, least_chars)), "segment int, once binary, twice binary")
    sums = own.repartition(parts(texts), "segment").mapInArrow(released(added), "segment int, twice binary")
    twice, width = np.zeros(size >> 3, np.uint8), (size >> 3) // segments
    for j, packed in sums.collect():  # most_bits at most
        twice[j * width : (j + 1) * width] = np.frombuffer(zlib.decompress(packed), np.uint8)
    sent = spark.sparkContext.broadcast(twice)
    doubtful = written(texts.mapInArrow(released(suspects(sent, size, k, least_chars)), "doc_id long, tag long, hash long, key string"), "suspects")
    sent.unpersist()
    once = doubtful.filter("doc_id is not null").select("hash", "key", "doc_id").distinct()
    sure = once.groupBy("hash", "key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= least_docs)
    return doubtful, written(sure.select("hash", "key", "last"), "repeats")


def drop_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, broadcast_keys: int = BROADCAST_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without the dropped lines) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("tag"), F.col("text").cast("string"))
    doubtful, sure = repeated_keys(texts, least_chars, least_docs, most_bits)
    n, size = sure.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    if n <= broadcast_keys and size <= BROADCAST_BYTES:
        t = sure.toArrow()
        know = Known(t["hash"].to_numpy().view(U), t["last"].to_numpy(), [x.encode() for x in t["key"].to_pylist()])
        return texts.select("doc_id", "text").mapInArrow(released(dropped(spark.sparkContext.broadcast(know), least_chars)), schema)
    lost = doubtful.join(sure, ["hash", "key"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    lost = lost.groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.collect_set("hash").alias("drops"))
    both = texts.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    return both.select("doc_id", "text", "drops").mapInArrow(released(dropped(None, least_chars)), schema)
