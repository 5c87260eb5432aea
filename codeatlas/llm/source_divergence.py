"""Source divergence audit (operator 13): how far the word use of each source is from that of each other source of its language.

1. Terms are found in the concatenated UTF-8 bytes of many texts by a lookup table of bytes, hashed with xxhash, and grouped by hash; every slice is
   compared with the first of its group byte by byte, and slices that differ are told apart by their bytes. A slice of texts becomes counts of
   (lang, source, term) with the number of texts that hold the term; Spark sums these, combining before the shuffle.
2. A language keeps the terms of at least `least_docs` texts. Kept counts are dealt by language, block of sources and hash of the term to units of
   bounded size. A unit holds a matrix of sources times terms in compressed rows (CSR) and sums divergences of pairs of sources by reduceat:
   only places where either source has the term are visited; all other places of a pair are equal, and counted by V.
3. Sums of units are added by pair, each pair gives both directions, and ranks are windows over the rows of a group.

With count n of a group's N occurrences of V kept terms, p = 1 + floor(10^9 (n + 2) / (N + 2 V)) and f = floor((p - q)^2 / (p + q)), in whole numbers.
A language with S sources has S (S - 1) rows of pairs by definition; units of BLOCK times BLOCK sources bound what a task holds.

Defined results: null text, lang and source are empty strings, and an empty string is a language or source as any other. Every row is a text of its
own, repeated rows and ids too. Groups without terms have pairs (of value 0 if the language keeps no term) but no term rows. A language with
one source has no pairs. Ties go by item, as UTF-8. An empty table gives an empty result. Other columns are ignored.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts, pieces, released, small, written
from .words import LOWER, equal_slices

LEAST_DOCS, TOP = 10, 10
UNIT = 1 << 16  # kept counts of a unit, about
BLOCK = 256  # sources of a block
SLICE = 4 << 20  # bytes of texts counted together
UNITY = 10**9
#: Bytes of terms: letters of ASCII, and all of other characters.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of term bytes, none over the end of a text."""
    inside = TERM[data]
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1]
    e[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    s[edge] = inside[edge]
    back = edge[edge > 0] - 1
    e[back] = inside[back]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def hashed(raw: bytes, starts: np.ndarray, ends: np.ndarray, hash_: Callable[[bytes], int]) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 18):
        pairs = zip(starts[i : i + (1 << 18)].tolist(), ends[i : i + (1 << 18)].tolist(), strict=True)
        out[i : i + (1 << 18)] = np.fromiter((hash_(raw[a:b]) for a, b in pairs), np.uint64)
    return out


def grouped(low: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, hash_: Callable[[bytes], int]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal slices together (each group by position), and the number of each ordered slice's group."""
    h = hashed(raw, starts, ends, hash_)
    order = np.argsort(h, kind="stable")
    group = np.cumsum(np.append(False, h[order][1:] != h[order][:-1]))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = (ends - starts)[order]
    same = sizes == sizes[first][group]
    at = np.flatnonzero(same)
    same[at] = equal_slices(low, starts[order][at], low, starts[order][first][group[at]], sizes[at])
    if not same.all():  # equal hashes of different slices
        names: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            group[k] = names.setdefault(raw[starts[order[k]] : ends[order[k]]], len(first) + len(names))
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
    return order, group


def counted(hash_: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
    """(lang, source, text) to lang, source, term, n (occurrences) and docs (texts that hold it), for slices of texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [batch.column(c).dictionary_encode() for c in (0, 1)]
            of = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
            order = np.argsort(of, kind="stable")
            of = of[order]
            done = 0
            for rows, data, offsets in pieces(batch.take(pa.array(order)), "text", SLICE):
                own = of[done : done + rows.num_rows]
                done += rows.num_rows
                starts, ends = boundaries(data, offsets)
                if not len(starts):
                    continue
                low = LOWER[data]
                raw = low.tobytes()
                order, term = grouped(low, raw, starts, ends, hash_)
                doc = (np.searchsorted(offsets, starts, "right") - 1)[order]
                new_term, new_doc = np.append(True, term[1:] != term[:-1]), np.append(True, doc[1:] != doc[:-1])
                first = np.flatnonzero(new_term | np.append(True, own[doc[1:]] != own[doc[:-1]]))
                n = np.diff(np.append(first, len(term)))
                docs = np.add.reduceat((new_term | new_doc).astype(np.int64), first)
                at = pa.array(doc[first])
                words = [raw[a:b] for a, b in zip(starts[order[first]].tolist(), ends[order[first]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    return run


def share(n: np.ndarray, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 2) / (total + 2 v)); 0 where there is nothing to divide by."""
    below = np.maximum(total + 2 * v, 1)
    if n.max(initial=0) < (1 << 63) // UNITY - 2:
        return np.where(total + 2 * v > 0, 1 + UNITY * (n + 2) // below, 0)
    return np.array([1 + UNITY * (int(a) + 2) // int(b) for a, b in zip(*np.broadcast_arrays(n, below), strict=True)], np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row number (sorted), for n rows."""
    out = np.zeros(n, np.int64)
    if len(rows):
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[first]] = np.add.reduceat(values, first)
    return out


def unit(top: int, block: int):
    """The rows of one unit (heads of sources, which have no term, and kept counts) to partial sums of pairs and to candidates of terms."""

    def run(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        lang, lo, hi, part = (t.column(c)[0].as_py() for c in ("lang", "lo", "hi", "tb"))
        entry = t.column("term").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        head = np.flatnonzero(~entry)
        head = head[np.argsort(col("idx")[head])]
        idx, size, v, whole = (col(c)[head] for c in ("idx", "size", "v", "whole"))
        zero = share(np.zeros(len(idx), np.int64), size, v)
        words = t.column("term").combine_chunks().filter(pa.array(entry)).dictionary_encode()
        by_name = np.empty(len(words.dictionary), np.int64)
        by_name[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(by_name))
        term, row, n = by_name[words.indices.to_numpy()] if len(by_name) else np.zeros(0, np.int64), np.searchsorted(idx, col("idx")[entry]), col("n")[entry]
        order = np.lexsort((term, row))  # compressed rows: the columns and counts of each source in turn
        term, row, n = term[order], row[order], n[order]
        p = share(n, size[row], v[row])
        ends = np.searchsorted(row, np.arange(len(idx) + 1))
        out: list[tuple] = []
        left = np.flatnonzero(idx // block == lo)
        mine = slice(int(ends[left[0]]), int(ends[left[-1] + 1])) if len(left) else slice(0, 0)
        for b in np.flatnonzero(idx // block == hi):
            a = left[left < b] if lo == hi else left
            if not len(a):
                continue
            none = gap(zero[left], zero[b])
            other, has = np.full(len(by_name), zero[b]), np.zeros(len(by_name), bool)
            own = slice(int(ends[b]), int(ends[b + 1]))
            other[term[own]], has[term[own]] = p[own], True
            at = row[mine] - left[0]
            beyond = gap(p[mine], other[term[mine]]) - none[at]
            beyond -= np.where(has[term[mine]], gap(zero[row[mine]], other[term[mine]]) - none[at], 0)
            total = sums(at, beyond, len(left))
            for i in range(len(left)):
                total[i] += int((gap(zero[left[i]], p[own]) - none[i]).sum())
            if part == 0:
                total += v[left] * none
            out.append((idx[a], np.full(len(a), idx[b]), [None] * len(a), total[: len(a)]))
        if lo == hi:
            q = share(col("total")[entry][order], whole[row], v[row])
            f, more = gap(p, q), np.flatnonzero(p > q)
            more = more[np.lexsort((term[more], -f[more], row[more]))]
            first = np.flatnonzero(np.append(True, row[more][1:] != row[more][:-1])) if len(more) else more
            more = more[np.arange(len(more)) - first[np.cumsum(np.isin(np.arange(len(more)), first)) - 1] < top] if len(more) else more
            names = words.dictionary.take(pc.sort_indices(words.dictionary))
            out.append((idx[row[more]], np.full(len(more), -1), names.take(pa.array(term[more])).to_pylist(), f[more]))
        a, b, value = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1, 3))
        items = [y for x in out for y in x[2]]
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "item": pa.array(items, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n of the terms that a language keeps; total: the term's occurrences in the language; opens: true in one row of each term. Written."""
    found = docs.select("lang", "source", "text").mapInArrow(released(counted()), "lang string, source string, term string, n long, docs long")
    by_group = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    wide = by_group.withColumns({"total": F.sum("n").over(w), "held": F.sum("docs").over(w), "opens": F.col("source") == F.min("source").over(w)})
    return written(wide.filter(F.col("held") >= least_docs).select("lang", "source", "term", "n", "total", "opens"), "kept-counts")


def groups(docs: DataFrame, kept: DataFrame, unit_rows: int, block: int) -> DataFrame:
    """One row for each (lang, source): idx (its number in the language), size (N), v, whole (N of the language), tbs and blocks (numbers of units). Written."""
    counts = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("rows"), F.count(F.when(F.col("opens"), 1)).alias("v"))
    all_ = docs.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").na.fill(0, ["size", "rows", "v"])
    w = Window.partitionBy("lang")
    n = F.sum("rows").over(w)
    tbs = F.greatest(n / unit_rows, F.least(F.lit(parts(docs)), n / 1024))
    return written(all_.select("lang", "source", F.row_number().over(w.orderBy("source")).cast("long").alias("idx"), "size", F.sum("v").over(w).alias("v"), F.sum("size").over(w).alias("whole"), (1 + F.floor(tbs)).cast("int").alias("tbs"), (1 + F.floor(F.count("*").over(w) / block)).cast("int").alias("blocks")), "groups")


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, unit_rows: int = UNIT, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of each group from the other sources of its language (pair), and its most typical terms (term)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("lang"), blank("source"), blank("text"))
    kept = kept_counts(docs, least_docs)
    known = groups(docs, kept, unit_rows, block)
    few = small(known)
    heads = known.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(None).cast("long"), "total": F.lit(None).cast("long"), "tb": F.explode(F.sequence(F.lit(0), F.col("tbs") - 1))})
    entries = kept.drop("opens").join(few, ["lang", "source"]).withColumn("tb", F.pmod(F.xxhash64("term"), F.col("tbs")).cast("int"))
    columns = ("lang", "tb", "idx", "term", "n", "total", "size", "v", "whole", "blocks")
    own = (F.col("idx") / block).cast("int")
    dealt = heads.select(*columns).unionByName(entries.select(*columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least(own, F.col("other")), "hi": F.greatest(own, F.col("other"))}).drop("other", "blocks")
    found = written(dealt.groupBy("lang", "lo", "hi", "tb").applyInArrow(unit(top, block), "lang string, a long, b long, item string, value long"), "units")
    name = lambda key, out: few.select("lang", F.col("idx").alias(key), F.col("source").alias(out))
    both = found.filter("b >= 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = both.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("lang", "value", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    pairs = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).withColumn("part", F.lit("pair"))
    terms = found.filter("b < 0").drop("b").join(name("a", "source"), ["lang", "a"]).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df: df.withColumn("rank", rank).select("lang", "source", "part", "item", "value", "rank")
    return out(pairs).unionByName(out(terms).filter(F.col("rank") <= top))
