"""MinHash near-dedup (operator 6): HyperMinHash registers, banding, estimation, then verification on full shingle sets.

A text's sketch has REGISTERS buckets. A shingle's hash names a bucket and a value; a register stores the number of leading
zeros and the next MANTISSA bits of its bucket's least value. Buckets that a small set leaves empty are filled from further
rounds of hashes in the same way, then from one hash function of their own, so registers of two sets agree with the
probability of their Jaccard similarity at any size, plus rare collisions of the compressed values, which estimates allow for.

Texts with equal sets are one class. Classes that share a band of registers are candidates. Each class is first compared, on full sets,
with the one leading class of its bands that it shares most of them with, unless their estimate is far below the threshold: links that hold make
parts, and a group of near copies is mostly one part after that, at a cost in proportion to its size. Only bands with several parts go on:
their members are estimated pair by pair from registers alone, and classes of different parts that may be similar enough form families.
Only families of several parts go on to full sets. In bands and families alike the rows outside the largest part are dealt into blocks of
bounded size, as are those inside; each pair of blocks, but for two of the largest part, is one unit of work that skips pairs already
connected. Only spanning edges leave a unit, never all pairs.

Defined results: null or empty texts have an empty set and are linked with nothing. A null doc_id takes no part in linking: its
component is null and the row is kept. A doc_id that occurs several times belongs to all its texts' classes at once; each of its
rows gets a result row of its own. Words are runs of anything but ASCII white space, A-Z in lower case. Sets hold 64-bit
hashes of shingles. Other columns are ignored.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph_components import components
from .shared import fresh, parts, pieces, released, small, written
from .words import BASE, U, Words, mix

REGISTERS, MANTISSA, ROUNDS = 128, 10, 4
#: Bands and registers of each, words of a shingle, and least similarity in hundredths.
BANDS, SHINGLE, THRESHOLD = (25, 5), 3, 85
#: An estimate from REGISTERS registers is below the true value by this with a probability of about 1e-6.
SLACK = 0.17
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 18
SEEDS = mix(np.arange(1, ROUNDS + REGISTERS + 1, dtype=U) * BASE)
KEY_BITS = 57  # of 64, after the 7 that name a bucket


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text: all in one array, and n + 1 offsets."""
    w = Words(data, offsets, lower=True)
    words = w.hashes()
    h, at = w.windows(words, size)
    doc = w.doc()
    owner = doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = np.zeros(len(short), U)
    for k in range(size - 1):
        has = w.counts[short] > k
        whole[has] = mix(whole[has] * U(0x2545F4914F6CDD1D) + words[w.first[:-1][short[has]] + k] + U(k + 1))
    h, owner = np.concatenate([h, mix(whole + w.counts[short].astype(U))]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(offsets)))


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros of 57-bit values (above) and the MANTISSA bits after the first one (below), in 16 bits."""
    exponent = np.frexp(np.maximum(values, U(1)).astype(np.float64))[1] - 1
    shift = exponent - MANTISSA
    bits = np.where(shift >= 0, values >> np.maximum(shift, 0).astype(U), values << np.maximum(-shift, 0).astype(U)) & U((1 << MANTISSA) - 1)
    return ((np.maximum(KEY_BITS - 1 - exponent, 0).astype(U) << U(MANTISSA)) | bits).astype(np.uint16)


def registers(s: np.ndarray) -> np.ndarray:
    """The compressed registers of one non-empty set."""
    out, empty = np.zeros(REGISTERS, U), np.ones(REGISTERS, bool)
    buckets = np.arange(REGISTERS, dtype=U) << U(KEY_BITS)
    for t in range(ROUNDS):
        g = np.sort(mix(s ^ SEEDS[t]))
        at = np.searchsorted(g, buckets)
        first = g[np.minimum(at, len(g) - 1)]
        hit = empty & (at < len(g)) & ((first >> U(KEY_BITS)) == np.arange(REGISTERS, dtype=U))
        out[hit] = first[hit] & U((1 << KEY_BITS) - 1)
        empty &= ~hit
        if not empty.any() or len(s) * ROUNDS < REGISTERS // 8:
            break
    rest = np.flatnonzero(empty)
    if len(rest):
        for i in range(0, len(rest), max(1, (1 << 16) // len(s))):
            part = rest[i : i + max(1, (1 << 16) // len(s))]
            out[part] = mix(s[None, :] ^ SEEDS[ROUNDS + part][:, None]).min(1) >> U(7)
    return compress(out)


def band_keys(reg: np.ndarray, bands: tuple[int, int] = BANDS) -> np.ndarray:
    n, rows = bands
    h = np.arange(n, dtype=U) * BASE
    for k in range(rows):
        h = mix(h * U(0x2545F4914F6CDD1D) + reg[: n * rows].reshape(n, rows)[:, k].astype(U))
    return h.view(np.int64)


_collisions: dict[tuple[int, int], float] = {}


def collision(n: int, m: int) -> float:
    """The probability that the registers of two disjoint sets of n and m shingles agree, from the mass of each compressed value."""
    key = tuple(sorted((int(2 * np.log2(max(n, 1))), int(2 * np.log2(max(m, 1))))))
    if key not in _collisions:
        low = np.ldexp(1 + np.arange(1 << MANTISSA) / (1 << MANTISSA), -np.arange(1, 40)[:, None])
        high = low + np.ldexp(1.0 / (1 << MANTISSA), -np.arange(1, 40)[:, None])
        mass = [np.exp(-low * load) - np.exp(-high * load) for load in (max(1.0, 2 ** (k / 2) / REGISTERS) for k in key)]
        _collisions[key] = float((mass[0] * mass[1]).sum())
    return _collisions[key]


def fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit hashes of each set as a whole."""
    return [int(x.sum(dtype=U).view(np.int64)) for x in sets], [int(np.bitwise_xor.reduce(mix(x + BASE)).view(np.int64)) if len(x) else 0 for x in sets]


SKETCH = "doc_id long, tie long, n_shingles long, f1 long, f2 long, bands array<long>, registers binary"


def sketches(size: int, bands: tuple[int, int]):
    """(doc_id, tie, text) to rows of SKETCH; empty sets have null in the last four columns."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in pieces(batch):
                s, first = shingle_sets(data, offsets, size)
                sets = [s[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                regs = [registers(x) if len(x) else None for x in sets]
                has = pa.array([not len(x) for x in sets])  # masks empty sets
                f1, f2 = (pa.array(np.array(f, np.int64), mask=np.asarray(has)) for f in fingerprints(sets))
                keys = pa.array([None if r is None else band_keys(r, bands) for r in regs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(first)), f1, f2, keys, pa.array([None if r is None else r.tobytes() for r in regs], pa.binary())], ["doc_id", "tie", "n_shingles", "f1", "f2", "bands", "registers"])

    return run


def wanted(ids: DataFrame, n: int) -> np.ndarray:
    """A bit map, of 16 bits or more for each of n ids but of 32 MB at most, of the ids' hashes; it only spares the shuffle of other texts."""
    bits = min(28, max(16, int(16 * n).bit_length()))
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    words = ids.select(F.shiftright(h, 6).alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")).alias("bit"))
    found = words.groupBy("k").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["k"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(U)


def full_sets(bits, size: int):
    """(doc_id, text, hash of doc_id) to the full sets of the texts in the bit map: least, n_shingles, f1, f2, shingles."""

    def run(batches):
        shift = U(64 - int(len(bits.value) * 64).bit_length() + 1)
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False).view(U) >> shift
            hit = (bits.value[(h >> U(6)).astype(np.int64)] >> (h & U(63))) & U(1)
            for rows, data, offsets in pieces(batch.filter(pa.array(hit.astype(bool)))):
                s, first = shingle_sets(data, offsets, size)
                sets = [s[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                f1, f2 = fingerprints(sets)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["least", "n_shingles", "f1", "f2", "shingles"])

    return run


def close_enough(x: int, others: np.ndarray, reg: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """Those of others whose size and registers allow a similarity of threshold with x."""
    others = others[100 * np.minimum(n[others], n[x]) >= threshold * np.maximum(n[others], n[x])]
    if not len(others):
        return others
    c = np.array([collision(n[x], n[y]) for y in others]) if len(others) < 8 else collision(n[x], int(np.median(n[others])))
    return others[((reg[others] == reg[x]).mean(1) - c) / (1 - c) >= threshold / 100 - SLACK]


def links(threshold: int):
    """Arrow batches of (src, dst, sets a and b) to the edges (src, dst) of those that are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= threshold * max(len(a), len(b)) else 0
                keep.append(100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def hopeful(threshold: int):
    """Arrow batches of (src, dst, registers a and b, sizes m and n) to the edges (src, dst) whose estimate allows the threshold."""

    def run(batches):
        for batch in batches:
            m, n = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            reg = [np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(k)]) if len(m) else None for k in (2, 3)]
            keep = [len(close_enough(0, np.array([1]), np.stack([a, b]), np.array([x, y]), threshold)) > 0 for a, b, x, y in zip(*reg, m, n, strict=True)] if len(m) else []
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def spanning_edges(threshold: int, exact: bool):
    """Arrow batches of block members, sorted by unit, to the spanning edges (src, dst) between the parts of each unit.

    exact: pairs are decided on full sets; else an estimate that allows the threshold is enough.
    """

    def unit(rows, cross: bool) -> list[tuple[int, int]]:
        ids, side, n = [r["rep"] for r in rows], np.array([r["side"] for r in rows]), np.array([r["n_shingles"] for r in rows])
        reg = np.stack([np.frombuffer(r["registers"], np.uint16) for r in rows])
        root = np.unique([r["part"] for r in rows], return_inverse=True)[1]
        if exact:
            sets = [np.frombuffer(r["shingles"], U) for r in rows]
            flat, first = np.concatenate(sets), np.append(0, np.cumsum(n))
        edges = []
        for x in range(len(ids)):
            if cross and side[x] != 0:
                continue
            others = np.flatnonzero((side == 1) if cross else (np.arange(len(ids)) > x))
            others = close_enough(x, others[root[others] != root[x]], reg, n, threshold)
            if exact and len(others) > 8:
                size = n[others]
                at = np.repeat(first[others] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                values = flat[at]
                k = np.minimum(np.searchsorted(sets[x], values), n[x] - 1)
                both = np.add.reduceat((sets[x][k] == values).astype(np.int64), np.append(0, np.cumsum(size)[:-1]))
            elif exact:
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in others], np.int64)
            for y in others[100 * both >= threshold * (n[others] + n[x] - both)] if exact else others:
                if root[y] != root[x]:
                    edges.append((ids[x], ids[y]))
                    root[root == root[y]] = root[x]
        return edges

    def run(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        for (_, inner, low, high), own in itertools.groupby(rows, lambda r: (r["family"], r["inner"], r["low"], r["high"])):
            e = unit(list(own), not inner or low != high)
            if e:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in e], pa.int64()), pa.array([b for _, b in e], pa.int64())], ["src", "dst"])

    return run


def with_parts(rows: DataFrame, parts_of: DataFrame) -> DataFrame:
    """rows with the part of rep; a rep without links is a part of its own."""
    return rows.join(parts_of.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))


def several(rows: DataFrame) -> DataFrame:
    """(family, main, of_main, of_rest) of the families of rows (family, part, n_shingles) with several parts: the largest part, and numbers of blocks."""
    sizes = rows.groupBy("family", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    family = sizes.groupBy("family").agg(F.max(F.struct("n", "s", "part")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK_ROWS, s / BLOCK_SHINGLES))).cast("int")
    return family.select("family", F.col("top.part").alias("main"), blocks(F.col("top.n"), F.col("top.s")).alias("of_main"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("of_rest"))


def units(rows: DataFrame, families: DataFrame, *carried: str) -> DataFrame:
    """Rows (family, rep, part, n_shingles, carried) of the families, once for each unit that they belong to: inner, low, high, side.

    Units join blocks of a family's largest part with blocks of the rest (inner 0), and the blocks of the rest with one another (inner 1).
    """
    rows = rows.join(families, "family").withColumn("in_main", F.col("part") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.hash("rep"), F.when(F.col("in_main"), F.col("of_main")).otherwise(F.col("of_rest"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("family", "inner", "low", "high", "side", "rep", "part", "n_shingles", *carried)
    zero, one = F.lit(0), F.lit(1)
    main = rows.filter("in_main").withColumn("high", every("of_rest")).withColumn("low", F.col("block")).withColumn("inner", zero).withColumn("side", zero)
    rest = rows.filter("not in_main")
    outer = rest.withColumn("low", every("of_main")).withColumn("high", F.col("block")).withColumn("inner", zero).withColumn("side", one)
    inner = rest.withColumn("other", every("of_rest")).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("inner", one).withColumn("side", (F.col("block") > F.col("other")).cast("int"))
    n = parts(rows)
    return main.select(*columns).unionByName(outer.select(*columns)).unionByName(inner.select(*columns)).repartition(n, "family", "inner", "low", "high").sortWithinPartitions("family", "inner", "low", "high")


EDGES = "src long, dst long"


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, bands: tuple[int, int] = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text); see the module's docstring."""
    return grouped(docs, threshold, shingle, bands).drop("tie")


def grouped(docs: DataFrame, threshold: int, shingle: int, bands: tuple[int, int]) -> DataFrame:
    """near_duplicates() with tie, the hash of each row's text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = written(texts.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(released(sketches(shingle, bands)), SKETCH), "sketches")
    linked = made.filter("doc_id is not null and f1 is not null")
    cls = ["f1", "f2", "n_shingles"]
    # a class is named by the least doc_id that holds its set; a doc_id with several texts names several classes, and joins them
    classes = linked.groupBy(*cls).agg(F.min_by(F.struct("doc_id", "bands", "registers"), "doc_id").alias("r")).select(*cls, "r.*")
    classes = written(classes.withColumnRenamed("doc_id", "least").withColumn("rep", F.xxhash64("f1", "f2")), "classes")
    every = classes.select("rep", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("first")).filter("n > 1").select("band", "first")
    every = written(every.join(shared, "band"), "bands")
    ties = every.filter("rep <> first").groupBy(F.col("rep").alias("src"), F.col("first").alias("dst")).agg(F.count("*").alias("n"))
    best = written(ties.groupBy("src").agg(F.max_by("dst", F.struct("n", "dst")).alias("dst")), "best")
    members = written(every.select("rep").distinct().join(classes.select("rep", "least", *cls, "registers"), "rep"), "members")
    bits = spark.sparkContext.broadcast(wanted(members.select(F.col("least").alias("doc_id")), members.count()))
    sets = texts.filter("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).mapInArrow(released(full_sets(bits, shingle)), "least long, n_shingles long, f1 long, f2 long, shingles binary")
    full = written(members.join(sets.dropDuplicates(["least", *cls]), ["least", *cls]).select("rep", "n_shingles", "registers", "shingles"), "sets")
    end = lambda rep, named: members.select(F.col("rep").alias(rep), *[F.col(c).alias(n) for c, n in named.items()])
    hope = best.join(end("src", {"registers": "a", "n_shingles": "m"}), "src").join(end("dst", {"registers": "b", "n_shingles": "n"}), "dst")
    hope = written(hope.select("src", "dst", "a", "b", "m", "n").mapInArrow(released(hopeful(threshold)), EDGES), "hope")
    side = lambda rep, name: full.select(F.col("rep").alias(rep), F.col("shingles").alias(name))
    near = written(hope.join(side("src", "a"), "src").join(side("dst", "b"), "dst").select("src", "dst", "a", "b").mapInArrow(released(links(threshold)), EDGES), "links")
    parted = written(components(near), "parts")
    # bands with several parts: families of what their members' registers allow
    at = with_parts(every.select(F.col("band").alias("family"), "rep").join(members.select("rep", "n_shingles"), "rep"), parted)
    open_ = at.join(several(at), "family").select("family", "rep", "part", "n_shingles")
    open_ = written(open_, "open-bands")
    close = units(open_.join(members.select("rep", "registers"), "rep"), several(open_), "registers").mapInArrow(released(spanning_edges(threshold, False)), EDGES)
    close = written(close, "families")
    family = components(close.unionByName(near)).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    rows = with_parts(family.join(full.select("rep", "n_shingles"), "rep"), parted)
    rows = written(rows.join(several(rows).select("family"), "family", "left_semi"), "open-families")
    dealt = units(rows.join(full.select("rep", "registers", "shingles"), "rep"), several(rows), "registers", "shingles")
    edges = written(dealt.mapInArrow(released(spanning_edges(threshold, True)), EDGES), "edges").unionByName(near)
    # classes that share a doc_id are joined by it
    twice = linked.groupBy("doc_id").agg(F.min(F.struct(*cls)).alias("x"), F.max(F.struct(*cls)).alias("y"), F.count("*").alias("n")).filter("n > 1 and x <> y").select("doc_id")
    held = linked.join(twice, "doc_id").select("doc_id", F.xxhash64("f1", "f2").alias("rep")).distinct()
    same = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("dst")), "doc_id").select(F.col("rep").alias("src"), "dst")
    found = components(edges.unionByName(same)).select(F.col("node").alias("rep"), F.col("component").alias("c"))
    named = classes.select(*cls, "rep", "least").join(found, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select(*cls, "component_id")
    out = made.select("doc_id", "tie", "n_shingles", "f1", "f2").join(named, cls, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "tie", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, bands: tuple[int, int] = BANDS) -> DataFrame:
    """The rows of docs, whole, of one document of each group: the smallest doc_id. Of several rows of it the one of the least text hash stays.

    Rows are told apart by doc_id and text. A row with a null doc_id stays, as does one without words unless its doc_id has another row that stays.
    """
    told = written(grouped(docs, threshold, shingle, bands), "told").filter("doc_id is not null")
    out, key = told.filter("not kept").select("doc_id", "tie").distinct(), (fresh(docs, "out_id"), fresh(docs, "out_tie"))
    again = written(told.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(key[0])), "again")
    gone = small(written(out.select(F.col("doc_id").alias(key[0]), F.col("tie").alias(key[1])), "rejected"))
    rows = docs.join(gone, (docs["doc_id"].cast("long") == gone[key[0]]) & (F.xxhash64(docs["text"].cast("string")) == gone[key[1]]), "left_anti")
    if again.isEmpty():
        return rows
    named = small(again)
    once = rows.join(named, rows["doc_id"].cast("long") == named[key[0]])
    once = once.groupBy(key[0]).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(F.col("text").cast("string")), F.xxhash64(*docs.columns))).alias(key[1]))
    return rows.join(named, rows["doc_id"].cast("long") == named[key[0]], "left_anti").unionByName(once.select(f"{key[1]}.*"))
