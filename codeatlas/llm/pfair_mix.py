"""Mixing sources to target weights (operator 7) by Pfair scheduling.

Each source's documents are cut into blocks of about block_chars characters. Block k of a source of weight w has release floor(k / w) and
deadline ceil((k + 1) / w); at each slot the released block with the earliest deadline goes next, so that after any number of slots each
source is less than one block from its share. Weights are taken exactly, as fractions, for any number of sources. The blocks of the table,
not its documents, are scheduled in order of slots by one task that holds one row a source and writes its plan as it goes; empty slots are
jumped over. Blocks are numbered with running sums over (source, bucket) groups, so no source is sorted in one task, and joined with the plan.

With a period given, weights are rounded to multiples of 1 / period instead (shares()), at least one each, and the schedule of one period is
repeated by arithmetic.

Nothing is dropped: once a source has run out, its later slots stay empty and the others go on. in_mix tells the documents of the
slots before that, where all target weights hold. (Without a period, a slot that a source has no block for may go to a released block.)

Defined results: a null source is a source of its own, named by null. Null and empty texts have size 0 and ride with their
neighbours' block. Sources without a positive weight get no slot (null) and are not in the mix. Ties in doc_id go by a hash of the
text; repeated rows are placed each. An empty table gives an empty result. Columns named in carry go along untouched.
"""

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small, written

BLOCK_CHARS, BUCKET_ROWS, POWER = 1 << 18, 4096, 0.7
PLAN = "source string, k long, t long, real boolean"


def shares(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Slots of each source in a period, by largest remainders; every positive weight gets one at least."""
    weights = {s: w for s, w in weights.items() if w > 0}
    total = sum(weights.values())
    if len(weights) > period // 2:
        raise ValueError(f"a period of {period} slots is too short for {len(weights)} sources")
    name = lambda s: (s is not None, s or "")
    exact = {s: 1 + w / total * (period - len(weights)) for s, w in weights.items()}
    slots = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (slots[s] - exact[s], name(s)))[: period - sum(slots.values()) if slots else 0]:
        slots[s] += 1
    return slots


def layout(slots: Mapping[str | None, int], period: int) -> list[tuple[str | None, int, int]]:
    """(source, block of the period, slot) of one period, earliest deadline first among released blocks."""
    order = sorted(slots, key=lambda s: (s is not None, s or ""))
    release: dict[int, list[tuple[int, int, int]]] = {}
    for i, s in enumerate(order):
        q = slots[s]
        for k in range(q):
            release.setdefault(k * period // q, []).append((-(-(k + 1) * period // q), i, k))
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(period if order else 0):
        for job in release.get(t, ()):
            heapq.heappush(ready, job)
        deadline, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        out.append((order[i], k, t))
    return out


def whole(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Positive weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: w.numerator * (unit // w.denominator) for s, w in exact.items()}


def schedule(sources: Iterable[tuple[str | None, int, int]]) -> Iterator[tuple[str | None, int, int, bool]]:
    """(source, block, slot, True) of all blocks of sources (source, whole weight, blocks), by slot, earliest deadline first.

    The first block that a source is due for and doesn't have comes once, with False. A source has one block at most in the heaps: the
    windows of two that follow each other share one slot at most, in which the first is due.
    """
    sources = sorted(sources, key=lambda x: (x[0] is not None, x[0] or ""))
    total = sum(n for _, n, _ in sources)
    later = [(0, i, 0) for i in range(len(sources))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    t, ended = 0, False
    while later or ready:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            _, i, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-(k + 1) * total // sources[i][1]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        source, n, blocks = sources[i]
        if k < blocks:
            yield source, k, t, True
            t += 1
            heapq.heappush(later, (max(t, (k + 1) * total // n), i, k + 1))
        elif not ended:
            ended = True
            yield source, k, t, False


def planned(batches):
    """Arrow batches of (source, weight, blocks), all in one task, to batches of PLAN."""
    sources = [(r["source"], int(r["weight"]), r["blocks"]) for b in batches for r in b.to_pylist()]
    out: list[tuple] = []
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate(kinds)], ["source", "k", "t", "real"])
    for row in schedule(sources):
        out.append(row)
        if len(out) == 1 << 14:
            yield pack(out)
            out = []
    if out:
        yield pack(out)


def tempered(docs: DataFrame, power: float = POWER) -> dict[str | None, float]:
    """Weights of sources by their size in characters to a power below 1, which lifts small sources; one row a source is gathered."""
    rows = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("n")).collect()
    return {r["source"]: float(r["n"]) ** power for r in rows if r["n"]}


def mix(docs: DataFrame, weights: Mapping[str | None, float], block_chars: int = BLOCK_CHARS, period: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, block, slot and in_mix for each row of docs (doc_id, source, text), and the columns to carry."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.length(text).cast("long").alias("size"), F.xxhash64(text).alias("tie"), *([F.struct(*carry).alias("carried")] if carry else []))
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("before", F.expr("coalesce(sum(sum) over (partition by source order by bucket rows between unbounded preceding and 1 preceding), 0L)")).withColumn("total", F.expr("sum(sum) over (partition by source)")).drop("sum")
    sums = written(sums, "mix-sums")
    ends = sums.select("source", F.greatest(F.lit(1), F.ceil(F.col("total") / block_chars)).alias("blocks")).distinct()
    x, y = rows.alias("x"), sums.alias("y")
    placed = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.bucket") == F.col("y.bucket"))).select("x.*", "before", "total")
    start = F.col("before") + F.expr("coalesce(sum(size) over (partition by source, bucket order by doc_id, tie rows between unbounded preceding and 1 preceding), 0L)")
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / block_chars) - 1)
    placed = placed.withColumn("block", F.least(F.floor(start / block_chars), last).cast("long")).withColumn("start", start)
    placed, slot, horizon = repeated(placed, ends, shares(weights, period), period) if period else exact(placed, ends, whole(weights))
    return placed.select("doc_id", "source", "size", "block", slot.alias("slot"), F.coalesce(slot < F.lit(horizon), F.lit(False)).alias("in_mix"), "start", *(["carried"] if carry else []))


def exact(placed: DataFrame, ends: DataFrame, weights: dict[str | None, int]) -> tuple[DataFrame, Column, int | None]:
    """placed with the plan of schedule(), the slot in it, and the slot at which the first source needs a block that it doesn't have."""
    fields = T.StructType([T.StructField("source", T.StringType()), T.StructField("weight", T.StringType())])
    given = placed.sparkSession.createDataFrame([(s, str(n)) for s, n in weights.items()], fields)
    sources = given.join(ends, given["source"].eqNullSafe(ends["source"]), "left").select(given["source"], "weight", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))
    plan = written(sources.coalesce(1).mapInArrow(planned, PLAN), "mix-plan")
    end = plan.filter("not real").first()
    at = small(plan.filter("real").select(F.col("source").alias("s"), F.col("k").alias("kk"), "t"))
    return placed.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("kk")), "left"), F.col("t"), end["t"] if end else None


def repeated(placed: DataFrame, ends: DataFrame, slots: dict[str | None, int], period: int) -> tuple[DataFrame, Column, int | None]:
    """The same by the repeated schedule of one period."""
    spark = placed.sparkSession
    table = [(s, slots[s], k, t) for s, k, t in layout(slots, period)]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("q", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("t", T.IntegerType())])
    plan = spark.createDataFrame(table, schema)  # `period` rows
    quota = spark.createDataFrame(list(slots.items()), T.StructType([T.StructField("source", T.StringType()), T.StructField("q", T.IntegerType())]))
    missing = quota.join(ends, quota["source"].eqNullSafe(ends["source"]), "left").select(quota["source"], "q", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    out_at = missing.join(F.broadcast(plan.select(F.col("source").alias("s"), "k", "t")), F.col("source").eqNullSafe(F.col("s")) & (F.col("blocks") % F.col("q") == F.col("k")))
    horizon = out_at.agg(F.min(F.floor(F.col("blocks") / F.col("q")) * period + F.col("t"))).first()[0]
    q = F.broadcast(quota.select(F.col("source").alias("s"), "q"))
    placed = placed.join(q, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("k", (F.col("block") % F.col("q")).cast("int"))
    at = F.broadcast(plan.select(F.col("source").alias("s"), F.col("k").alias("kk"), "t"))
    placed = placed.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("kk")), "left")
    return placed, (F.floor(F.col("block") / F.col("q")) * period + F.col("t")).cast("long"), horizon
