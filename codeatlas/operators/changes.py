"""What changed between two states of a set of files, told by content hash."""

import hashlib
import itertools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 20  # bytes of text that go to the hash of a directory as one row


def file_state(files: DataFrame, now: float) -> DataFrame:
    """path, hash, timestamp, size, last_processed of binary files (path, modificationTime, length, content)."""
    return files.select("path", F.sha2("content", 256).alias("hash"), F.col("modificationTime").cast("double").alias("timestamp"), F.col("length").alias("size"), F.lit(float(now)).alias("last_processed"))


def changes(known: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """key, change: new, modified, deleted or unchanged. Times and sizes aren't compared."""
    a, b = known.select(key, F.col("hash").alias("before")), current.select(key, F.col("hash").alias("after"))
    both = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified").otherwise("unchanged")
    return both.select(key, kind.alias("change"))


def deleted(known: DataFrame, current: DataFrame, key: str = "path", prefix: str | None = None) -> DataFrame:
    """Known keys that are gone; with a prefix, only those under it, so that a state shared by modules forgets nobody else's files."""
    scope = known.filter(F.col(key).startswith(prefix)) if prefix else known
    return scope.select(key).join(current.select(key), key, "left_anti")


def changed(known: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Current rows that are new or whose hash differs; an unknown hash counts as different."""
    old = known.select(key, F.col("hash").alias("before"))
    return current.join(old, key, "left").filter(F.col("before").isNull() | F.col("hash").isNull() | (F.col("hash") != F.col("before"))).drop("before")


def advance(known: DataFrame, processed: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """The state after a run: processed rows replace theirs, gone ones leave, failed ones stay as they were and come up again."""
    kept = known.join(processed.select(key), key, "left_anti").join(gone.select(key), key, "left_anti")
    return kept.unionByName(processed.select(*known.columns))


def process(known: DataFrame, current: DataFrame, handle: Callable[[DataFrame], DataFrame], prefix: str | None = None, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """handle() gets the changed rows and returns those that it could process. The new state, and a row of counts."""
    todo, gone = changed(known, current, key), deleted(known, current, key, prefix)
    done = handle(todo)
    scope = known.filter(F.col(key).startswith(prefix)) if prefix else known
    counts = changes(scope, current, key).groupBy("change").agg(F.count("*").alias("n"))
    return advance(known, done, gone, key), counts


def directory_hash(files: DataFrame, group: str, key: str, content: str) -> DataFrame:
    """group, hash over the sorted key:hash pairs of the files of each directory.

    Pairs are sorted by ranges, so tasks share a large directory, and joined to pieces of bounded size; the hash of a directory is
    fed its pieces in order, one at a time, so no directory is ever held whole.
    """
    spark = files.sparkSession
    n, kind = int(spark.conf.get("spark.sql.shuffle.partitions")), files.schema[group].dataType
    rows = files.select(F.col(group).alias("g"), F.col(key).alias("k"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))
    dealt = rows.repartitionByRange(n, "g", "k").sortWithinPartitions("g", "k", "h").select("g", F.concat(F.col("k").cast("string"), F.lit(":"), F.col("h")).alias("pair"))
    fields = [T.StructField("g", kind), T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("data", T.BinaryType())]
    laid = dealt.mapInArrow(pair_pieces, T.StructType(fields)).repartition(n, "g").sortWithinPartitions("g", "part", "piece").select("g", "data")
    return laid.mapInArrow(piece_hashes, T.StructType([fields[0], T.StructField("hash", T.StringType())])).select(F.col("g").alias(group), "hash")


def pair_pieces(batches):
    """Arrow batches of (g, pair), sorted, to (g, part, piece, data): the pairs of each g, joined; null pairs are left out."""
    from pyspark import TaskContext

    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, pairs = batch.column(0), batch.column(1).to_pylist()
        at = 0
        for _, own in itertools.groupby(keys.to_pylist()):
            end = at + sum(1 for _ in own)
            for i in range(at, end, PIECE // 75):
                data = "".join(x for x in pairs[i : min(end, i + PIECE // 75)] if x is not None).encode()
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1), pa.array([part], pa.int32()), pa.array([count], pa.int32()), pa.array([data], pa.binary())], ["g", "part", "piece", "data"])
                count += 1
            at = end


def piece_hashes(batches):
    """Arrow batches of (g, data), sorted, to (g, hash): one row for each g, whose data may go over several batches."""
    last = state = None
    done = lambda: pa.RecordBatch.from_arrays([last, pa.array([state.hexdigest()])], ["g", "hash"])
    for batch in batches:
        for i in range(batch.num_rows):
            if last is None or last[0].as_py() != batch.column(0)[i].as_py():
                if last is not None:
                    yield done()
                last, state = batch.column(0).slice(i, 1), hashlib.sha256()
            state.update(batch.column(1)[i].as_buffer())
    if last is not None:
        yield done()
