"""Change detection as a stream: file states arrive in micro-batches and move a versioned snapshot forward.

A batch's version is its number, so a batch that is run again after a failure overwrites what it wrote before.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import changed
from ..operators.upserts import last_writer

STATE = "path string, hash string, timestamp double, size long, last_processed double"


def snapshot(spark: SparkSession, place: str, before: int | None = None) -> DataFrame:
    """The newest state, or the newest one under a version; empty if there is none."""
    from pyspark.errors import AnalysisException

    try:
        done = [r[0] for r in spark.read.schema("version long").parquet(f"{place}/versions").distinct().collect()]
    except AnalysisException:
        done = []
    done = [v for v in done if before is None or v < before]
    return spark.read.schema(STATE).parquet(f"{place}/version={max(done)}") if done else spark.createDataFrame([], STATE)


def follow(states: DataFrame, place: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """states: a stream of STATE rows. handle gets the changed rows of each batch and returns those that it processed.

    Rows that it doesn't return keep their former state, so they count as changed when they are seen again. Of several states of a
    path in one batch the latest counts. A null hash deletes the path.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = snapshot(spark, place, number)
        latest = last_writer(batch, ["path"], ["timestamp", "hash", "size", "last_processed"]).select(*known.columns)
        gone = latest.filter("hash is null").select("path")
        done = handle(changed(known, latest.filter("hash is not null"))).select(*known.columns)
        kept = known.join(done.select("path"), "path", "left_anti").join(gone, "path", "left_anti")
        kept.unionByName(done).write.mode("overwrite").parquet(f"{place}/version={number}")
        spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").parquet(f"{place}/versions")

    return states.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changes by key and window of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
