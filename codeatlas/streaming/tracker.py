"""Change detection with one keyed state a path: hash, time and size of the file's last version.

A batch reads and writes the states of its own paths alone, in the state store, whatever the number of paths known; a restarted query goes on
from its checkpoint. Paths that nobody reports for a while can be forgotten by timers.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "path string, change string, hash string, timestamp double, size long"


class Tracker(StatefulProcessor):
    """Rows of a path to its change: new, modified or deleted (a null hash), and expired if it wasn't seen for forget_ms. Unchanged paths give no row."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "hash string, timestamp double, size long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # of several states in one batch the latest counts; a file's last state is its least surprising one among those of one time
        last = max(rows, key=lambda r: (r["timestamp"] is not None, r["timestamp"] or 0.0, r["hash"] is not None, r["hash"] or "", r["size"] or 0))
        before = self.known.get() if self.known.exists() else None
        if before is not None and before[3]:
            self.handle.deleteTimer(before[3])
        if last["hash"] is None:
            self.known.clear()
            if before is not None:
                yield Row(path=key[0], change="deleted", hash=None, timestamp=last["timestamp"], size=None)
            return
        timer = 0
        if self.forget_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.forget_ms
            self.handle.registerTimer(timer)
        self.known.update((last["hash"], last["timestamp"], last["size"], timer))
        if before is None or before[0] != last["hash"]:
            yield Row(path=key[0], change="new" if before is None else "modified", hash=last["hash"], timestamp=last["timestamp"], size=last["size"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        hash_, timestamp, size, _ = self.known.get()
        self.known.clear()
        yield Row(path=key[0], change="expired", hash=hash_, timestamp=timestamp, size=size)

    def close(self) -> None:
        pass


def track(states: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """states: a stream of rows (path, hash, timestamp, size, ...). A stream of CHANGE rows, for writeStream in append mode; with forget_ms at intervals."""
    states.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = states.filter("path is not null").select("path", "hash", "timestamp", "size")
    return rows.groupBy("path").transformWithState(Tracker(forget_ms), CHANGE, "Append", "None" if forget_ms is None else "ProcessingTime")


def run_once(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Appends the changes of all that is there to Parquet files, and ends. Not for streams that forget: with timers there is always another batch to come."""
    changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
