"""Change detection over a stream of file states, and counts by event time."""

from pyspark.sql import functions as F

from codeatlas.streaming import changes as s


def put(spark, rows, place):
    spark.createDataFrame(rows, s.STATE).coalesce(1).write.mode("append").parquet(place)


def test_follow(spark, tmp_path, rows):
    source, place, seen = str(tmp_path / "in"), str(tmp_path / "state"), []

    def handle(df):
        seen.append(sorted(r["path"] for r in df.collect()))
        return df.filter("path <> 'fails'")

    def run():
        stream = spark.readStream.schema(s.STATE).parquet(source)
        s.follow(stream, place, str(tmp_path / "check"), handle).awaitTermination()

    put(spark, [("a", "1", 1.0, 1, 1.0), ("a", "0", 0.5, 1, 1.0), ("b", "1", 1.0, 1, 1.0), ("fails", "1", 1.0, 1, 1.0)], source)
    run()
    put(spark, [("a", "1", 2.0, 1, 2.0), ("b", "2", 2.0, 1, 2.0), ("c", "1", 2.0, 1, 2.0), ("fails", "1", 2.0, 1, 2.0)], source)
    run()
    put(spark, [("b", None, 3.0, 0, 3.0)], source)
    run()
    assert seen == [["a", "b", "fails"], ["b", "c", "fails"], []]
    assert rows(s.snapshot(spark, place), "path", "hash") == [("a", "1"), ("c", "1")]
    assert rows(s.snapshot(spark, place, 1), "path") == [("a",), ("b",)]


def test_counts_by_window(spark, tmp_path, rows):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    spark.sql("select timestamp'2024-01-01 00:10:00' + make_dt_interval(0, 0, cast(id as int) * 20) as ts, if(id % 2 = 0, 'new', 'gone') as change from range(6)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, change string").parquet(source)
    q = s.counts(stream, "ts", "change").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.table("counted")
    assert found.agg(F.sum("n")).first()[0] == 6 and rows(found.groupBy("change").agg(F.sum("n").alias("n"))) == [("gone", 3), ("new", 3)]


def test_tracker_keeps_a_state_for_each_path(spark, tmp_path, rows):
    """Changes by batch over restarts of the query from its checkpoint; a batch touches only the states of its own paths."""
    from codeatlas.streaming import tracker

    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    seen = set()

    def run(batch):
        put(spark, batch, source)
        tracker.run_once(tracker.track(spark.readStream.schema(s.STATE).parquet(source)), out, check)
        new = {tuple(r) for r in spark.read.schema(tracker.CHANGE).parquet(out).select("path", "change", "hash", "timestamp").collect()} - seen
        seen.update(new)
        return sorted((p, c, h) for p, c, h, _ in new)

    assert run([(p, "1", 1.0, 1, 1.0) for p in ("a", "b", "c")] + [("a", "0", 0.5, 1, 1.0), (None, "x", 1.0, 1, 1.0)]) == [("a", "new", "1"), ("b", "new", "1"), ("c", "new", "1")]
    assert run([("a", "1", 2.0, 1, 2.0), ("b", "2", 2.0, 9, 2.0), ("d", "1", None, None, None)]) == [("b", "modified", "2"), ("d", "new", "1")]
    assert run([("b", None, 3.0, 0, 3.0), ("unknown", None, 3.0, 0, 3.0), ("c", "1", 3.0, 1, 3.0), ("c", "5", 2.5, 1, 3.0)]) == [("b", "deleted", None)]
    assert run([("b", "2", 4.0, 9, 4.0)]) == [("b", "new", "2")]


def test_tracker_forgets(spark, tmp_path):
    import time

    from codeatlas.streaming import tracker

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [("a", "1", 1.0, 1, 1.0)], source)
    stream = tracker.track(spark.readStream.schema(s.STATE).parquet(source), forget_ms=10)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    found, begun = set(), time.time()
    while ("a", "expired") not in found and time.time() - begun < 90:
        time.sleep(1)
        if any((tmp_path / "out").glob("*.parquet")):
            found = {tuple(r) for r in spark.read.schema(tracker.CHANGE).parquet(out).select("path", "change").collect()}
    query.stop()
    assert found == {("a", "new"), ("a", "expired")}
