"""Streams give what the table gives."""

from lodegraph.streaming import events as ev

DATA = "/root/testdata/sf0.001/events.parquet"


def test_windows_of_a_stream(spark):
    batch = {(r.window_start, r.event_type): r.n for r in ev.window_counts(spark.read.parquet(DATA)).collect()}
    stream = ev.table_stream(spark, "/root/testdata/sf0.001/events.parquet*", spark.read.parquet(DATA).schema)
    q = ev.window_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.event_type): r.n for r in spark.table("windows").collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_index_stream(spark, tmp_path):
    src = tmp_path / "in"
    files = spark.createDataFrame([("r", "a.py", "python", "def f():\n    return g()\n"), ("r", "b.js", "javascript", "x")], "repository_id string, file_path string, language string, content string")
    files.write.parquet(str(src))
    stream = spark.readStream.schema(files.schema).parquet(str(src))
    for _ in range(2):
        ev.index_stream(stream, str(tmp_path / "e"), str(tmp_path / "r"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 3


def test_latest_per_key_sink(spark, tmp_path):
    sink = ev.latest_per_key(str(tmp_path / "t"))
    rows = spark.read.parquet(DATA).select("event_type", "ts", "event_id", "user_id")
    sink(rows.where("event_id % 2 = 0"), 0)
    sink(rows.where("event_id % 2 = 1"), 1)
    got = {r.event_type: r.event_id for r in spark.read.parquet(str(tmp_path / "t" / "v0")).collect()}
    want = {}
    for r in rows.orderBy("ts", "event_id").collect():
        want[r.event_type] = r.event_id
    assert got == want
