import datetime as dt

from pyspark.sql import functions as F

from plotwise.streaming import store

DAY = dt.datetime(2024, 1, 1)


def _source(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_upserts_keep_the_newest_row_and_survive_a_restart(spark, tmp_path):
    schema = "k int, seq int, v string"
    for _ in range(2):
        changes = _source(spark, tmp_path, [[(1, 1, "a"), (2, 2, "b")], [(1, 3, "c")]], schema) if not (tmp_path / "in").exists() else spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = store.upsert_stream(changes, ["k"], ["seq"], str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
        assert {(r.k, r.v) for r in store.read_current(spark, str(tmp_path / "out")).collect()} == {(1, "c"), (2, "b")}


def test_debounce_and_windows(spark, tmp_path):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    schema = "k int, ts timestamp"
    rows = [(1, at(0)), (1, at(0.2)), (1, at(5)), (1, at(7200))]
    q = store.debounced(_source(spark, tmp_path, [rows], schema), "k", "ts").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from bursts").collect()) == [1, 2]
    q = store.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "ts", "1 minute").writeStream.format("memory").queryName("minutes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from minutes").collect()) == [1, 3]
    assert spark.table("minutes").where(F.col("n") == 3).first().start == DAY


def test_change_feed_tells_mutations_once(spark, tmp_path):
    schema = "listing int, seq int, op string"
    for _ in range(2):
        log = _source(spark, tmp_path, [[(1, 1, "save"), (2, 2, "read")], [(1, 3, "label"), (1, 4, "delete"), (3, 5, "save")]], schema) if not (tmp_path / "in").exists() else spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = store.change_feed(log, "listing", "op", ["save", "label", "delete"], str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    got = sorted((r.listing, r.changes, r.last_op) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, "save"), (1, 2, "delete"), (3, 1, "save")]


def test_only_the_first_event_of_a_key_counts(spark, tmp_path):
    schema = "k int, ts timestamp"
    rows = [(1, DAY), (1, DAY + dt.timedelta(seconds=5)), (2, DAY)]
    q = store.once_per_key(_source(spark, tmp_path, [rows], schema), "k", "ts").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("firsts").collect()) == [1, 2]
