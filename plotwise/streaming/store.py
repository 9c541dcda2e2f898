"""Streams over the store: upserts by micro-batch, change feeds, debounce and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import latest


def upsert_stream(changes: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of the newest row a key under `path`, a version a micro-batch; `path`/current names the last.

    A batch that runs again writes the same version again, so a restart changes nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{path}/version-{number:09d}"
        fresh = latest(batch, keys, order)
        before = read_current(spark, path, below=number)
        rows = fresh if before is None else latest(before.unionByName(fresh), keys, order)
        rows.write.mode("overwrite").parquet(name)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").start()


def read_current(spark, path: str, below: int | None = None) -> DataFrame | None:
    """The last version of the table, or the last before a batch number; null if there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("version-") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    names = [n for n in names if below is None or int(n.split("-")[1]) < below]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def debounced(events: DataFrame, key: str, time: str, gap: str = "350 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of a stream, each given out once its gap has passed the watermark."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_per_key(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first event of a key; later ones within the watermark go."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, keys: list[str], time: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of event-time windows, late rows included up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, slide or length).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def change_feed(log: DataFrame, key: str, op: str, mutations: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Tells what mutations touched: under `path` one folder a micro-batch with key, changes (how many) and last_op by `seq`.

    Reads and other messages give nothing. A batch that runs again writes its folder again, so each change is
    told once however often the stream is restarted.
    """
    def tell(batch: DataFrame, number: int) -> None:
        touched = batch.where(F.col(op).isin(*mutations)).groupBy(key).agg(F.count("*").alias("changes"), F.max_by(op, "seq").alias("last_op"))
        touched.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).start()
