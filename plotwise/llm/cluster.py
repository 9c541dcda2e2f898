"""Shared storage and small broadcasts: how the corpus operators cut lineage and pass bounded state."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[weakref.ref, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it; an error where it is unset.

    A local session (master local or local[n]) without the setting gets a folder in its warehouse: one machine shares all its folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_plotwise"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/plotwise/{name}-{uuid.uuid4().hex}"
    _made.append((weakref.ref(spark), path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for ref, path in _made:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, rows_per_file: int = 0) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and lost executors cost no rework. Files are of any length unless said."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.plotwise_path = path
    return out


#: Rows and bytes of one Arrow batch: long texts would make large batches, and a worker holds some copies of one.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (2000, 10_000), "spark.sql.execution.arrow.maxBytesPerBatch": (4 << 20, (1 << 31) - 1)}


def small_batches(spark: SparkSession) -> None:
    """Bounds batches by bytes and rows in a session that leaves Spark's own bounds as they are; a smaller bound of its own stays."""
    for key, (ours, theirs) in _BATCHES.items():
        said = spark.conf.get(key, None)
        if said is None or int(said.rstrip("bB")) >= theirs or int(said.rstrip("bB")) <= 0:
            spark.conf.set(key, str(ours))


@contextmanager
def lent(spark: SparkSession, value) -> Iterator:
    """A broadcast for as long as the block runs: workers drop it afterwards, for they live on through other stages.

    For what is written within the block; a plan that is run later needs its broadcast until then.
    """
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of whole numbers as arrays, for small results: the driver gets each partition's as bytes, one row a batch, never an object a row."""
    kinds = {c: np.dtype({"int": "<i4", "bigint": "<i8"}[k]) for c, k in df.dtypes}

    def pack(it) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.column(b.schema.get_field_index(c)).to_numpy().astype(k).tobytes()], pa.binary()) for c, k in kinds.items()], names=list(kinds))

    rows = df.mapInArrow(pack, ", ".join(f"`{c}` binary" for c in kinds)).collect()
    return {c: np.frombuffer(b"".join(r[c] for r in rows), k) for c, k in kinds.items()}


#: Bits of the membership filter: 2**23 bits are 1 MB, whatever the number of keys.
FILTER_BITS = 1 << 23


def place(column) -> "F.Column":
    """Where a key stands in the membership filter."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """A filter of fixed size (1 MB) over the keys of a table: a key in the table always passes, others seldom.

    With `hashed` the keys are hashes already and stand at their remainder, else at place().

    Built by bit_or per 64-bit word on the executors; the driver gets at most 131,072 words however many keys there are.
    When it fills up, more rows pass than need to and the join that follows drops them.
    """
    at = F.pmod(F.col(column), F.lit(FILTER_BITS)) if hashed else place(F.col(column))
    bit = f"`{column}`" if hashed else f"xxhash64(`{column}`)"
    words = (
        keys.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod({bit}, {FILTER_BITS}L), 64) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    bits, held = np.zeros(FILTER_BITS >> 6, np.int64), packed(words)
    bits[held["w"]] = held["b"]
    return bits


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63)) & 1 != 0
