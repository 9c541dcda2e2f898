"""Nearest-neighbour joins of descriptors: mutual matches and the ratio test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Descriptors of one view in one task's block; larger views meet block by block.
BLOCK = 4096


def sign_bits(vector) -> "F.Column":
    """A vector's signs as longs of 64 bits, as many as its length needs."""
    word = lambda k: F.aggregate(F.slice(vector, k * 64 + 1, 64), F.lit(0).cast("long"), lambda bits, x: F.call_function("shiftleft", bits, F.lit(1)).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(0).cast("long")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) + 63) / 64).cast("int") - 1), word)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs of one length as rows of unsigned words."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)


def nearest(left: DataFrame, right: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k nearest rows of `right` for every row of `left` with equal keys, by Hamming distance of `bits` (a long or an array of them), ties by id.

    Columns: keys, id, other, distance, rank. Descriptors of unlike lengths are not compared, null ones with nothing. Both sides are cut into blocks of bounded size by a hash of the
    id; a task compares two blocks and keeps k a row, so what is shuffled after is k rows a row and block.
    """
    def blocks_of(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))

    words = lambda df: F.array("bits") if dict(df.dtypes)["bits"] == "bigint" else F.col("bits")
    left, right = (df.select(*keys, "id", words(df).alias("bits"), F.size(words(df)).alias("_len")) for df in (left, right))
    keys = [*keys, "_len"]  # descriptors of unlike lengths have no distance
    n_left, n_right = blocks_of(left).withColumnRenamed("_n", "_nl"), blocks_of(right).withColumnRenamed("_n", "_nr")
    sizes = n_left.join(n_right, keys)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.alias("l").join(sizes, keys).select(*keys, "id", "bits", block("_nl").alias("_i"), "_nr").withColumn("_j", every("_nr")).select(*keys, "_i", "_j", "id", "bits")
    b = right.alias("r").join(sizes, keys).select(*keys, "id", "bits", block("_nr").alias("_j"), "_nl").withColumn("_i", every("_nl")).select(*keys, "_i", "_j", "id", "bits")

    def compare(key, x, y):
        ids, other = x.column("id").to_numpy(), y.column("r_id").to_numpy()
        order = np.argsort(other, kind="stable")
        other, rows = other[order], [[np.zeros(0, np.int64)] for _ in range(3)]
        if len(ids) and len(other):
            mine, theirs = _words(x.column("bits")), _words(y.column("r_bits"))[order]
            for lo in range(0, len(ids), 256):  # a slab of the table of distances at a time
                distance = np.zeros((min(256, len(ids) - lo), len(other)), np.int64)
                for w in range(mine.shape[1]):
                    distance += np.bitwise_count(mine[lo : lo + 256, w, None] ^ theirs[None, :, w])
                best = np.argsort(distance, axis=1, kind="stable")[:, :k]
                rows[0].append(np.repeat(ids[lo : lo + 256], best.shape[1]))
                rows[1].append(other[best].ravel())
                rows[2].append(np.take_along_axis(distance, best, 1).ravel())
        columns = [np.concatenate(r).astype(np.int64) for r in rows]
        return pa.table({**{c: pa.array([v.as_py()] * len(columns[0]), v.type) for c, v in zip(keys, key)}, "id": columns[0], "other": columns[1], "distance": columns[2]})

    kinds = ", ".join(f"{c} {dict(left.dtypes)[c]}" for c in keys)
    # new names on one side: both may come from one table
    b = b.toDF(*[f"r_{c}" for c in b.columns])
    found = a.groupBy(*keys, "_i", "_j").cogroup(b.groupBy(*[f"r_{c}" for c in [*keys, "_i", "_j"]])).applyInArrow(compare, f"{kinds}, id long, other long, distance long")
    by = Window.partitionBy(*keys, "id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).drop("_len")


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Pairs that are each other's nearest: keys, id, other, distance; the `most` nearest of each group of keys, if a number is given."""
    there = nearest(left, right, 1, keys)
    back = nearest(right, left, 1, keys).select(*keys, F.col("id").alias("other"), F.col("other").alias("id"))
    pairs = there.drop("rank").join(back, [*keys, "id", "other"], "left_semi")
    if most is None:
        return pairs
    by = Window.partitionBy(*keys).orderBy("distance", "id")
    return pairs.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def ratio_test(left: DataFrame, right: DataFrame, keys: list[str], ratio: float = 0.78) -> DataFrame:
    """Nearest matches that are clearly nearer than the second nearest: keys, id, other, distance."""
    two = nearest(left, right, 2, keys)
    second = two.where("rank = 2").select(*keys, "id", F.col("distance").alias("_second"))
    return two.where("rank = 1").join(second, [*keys, "id"]).where(F.col("distance") < F.col("_second") * F.lit(ratio)).drop("rank", "_second")
