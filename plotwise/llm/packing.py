"""Packing without padding: documents are cut at powers of two, and pieces of equal length share a bucket.

Sequences are numbered bucket after bucket, so a bucket is one range of sequence ids and a batch is a range
within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import written
from .textkit import batches, blocks
from .tokens import encoder

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths, longest first: whole pieces of `longest` (a power of two), then the set bits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _bases(counts: DataFrame, stretch: int = 1024) -> DataFrame:
    """length, part, base: pieces before each partition's own, the longest bucket first, from a row a partition and bucket.

    Three levels: buckets (log2(longest) + 1 of them), stretches of so many partitions within a bucket, partitions within a
    stretch. No window holds more than a stretch, or the stretches of a bucket.
    """
    rows = counts.withColumn("_stretch", F.floor(F.col("part") / stretch))
    before = lambda *keys: F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - F.col("n")
    own = rows.withColumn("_own", before("length", "_stretch", "part"))
    stretches = rows.groupBy("length", "_stretch").agg(F.sum("n").alias("n"))
    stretches = stretches.select("length", "_stretch", before("length", "_stretch").alias("_near"))
    buckets = sorted(rows.groupBy("length").agg(F.sum("n").alias("n")).collect(), reverse=True)
    far, total = [], 0
    for length, n in buckets:
        far.append((length, total))
        total += n
    far = F.broadcast(counts.sparkSession.createDataFrame(far, "length long, _far long"))
    return own.join(stretches, ["length", "_stretch"]).join(far, "length").select("length", "part", (F.col("_own") + F.col("_near") + F.col("_far")).alias("base"))


def pack_powers_of_two(documents: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Splits every document into pieces of binary length; each piece is a sequence of exactly its length.

    A document of n ids (its text's, then `end_id`) gives floor(n / longest) pieces of `longest` and one for
    each set bit of the rest, in falling length. Pieces of one length form a bucket (`length`): a batch
    takes its rows from one bucket, so nothing is padded, no sequence holds two documents, and each id lies
    in exactly one piece. `sequence_id` counts from 0 without gaps over all pieces, the longest bucket first; within
    a bucket by partition of the input and order in it. `offset` is 0.

    Returns one row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids`
    (array of int) if `with_ids`. A null or empty text is one piece of length 1, the end id; null ids and
    repeated rows are packed like any other row; an empty table gives no rows; other columns are ignored.

    Each task encodes its own rows: no shuffle of text or ids. What is written between is a row a piece, and
    the numbering joins one row for each input partition and bucket (at most log2(longest) + 1 a partition), by broadcast
    as long as these rows are below the session's own bound.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def cut(it) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer)
        for ids, texts in batches(it, ["doc_id", "text"]):
            for block in blocks(texts):
                flat, offsets = enc.block(block, end_id)
                flat = flat.astype("<u4")
                starts, lengths, crcs, row, totals, kept = [], [], [], [], [], []
                for i in range(len(block.rows)):
                    own, at = flat[offsets[i] : offsets[i + 1]], 0
                    view = memoryview(own).cast("B")
                    for n in binary_pieces(len(own), longest):
                        starts.append(at)
                        lengths.append(n)
                        crcs.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                        row.append(i)
                        totals.append(len(own))
                        if with_ids:
                            kept.append(own[at : at + n])
                        at += n
                doc = ids.take(pa.array(block.rows[row] if row else [], pa.int64()))
                size, place = np.array(lengths, np.int64), np.empty(len(row), np.int64)
                for n in np.unique(size).tolist():  # a piece's place in its bucket, within this partition
                    own = np.flatnonzero(size == n)
                    place[own] = done.get(n, 0) + np.arange(len(own))
                    done[n] = done.get(n, 0) + len(own)
                cols = [doc, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(place)]
                if with_ids:
                    sizes = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(kept).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place", *["ids"] * with_ids])

    pieces = written(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, _PIECE + ", ids array<int>" * with_ids), "pieces")
    out = pieces.join(_bases(written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")), ["length", "part"])
    return out.select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)


def write_buckets(pieces: DataFrame, path: str, files: int = 8) -> None:
    """Writes pieces as a folder a bucket (`length=...`), each in some `files` files, sorted by sequence_id: a batch reads one folder.

    Pieces of one length may be a third of all rows or more: they are dealt over the files, not sent to one task.
    """
    share = F.pmod(F.xxhash64("sequence_id"), F.lit(files)).cast("int")
    pieces.repartition(F.col("length"), share).sortWithinPartitions("length", "sequence_id").write.partitionBy("length").parquet(path)
