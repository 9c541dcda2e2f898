"""Token counts by a join of distinct pre-tokens: each is counted once, and documents only hold frequencies."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import partitions
from .textkit import RAW_TABLE, U64, batches, blocks, distinct, give_back, mix, text_buffers, words
from .tokens import piece_counter

#: Text of one message block: so many bytes share one list of distinct pre-tokens.
_BLOCK = 8 << 20
_MESSAGE = "bucket int, block long, n_docs int, words binary, doc binary, word binary, times binary, ids array<long>, sizes array<long>"

def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Tokens of every whole text without building ids: one row each of id_col, n_bytes, n_tokens, over_limit.

    1. Blocks of documents are cut into pre-tokens (runs between ASCII white space, which the vocabulary
       drops and never joins across) and counted per document.
    2. A block's distinct pre-tokens go to `buckets` by hash, each once a block, with their postings
       (document of the block, frequency). A bucket's messages follow one another in one task: there a
       pre-token is counted by the library once, whatever the number of blocks that hold it, and the product
       with the frequencies is summed per document of the block.
    3. The partial sums of a block meet by its number and are added.
    No row is sent for each word of each document, a word in every document is one entry a block, and a
    bucket keeps only its share of the vocabulary. Vocabularies that join across white space
    (sentencepiece, byte-level BPE) have no independent pre-tokens; there the whole text is the pre-token.

    Null and empty texts have 0 tokens; repeated rows and null ids are rows like any other; an empty table
    gives no rows; other columns are ignored. `buckets` is four times the number of shuffle partitions unless given.
    """
    spark = documents.sparkSession
    n_buckets = buckets or 4 * partitions(spark)
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not piece_counter(tokenizer).splits:
        return _whole(base, tokenizer, limit, id_col)

    def send(it) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block_no = TaskContext.get().partitionId() << 32
        for ids, texts in batches(it, ["doc_id", "text"]):
            for block in blocks(texts, _BLOCK):
                starts, ends, hashes, first = words(block, RAW_TABLE)
                one, number = distinct(hashes)
                data = block.data.tobytes()
                pieces = [data[i:j] for i, j in zip(starts[one].tolist(), ends[one].tolist())]
                bucket_of = np.array([zlib.crc32(p) for p in pieces], np.int64) % n_buckets
                doc = np.repeat(np.arange(len(block.rows)), np.diff(first))
                pair, times = np.unique(doc * max(1, len(one)) + number, return_counts=True)  # (document, pre-token)
                doc, number = np.divmod(pair, max(1, len(one)))
                order = np.argsort(bucket_of[number], kind="stable")
                doc, number, times = doc[order].astype("<u4"), number[order], times[order].astype("<u4")
                by = np.argsort(bucket_of, kind="stable")
                local = np.empty(len(one), np.int64)  # a pre-token's number within its bucket
                edges = np.searchsorted(bucket_of[by], np.arange(n_buckets + 1))
                local[by] = np.arange(len(by)) - np.repeat(edges[:-1], np.diff(edges))
                cuts = np.searchsorted(bucket_of[number], np.arange(n_buckets + 1))
                rows = {k: [] for k in ("bucket", "words", "doc", "word", "times")}
                for k in np.flatnonzero(np.diff(edges)):
                    a, b = cuts[k], cuts[k + 1]
                    rows["bucket"].append(k)
                    rows["words"].append(b"\n".join([pieces[i] for i in by[edges[k] : edges[k + 1]]]))
                    rows["doc"].append(_small(doc[a:b]))
                    rows["word"].append(_small(local[number[a:b]]))
                    rows["times"].append(_small(times[a:b]))
                n, m = len(rows["bucket"]) + 1, len(block.rows)
                head = [block_no] * n
                sizes = np.diff(block.offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*rows["bucket"], -1 - int(mix(np.array([block_no], U64))[0] % U64(1 << 30))], pa.int32()),
                        pa.array(head, pa.int64()),
                        pa.array([m] * n, pa.int32()),
                        *[pa.array([*rows[c], None], pa.binary()) for c in ("words", "doc", "word", "times")],
                        pa.array([None] * (n - 1) + [ids.slice(int(block.rows[0]), m).to_pylist()], pa.list_(pa.int64())),
                        pa.array([None] * (n - 1) + [sizes.tolist()], pa.list_(pa.int64())),
                    ],
                    names=["bucket", "block", "n_docs", "words", "doc", "word", "times", "ids", "sizes"],
                )
                block_no += 1

    def count(it) -> Iterator[pa.RecordBatch]:
        counter, now, known = piece_counter(tokenizer), None, {}
        for b in it:
            out = []
            for bucket, text, doc, word, times, n in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "words", "doc", "word", "times", "n_docs")]):
                if text is None:
                    out.append(None)
                    continue
                if bucket != now:
                    now, known = bucket, {}
                pieces = text.split(b"\n")
                new = [p for p in pieces if p not in known]
                known.update(zip(new, counter.counts(new)))
                each = np.array([known[p] for p in pieces], np.float64)
                out.append(_small(np.bincount(_big(doc), each[_big(word)] * _big(times), n).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in ("block", "n_docs")], pa.array(out, pa.binary()), *[b.column(b.schema.get_field_index(c)) for c in ("ids", "sizes")]], names=["block", "n_docs", "sums", "ids", "sizes"])
        give_back()

    def add(key, table):
        total, ids, sizes = 0, None, None
        for part, i, s in zip(*[table.column(c).to_pylist() for c in ("sums", "ids", "sizes")]):
            if part is None:
                ids, sizes = i, s
            else:
                total = total + _big(part)
        total = np.zeros(len(ids), np.int64) + total
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total)})

    n_parts = partitions(spark)
    sent = base.mapInArrow(send, _MESSAGE).repartitionById(n_parts, F.pmod("bucket", F.lit(n_parts)).cast("int")).sortWithinPartitions("bucket")
    counted = sent.mapInArrow(count, "block long, n_docs int, sums binary, ids array<long>, sizes array<long>")
    out = counted.groupBy("block").applyInArrow(add, "doc_id long, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

def _whole(base: DataFrame, tokenizer: str, limit: int, id_col: str) -> DataFrame:
    def count(it) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(tokenizer)
        for ids, texts in batches(it, ["doc_id", "text"]):
            data, offsets = text_buffers(texts)
            n = counter.counts([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out = base.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

def _small(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs; the first byte tells how many."""
    top = int(x.max()) if len(x) else 0
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8"
    return bytes([int(kind[2])]) + x.astype(kind).tobytes()

def _big(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<{'i' if x[0] == 8 else 'u'}{x[0]}", offset=1).astype(np.int64)
