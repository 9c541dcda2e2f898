"""Importance resampling towards a target distribution by hashed word runs.

Every task keeps a trie of the words it meets. A node stands for a run of words; it holds how often the run came
and the CRC state of its bytes, from which a child's state continues, so no run is ever put together. What leaves a task
are totals by bucket: a trie that has grown to its bound is added to them and begun anew. With the totals of both tables
each bucket has a gain. A second pass walks the documents' runs through tries whose nodes carry their gains.

Ranks come from a range partitioning of the scores: each partition counts its rows, and what stands before it is added.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import lent, partitions, small_batches, written

#: A trie is emptied beyond so many nodes, or bytes of words.
NODES, WORD_BYTES = 1 << 18, 1 << 25
#: Texts are split into words a piece of so many bytes at a time.
PIECE = 1 << 20

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text: runs of ASCII letters, lowered, digits and anything beyond ASCII; some at a time."""
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text):  # on to the end of the word
            while to < len(text) and _SPACED[text[to]] != 32:
                to += 1
        yield text[at:to].translate(_SPACED).split()
        at = to


class Trie:
    """Word runs of up to `longest` words, each a node."""

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None) -> None:
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.children: list[dict | None] = [{}]
        self.state, self.count, self.gain, self.held = [0], [0], [0], 0

    def child(self, parent: int, word: bytes) -> int:
        below = self.children[parent]
        if below is None:
            below = self.children[parent] = {}
        node = below.get(word)
        if node is None:
            node = below[word] = len(self.state)
            state = zlib.crc32(b" " + word, self.state[parent]) if parent else zlib.crc32(word)
            self.children.append(None)
            self.state.append(state)
            self.count.append(0)
            self.gain.append(self.gains[state % self.buckets] if self.gains else 0)
            self.held += len(word)
        return node

    def full(self) -> bool:
        return len(self.state) > NODES or self.held > WORD_BYTES

    def walk(self, words: list[bytes], open_runs: list[int]) -> Iterator[int]:
        """The node of every run that ends in these words; `open_runs` are the nodes that the words before left to go on from."""
        for word in words:
            open_runs[:] = [self.child(p, word) for p in [0, *open_runs[: self.longest - 1]]]
            yield from open_runs

    def add(self, words: list[bytes], open_runs: list[int]) -> None:
        if self.longest == 1:
            for word, n in Counter(words).items():
                self.count[self.child(0, word)] += n
        else:
            for node in self.walk(words, open_runs):
                self.count[node] += 1

    def weigh(self, words: list[bytes], open_runs: list[int]) -> tuple[int, int]:
        """How many runs end in these words, and the sum of their gains."""
        if self.longest == 1:
            first = self.children[0]
            for word in set(words).difference(first):
                self.child(0, word)
            return len(words), sum(map(self.gain.__getitem__, map(first.__getitem__, words)))
        nodes = list(self.walk(words, open_runs))
        return len(nodes), sum(map(self.gain.__getitem__, nodes))

    def spelled(self, nodes: list[int]) -> list[list[bytes]]:
        """The words of the runs that end in some nodes."""
        if self.longest == 1 or not nodes:
            return []
        up = {node: (parent, word) for parent, below in enumerate(self.children) for word, node in (below or {}).items()}
        runs = []
        for node in nodes:
            run = []
            while node:
                node, word = up[node]
                run.append(word)
            runs.append(run[::-1])
        return runs

    def spell(self, run: list[bytes]) -> int:
        node = 0
        for word in run:
            node = self.child(node, word)
        return node

    def totals(self) -> np.ndarray:
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, np.array(self.state[1:], np.int64) % self.buckets, self.count[1:])
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch["text"].cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_totals(table: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Occurrences of all runs by bucket; `buckets` numbers come to the driver, whatever the table's size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = Trie(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch):
                open_runs: list[int] = []
                for words in pieces(text):
                    if trie.full():  # open runs name nodes: they are walked again from the root
                        sums += trie.totals()
                        kept = trie.spelled(open_runs)
                        trie.clear()
                        open_runs = [trie.spell(run) for run in kept]
                    trie.add(words, open_runs)
        sums += trie.totals()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["bucket", "n"])

    rows = table.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    k, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + k) / ((s + 1.0) * (all_t + k)))) for s, t in zip(source.tolist(), target.tolist())]


def importance_sample(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of documents (doc_id, text), drawn towards target (text).

    A document's weight is the sum of its runs' gains, its score that plus a Gumbel number from the hash of `seed:doc_id`.
    Of the N documents of at least `least` words, the floor(percent * N / 100) highest scores are drawn and ranked, ties to smaller
    ids; the others' rank is null. Null and empty texts have no words and weight 0. A row without an id counts in the totals, has
    no score and is never drawn, nor in N. Rows of one id are documents each. Further columns are ignored; an empty target gives
    every bucket the same numerator.
    """
    spark = documents.sparkSession
    small_batches(spark)
    gain = gains(bucket_totals(documents, longest, buckets), bucket_totals(target, longest, buckets))
    kind = documents.schema["doc_id"].dataType

    with lent(spark, gain) as held:
        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(longest, buckets, held.value)
            for batch in batches:
                out = []
                for text in _texts(batch):
                    n = runs = weight = 0
                    open_runs: list[int] = []
                    for words in pieces(text):
                        if trie.full():
                            kept = trie.spelled(open_runs)
                            trie.clear()
                            open_runs = [trie.spell(run) for run in kept]
                        more, sum_ = trie.weigh(words, open_runs)
                        n, runs, weight = n + len(words), runs + more, weight + sum_
                    out.append((n, runs, weight))
                columns = [pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_features", "weight"])

        weighed = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(weigh, f"doc_id {kind.simpleString()}, n_words long, n_features long, weight long")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
        gumbel = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = written(weighed.withColumn("score", F.col("weight") + gumbel), "scores")
    may = F.coalesce((F.col("n_words") >= least) & F.col("doc_id").isNotNull(), F.lit(False))
    draw = percent * scored.where(may).count() // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    ranked = rank_all(scored.where(may).select(shown), [F.desc("score"), F.asc("doc_id")], "rank")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(~may).select(*shown, F.lit(None).cast("long").alias("rank")))


def rank_all(table: DataFrame, order: list, name: str) -> DataFrame:
    """The table with each row's place (1, 2, ...) in a total order, without a task that holds all rows."""
    spark = table.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "_part", "_at"])
            at += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    held = written(table.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, f"{fields}, _part long, _at long"), "ranks")
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # one row a shuffle partition
    return held.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
