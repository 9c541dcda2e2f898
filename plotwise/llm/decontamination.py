"""Benchmark passages in training text: a broadcast set of word windows, scanned over every document.

The set is broadcast while it has at most `at_once` windows. A larger benchmark is joined instead: a filter of
fixed size goes to the tasks, and windows that pass it meet the benchmark's by hash and words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import FILTER_BITS, key_filter, lent, passes, place, written
from .textkit import PLAIN_TABLE, Block, batches, blocks, fold64, give_back, windows, words

_BITS = 20
_WINDOWS = "k int, hash long, words binary, item string"
#: Windows that are broadcast at most (some 100 MB); beyond that they are joined.
AT_ONCE = 500_000


class _Set:
    """Windows of the benchmark: sorted hashes for each length, a bit table before them, and the words to verify."""

    def __init__(self, rows) -> None:
        self.by_length = {}
        for k, own in rows.groupby("k"):
            hashes = own["hash"].to_numpy(np.int64).view(np.uint64)
            table = np.zeros(1 << _BITS, bool)
            table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            known: dict[int, dict[bytes, set[str]]] = {}
            for h, w, item in zip(hashes.tolist(), own["words"], own["item"]):
                known.setdefault(h, {}).setdefault(bytes(w), set()).update([] if item is None else [item])
            self.by_length[int(k)] = (np.unique(hashes), table, known)

    def scan(self, block: Block) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Which of the block's words are hit, each document's first word, and its items."""
        starts, ends, hashes, first = words(block, PLAIN_TABLE)
        hit, items = np.zeros(len(starts) + 1, np.int64), {}
        for k, (known_hashes, table, known) in self.by_length.items():
            found = windows(hashes, k)
            at = np.flatnonzero(table[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[np.isin(found[at], known_hashes)]
            if not len(at):
                continue
            doc = np.searchsorted(first, at, side="right") - 1
            whole = at + k <= first[doc + 1]
            data = PLAIN_TABLE[block.data].tobytes()
            for i, d in zip(at[whole].tolist(), doc[whole].tolist()):
                text = b" ".join([data[a:b] for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist())])
                names = known[int(found[i])].get(text)  # the words themselves, not their hash, make a hit
                if names is not None:
                    hit[i] += 1
                    hit[i + k] -= 1
                    items.setdefault(d, set()).update(names)
        return np.cumsum(hit[:-1]) > 0, first, items


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row each of the benchmark's windows: length in words, hash, the words, and the item's id as text."""

    def cut(it) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, ["item", "text"]):
            for block in blocks(texts):
                starts, ends, hashes, first = words(block, PLAIN_TABLE)
                data = PLAIN_TABLE[block.data].tobytes()
                out = {"k": [], "hash": [], "words": [], "item": []}
                for d in range(len(block.rows)):
                    a, b = int(first[d]), int(first[d + 1])
                    k = min(window, b - a)
                    if not k:
                        continue
                    for j, h in enumerate(fold64(windows(hashes[a:b], k)).tolist()):
                        out["k"].append(k)
                        out["hash"].append(h)
                        out["words"].append(b" ".join([data[x:y] for x, y in zip(starts[a + j : a + j + k].tolist(), ends[a + j : a + j + k].tolist())]))
                        out["item"].append(ids[int(block.rows[d])].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.int32()), pa.array(out["hash"], pa.int64()), pa.array(out["words"], pa.binary()), pa.array(out["item"], pa.string())], names=["k", "hash", "words", "item"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, _WINDOWS)


def _runs(hit: np.ndarray) -> list[int]:
    """Ranges a, b, a, b, ... of the True entries."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()


_MARKS = [("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]


def _marked(documents: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str, at_once: int, keep: list[int]) -> DataFrame:
    """Columns `keep` of documents under names c0, c1, ... that cannot clash, with n_words, spans (ranges of hit words) and items (with repeats)."""
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index(text_col)]
    rows, kept = documents.toDF(*inner), [inner[i] for i in keep]
    schema = rows.select(*kept).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")}).schema
    known = written(benchmark_windows(benchmark, window, item_col, item_text_col), "windows")
    spark = documents.sparkSession

    def marker(find):
        """`find` gives which words of a block are hit, each document's first word, and each document's items."""

        def mark(it) -> Iterator[pa.RecordBatch]:
            for b in it:
                if not b.num_rows:
                    continue
                n_words, spans, items = [], [], []
                for block in blocks(b.column(b.schema.get_field_index(text))):
                    hit, first, found = find(block, b)
                    n_words += np.diff(first).tolist()
                    for d in range(len(block.rows)):
                        spans.append(_runs(hit[first[d] : first[d + 1]]) if d in found else [])
                        items.append(list(found.get(d, ())))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *[pa.array(x, kind) for x, (_, kind) in zip((n_words, spans, items), _MARKS)]], names=[*kept, *[c for c, _ in _MARKS]])
            give_back()

        return mark

    if known.count() <= at_once:
        held = spark.sparkContext.broadcast(_Set(known.toPandas()))
        return rows.mapInArrow(marker(lambda block, _: held.value.scan(block)), schema)

    # texts with a hit, each once: copies have the same hits
    marks = [F.xxhash64(F.col(text).cast("string")).alias("mark"), F.xxhash64(F.lit(1), F.col(text).cast("string")).alias("other")]
    with lent(spark, (key_filter(known, "hash", hashed=True), sorted(r.k for r in known.select("k").distinct().collect()))) as lengths:  # at most `window` lengths

        def seek(it) -> Iterator[pa.RecordBatch]:
            bits, sizes = lengths.value
            for texts, one, two in batches(it, ["text", "mark", "other"]):
                for block in blocks(texts):
                    out = [[] for _ in range(6)]
                    starts, ends, hashes, first = words(block, PLAIN_TABLE)
                    data = PLAIN_TABLE[block.data].tobytes()
                    for k in sizes:
                        found = fold64(windows(hashes, k))
                        at = np.flatnonzero(passes(bits, found % FILTER_BITS))
                        doc = np.searchsorted(first, at, side="right") - 1
                        whole = at + k <= first[doc + 1]
                        for i, d in zip(at[whole].tolist(), doc[whole].tolist()):
                            row = int(block.rows[d])
                            said = b" ".join([data[a:b] for a, b in zip(starts[i : i + k].tolist(), ends[i : i + k].tolist())])
                            for column, x in zip(out, (one[row].as_py(), two[row].as_py(), i - int(first[d]), k, int(found[i]), said)):
                                column.append(x)
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["mark", "other", "at", "k", "hash", "words"])
            give_back()

        sought = rows.select(F.col(text).cast("string").alias("text"), *marks).mapInArrow(seek, "mark long, other long, at int, k int, hash long, words binary")
        met = written(sought.distinct().join(known, ["k", "hash", "words"]).select("mark", "other", "at", "k", "item").distinct(), "met")
    # numbers of one text's own windows and items
    hits = written(met.groupBy("mark", "other").agg(F.collect_set(F.struct("at", "k")).alias("found"), F.collect_set("item").alias("names")), "hits")
    held = spark.sparkContext.broadcast(key_filter(hits, "mark"))
    base = rows.select("*", *marks).withColumn("place", place(F.col("mark")).cast("long"))

    def chosen(touched: bool) -> DataFrame:
        def pick(it):
            for b in it:
                yield b.filter(pa.array(passes(held.value, b.column(b.schema.get_field_index("place")).to_numpy()) == touched))

        return base.mapInArrow(pick, base.schema)

    def dealt(block: Block, b: pa.RecordBatch):
        _, _, hashes, first = words(block, PLAIN_TABLE)
        hit, found = np.zeros(len(hashes) + 1, np.int64), {}
        part = b.slice(int(block.rows[0]), len(block.rows))
        for d, (ranges, names_) in enumerate(zip(part.column(part.schema.get_field_index("found")).to_pylist(), part.column(part.schema.get_field_index("names")).to_pylist())):
            for r in ranges or ():
                hit[first[d] + r["at"]] += 1
                hit[first[d] + r["at"] + r["k"]] -= 1
            if ranges:
                found[d] = set(names_)
        return np.cumsum(hit[:-1]) > 0, first, found

    none = hits.select("found", "names").schema
    joined = chosen(True).join(hits, ["mark", "other"], "left").select(*inner, "found", "names")
    others = chosen(False).select(*inner, *[F.lit(None).cast(f.dataType).alias(f.name) for f in none])
    return joined.unionByName(others).mapInArrow(marker(dealt), schema)


def overlaps(documents: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """Which words of every document lie in an occurrence of a benchmark window, and of which items.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A window is
    `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Returns id_col, n_words, n_hit, n_items, items_sha256 (hex of the item ids, sorted as strings,
    comma-joined; of the empty string where there are none), contaminated.

    A null text has no words. Null ids, repeated rows and extra columns make no difference; an item with a
    null id hits but is not named; an empty benchmark hits nothing; an empty table gives no rows. A benchmark of
    at most `at_once` windows takes one pass over the documents and no shuffle; a larger one the same rows by joins.
    """
    frame = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _marked(frame, benchmark, window, "text", item_col, item_text_col, at_once, [0])
    items = F.array_sort(F.array_distinct("items"))
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select(
        F.col("c0").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """Documents without benchmark passages, in the columns they came with.

    remove="documents" drops every document that a window occurs in; remove="spans" cuts the hit words, and
    what stands between two of them, out of its text and keeps the rest: all hits are marked first, then cut
    at once. Words and windows as in overlaps(). Documents without a hit, null and empty texts among them, stay
    byte for byte; repeated rows are treated alike; an empty table gives no rows; columns may have any names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(text_col)
    found = _marked(documents, benchmark, window, text_col, item_col, item_text_col, at_once, list(range(len(names))))
    if remove == "documents":
        return found.where("size(spans) = 0").select(*inner).toDF(*names)

    def clean(it) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans = b.column(b.schema.get_field_index("spans")).to_pylist()
            column, new = b.column(at), {}
            for block in blocks(column) if any(spans) else ():
                starts, ends, _, first = words(block, PLAIN_TABLE)
                for d, row in enumerate(block.rows.tolist()):
                    if spans[row]:
                        own = slice(first[d], first[d + 1])
                        new[row] = _cut(block.text(d), starts[own] - block.offsets[d], ends[own] - block.offsets[d], spans[row])
            texts = pa.array([new[i].decode("utf-8", "replace") if i in new else column[i].as_py() for i in range(b.num_rows)], column.type) if new else column
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(len(inner))], names=inner)
        give_back()

    return found.mapInArrow(clean, documents.toDF(*inner).schema).toDF(*names)


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, spans: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])
