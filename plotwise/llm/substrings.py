"""Repeated passages by content-defined chunks: gear cuts, chunk digests that meet in buckets, then an exact check.

A gear hash over each word's bytes ranks the words; the lowest of any `NEAR` in a row is a cut. Cuts depend on
the words around them alone, so words inserted before a passage do not move the cuts inside it. A chunk goes
from a cut to the first cut that is far enough; any repeated window of `UNIT_WORDS` words holds a whole chunk.

1. Chunks are deduplicated by digest: digests meet in buckets, and those that stand twice are dealt back.
2. Only around such chunks, windows of `UNIT_WORDS` words are digested the same way: a word goes if it lies in
   a window that stands earlier, so a passage goes from its first word to its last and nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import key_filter, lent, partitions, passes, place, remove, written
from .textkit import RAW_TABLE, U64, Block, batches, blocks, give_back, mix, run_hashes, span_hashes, words

#: Text whose digests share one message a bucket.
_BLOCK = 1 << 20
#: The gear table: 16 random bits a byte value. A 16-bit gear hash forgets all but the last 16 bytes.
_GEAR = (mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F)) >> U64(48)).astype(np.uint16)
#: A word of more bytes than this is cut inside as well, between characters.
_LONG_WORD = 64
#: Of so many places in a row inside a long word, the one with the least gear hash is a cut, the last of equals.
_LEAST_OF = 24
#: Words of a window: what is shorter is no repeat.
UNIT_WORDS = 20
#: Buckets that a partition takes one after another, so that it holds an eighth of its digests at a time.
_FINE = 8
#: A block with fewer digests than this for each message sends several buckets of a partition in one.
_FEW = 256

_FLAGS = "block long, doc binary, place binary, sizes binary, ids array<long>, marks array<long>"
_MESSAGE = "bucket int, span int, digest binary, who binary, " + _FLAGS


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: h(i) = 2 h(i-1) + G[byte], in 16 bits, by doubling the window four times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def pieces(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and each document's first word (one entry more). Long words are cut into several.

    A cut inside a word depends on the bytes near it alone and some place in any `_LEAST_OF` is one, so a passage
    without white space has the same cuts wherever it stands, but for its ends.
    """
    starts, ends, hashes, first = words(block, RAW_TABLE)
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    if len(long):
        h = gear(block.data)
        lo, size = starts[long] + 16, ends[long] - starts[long] - 16
        inner = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        word = np.repeat(long, size)
        between = (block.data[inner] & 0xC0) != 0x80
        inner, word = inner[between], word[between]
        if len(inner) >= _LEAST_OF:
            k = _LEAST_OF - 1
            behind = np.lib.stride_tricks.sliding_window_view(h[inner - 1][::-1], _LEAST_OF).argmin(1)[::-1]
            at = np.arange(len(behind)) + k - behind
            inner = inner[np.unique(at[word[k:] == word[: len(word) - k]])]
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
            hashes = span_hashes(RAW_TABLE[block.data], starts, ends)
            first = np.searchsorted(starts, block.offsets, side="left")
    return starts, ends, hashes, first


def near(least_words: int) -> int:
    """Of so many words in a row one is a cut, for repeats of `least_words` words."""
    return max(1, least_words // 5)


def chunks(block: Block, least_words: int = UNIT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, document of the block, first word in it and number of words of every chunk.

    Whether a word is a cut the w - 1 words on either side of it decide (w = near()). A repeat of `least_words`
    words leaves all but w - 1 words at its ends decided, its first cut comes w words on at the latest, and a
    chunk's last cut at most w - 1 words beyond the least size; that size is what is left.
    """
    starts, ends, hashes, first = pieces(block)
    w = near(least_words)
    unit, n = max(1, least_words - 4 * (w - 1) - 1), len(starts)
    if n < w:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    h, size = gear(block.data), np.minimum(ends - starts, 16)
    carried = np.where(starts > 0, h[starts - 1], 0).astype(np.uint32) << size.astype(np.uint32)
    rank = h[ends - 1] - carried.astype(np.uint16)  # the hash of the word's own bytes
    behind = np.lib.stride_tricks.sliding_window_view(rank[::-1], w).argmin(1)[::-1]
    at = np.unique(np.arange(len(behind)) + w - 1 - behind)  # the last of equals: lines that repeat have cuts as well
    upto = np.searchsorted(at, at + unit)
    whole = np.flatnonzero(upto < len(at))
    begin, end = at[whole], at[upto[whole]]
    doc = np.searchsorted(first, begin, side="right") - 1
    inside = end <= first[doc + 1]
    begin, end, doc = begin[inside], end[inside], doc[inside]
    return run_hashes(hashes, begin, end) if len(begin) else np.zeros(0, U64), doc, begin - first[doc], end - begin


def windows_around(block: Block, ranges: list, least_words: int = UNIT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, document, first word and number of words of the windows that can hold a chunk of the ranges a, b, a, b, ... of each document."""
    _, _, hashes, first = pieces(block)
    unit = max(1, least_words - 4 * (near(least_words) - 1) - 1)
    n_words, starts = np.diff(first), [np.zeros(0, np.int64)]
    for d, own in enumerate(ranges):
        own = np.array(own or [], np.int64)
        for a, b in zip(own[::2], own[1::2]):
            starts.append(np.arange(max(0, a + unit - least_words), min(n_words[d] - least_words, b - unit) + 1) + first[d])
    at = np.unique(np.concatenate(starts))
    doc = np.searchsorted(first, at, side="right") - 1
    return run_hashes(hashes, at, at + least_words) if len(at) else np.zeros(0, U64), doc, at - first[doc], np.full(len(at), least_words)


def later(digest: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where an entry's digest has another entry at a smaller (doc, place); and for one entry each digest, at the smallest."""
    out = np.zeros(len(digest), bool)
    order = np.argsort(digest)
    same = digest[order[1:]] == digest[order[:-1]]
    many = np.zeros(len(digest), bool)
    many[1:] |= same
    many[:-1] |= same
    some = order[many]
    some = some[np.lexsort((place[some], doc[some], digest[some]))]
    new = np.ones(len(some), bool)
    new[1:] = digest[some[1:]] != digest[some[:-1]]
    lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    out[some] = (doc[some] != doc[lead]) | (place[some] != place[lead])
    leads = np.ones(len(digest), bool)
    leads[some] = new
    return out, leads


def twice(digest: np.ndarray) -> np.ndarray:
    """True where another entry has the same digest."""
    order = np.argsort(digest)
    same = digest[order[1:]] == digest[order[:-1]]
    out = np.zeros(len(digest), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _planes(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones: high bytes that are alike take no room once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges with those that overlap or touch made one, by document and place."""
    order = np.lexsort((start, doc))
    a, b = (doc[order] << 32) | start[order], np.maximum.accumulate((doc[order] << 32) | end[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.zeros(0, np.int64)
    return a[new] >> 32, a[new] & 0xFFFFFFFF, b[last] & 0xFFFFFFFF


_HEAD = [("bucket", pa.int32()), ("span", pa.int32()), ("digest", pa.binary()), ("who", pa.binary())]
_FLAG_FIELDS = [("block", pa.int64()), *[(c, pa.binary()) for c in ("doc", "place", "sizes")], ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))]
_ARROW, _FLAG_ARROW = pa.schema(_HEAD + _FLAG_FIELDS), pa.schema(_FLAG_FIELDS)


def flagged(rows: DataFrame, find: Callable, earlier: bool) -> DataFrame:
    """Word ranges of every document whose digests stand elsewhere: doc_id, mark, spans (a, b, a, b, ..., those that overlap or touch made one).

    `find` gives a block's digests from the block and its documents' ranges. With `earlier` an entry counts if
    its digest stands at a smaller (document id, word), else if it stands at any other place.

    Per block of documents each digest travels once (its first occurrence there) to the bucket its hash names;
    the bucket flags entries back to their blocks. A digest in every document costs one entry a block, not a
    group. A block's own list of documents goes with it to a partition of its number.
    """
    n_parts = partitions(rows.sparkSession)

    def bucket_of(digests: np.ndarray) -> np.ndarray:
        """A partition's buckets follow one another."""
        return ((digests % U64(n_parts)) * U64(_FINE) + (digests // U64(n_parts)) % U64(_FINE)).astype(np.int64)

    def cut(it) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for ids, marks, texts, ranges in batches(it, ["doc_id", "mark", "text", "ranges"]):
            ids, ranges = ids.to_numpy(), ranges.to_pylist()
            for block in blocks(texts, _BLOCK):
                own = ids[block.rows]
                digests, doc, place, size = find(block, ranges[block.rows[0] : block.rows[-1] + 1])
                again, leads = later(digests, own[doc], place)
                again = again if earlier else twice(digests)
                order = np.flatnonzero(leads)
                bucket = bucket_of(digests[order])
                by = np.argsort(bucket, kind="stable")
                order, bucket = order[by], bucket[by]
                span = 1
                while span < _FINE and len(order) * span < n_parts * _FINE * _FEW:
                    span *= 2
                starts = np.flatnonzero(np.diff(bucket // span, prepend=-1))
                out = []
                for i, j in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist()):
                    part = order[i:j]
                    out.append({"bucket": int(bucket[i]) // span * span, "span": span, "block": number, "digest": digests[part].tobytes(), "who": _planes(own[doc[part]].astype("<i8")) if earlier else None, "doc": _planes(np.diff(doc[part], prepend=0).astype("<u4")), "place": _planes(place[part].astype("<u4")), "sizes": size[part].astype("<u2").tobytes()})
                d, a, b = merged(doc[again], place[again], place[again] + size[again])
                out.append({"bucket": -1 - int(mix(np.array([number], U64))[0] % U64(n_parts)), "span": 1, "block": number, "doc": d.astype("<u4").tobytes(), "place": a.astype("<u4").tobytes(), "sizes": (b - a).astype("<u4").tobytes(), "ids": own.tolist(), "marks": marks.take(pa.array(block.rows)).to_pylist()})
                number += 1
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        give_back()

    def settle(held: list[tuple]) -> pa.RecordBatch:
        """Flags of one bucket: (block, digests, ids, documents, places, sizes) of each message."""
        digests, at, out = np.concatenate([h[1] for h in held]), 0, []
        flag = later(digests, *(np.concatenate([h[k] for h in held]) for k in (2, 4)))[0] if earlier else twice(digests)
        for block, d, _, local, place, size in held:
            own = flag[at : at + len(d)]
            at += len(d)
            if own.any():
                out.append({"block": block, "doc": local[own].tobytes(), "place": place[own].tobytes(), "sizes": size[own].astype("<u4").tobytes()})
        return pa.RecordBatch.from_pylist(out, schema=_FLAG_ARROW)

    def settled(held: list, now: int, upto: int) -> Iterator[pa.RecordBatch]:
        """Settles the buckets from `now` up to another, and drops messages that are through."""
        while held and now < upto:
            part = []
            for message, first, edges in held:
                if 0 <= now - first < len(edges) - 1 and edges[now - first] < edges[now - first + 1]:
                    own = slice(edges[now - first], edges[now - first + 1])
                    part.append((message[0], *[x if x is None else x[own] for x in message[1:]]))
            if part:
                yield settle(part)
            now += 1
            held[:] = [h for h in held if h[1] + len(h[2]) - 1 > now]

    def meet(it) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # a message, its first bucket, and where each of its buckets begins
        now = 0
        for b in it:
            for i in range(b.num_rows):
                row = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
                if row["bucket"] < 0:
                    yield pa.RecordBatch.from_pylist([{k: row[k] for k in _FLAG_ARROW.names}], schema=_FLAG_ARROW)
                    continue
                yield from settled(held, now, row["bucket"])
                now = row["bucket"]
                digests = np.frombuffer(row["digest"], U64)
                message = (row["block"], digests, None if row["who"] is None else _numbers(row["who"], "<i8"), np.cumsum(_numbers(row["doc"], "<u4"), dtype=np.uint32), _numbers(row["place"], "<u4"), np.frombuffer(row["sizes"], "<u2"))
                held.append((message, now, np.searchsorted(bucket_of(digests), np.arange(now, now + row["span"] + 1))))
        yield from settled(held, now, now + _FINE)
        give_back()

    def decide(key, table):
        head, parts = None, []
        for row in table.to_pylist():
            head = row if row["ids"] is not None else head
            parts.append([np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("doc", "place", "sizes")])
        doc, start, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
        doc, start, end = merged(doc, start, start + size)
        found, at = np.unique(doc, return_index=True)
        spans = np.split(np.stack([start, end], 1), at[1:])
        out = {"doc_id": [head["ids"][d] for d in found], "mark": [head["marks"][d] for d in found], "spans": [x.ravel().tolist() for x in spans[: len(found)]]}
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.list_(pa.int64()))]))

    part_of = F.when(F.col("bucket") >= 0, F.floor(F.col("bucket") / _FINE)).otherwise(-1 - F.col("bucket")).cast("int")
    sent = rows.select("doc_id", "mark", "text", "ranges").mapInArrow(cut, _MESSAGE).repartitionById(n_parts, part_of).sortWithinPartitions("bucket")
    found = sent.mapInArrow(meet, _FLAGS).groupBy("block").applyInArrow(decide, "doc_id long, mark long, spans array<long>")
    return found.dropDuplicates(["doc_id", "mark"])  # rows of one id and text have the same ranges


class _Rows:
    """A table under names that cannot clash, with the id, the text's hash and the id's place in a filter at hand."""

    def __init__(self, documents: DataFrame, id_col: str, text_col: str) -> None:
        names = documents.columns
        self.inner = [f"c{i}" for i in range(len(names))]
        self.text = self.inner[names.index(text_col)]
        plain = documents.toDF(*self.inner)
        self.schema = plain.schema
        self.key = F.col(self.inner[names.index(id_col)]).cast("long")
        self.mark = F.xxhash64(F.col(self.text).cast("string"))
        self.frame = plain.withColumn("at", F.coalesce(place(self.key), F.lit(-1)).cast("long"))

    def chosen(self, held, touched: bool) -> DataFrame:
        """Rows whose id the filter passes, or the others."""
        inner = self.inner

        def pick(it):
            bits = held.value
            for b in it:
                where = b.column(b.schema.get_field_index("at")).to_numpy()
                hit = (where >= 0) & passes(bits, np.maximum(where, 0))
                yield b.filter(pa.array(hit == touched)).select(inner)

        return self.frame.mapInArrow(pick, self.schema)

    def join(self, held, ranges: DataFrame, how: str) -> DataFrame:
        """The rows that the filter passes with their `spans`, one row a row."""
        keys = ranges.select(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"), "spans")
        return self.chosen(held, True).join(keys, (self.key == F.col("key_id")) & (self.mark == F.col("key_mark")), how).select(*self.inner, "spans")


def repeated_spans(documents: DataFrame, least_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word ranges of every document that repeat what stands earlier: doc_id, mark (hash of the text), spans.

    Earlier means a smaller document id, or before in the same document. Ranges are all windows of `least_words`
    words (2 or more) that stand earlier, those that overlap or touch made one; each (doc_id, mark) with such a
    window has one row. Rows without an id are not looked at; rows of one id are one document.
    """
    if least_words < 2:
        raise ValueError("least_words must be 2 or more")
    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), F.lit(None).cast("array<long>").alias("ranges")).where("doc_id is not null")
    around = written(flagged(rows, lambda block, _: chunks(block, least_words), earlier=False), "chunks")
    plain = _Rows(rows.select("doc_id", "text"), "doc_id", "text")
    with lent(spark, key_filter(around, "doc_id")) as held:
        close = plain.join(held, around, "inner").toDF("doc_id", "text", "ranges").withColumn("mark", F.xxhash64("text"))
        spans = written(flagged(close, lambda block, ranges: windows_around(block, ranges, least_words), earlier=True), "spans")
    remove(spark, around.plotwise_path)
    return spans


def _cut(documents: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """Every row under inner names, its text cut, with n_words, n_removed and removed."""
    spans = repeated_spans(documents, least_words, id_col, text_col)
    rows = _Rows(documents, id_col, text_col)
    held = documents.sparkSession.sparkContext.broadcast(key_filter(spans, "doc_id"))
    inner, at = rows.inner, rows.text
    done = rows.join(held, spans, "left").unionByName(rows.chosen(held, False).withColumn("spans", F.lit(None).cast("array<long>")))

    def cut(it) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            k = b.schema.get_field_index(at)
            for block in blocks(b.column(k)):
                part = b.slice(int(block.rows[0]), len(block.rows))
                ranges = part.column(part.schema.get_field_index("spans"))
                listed = ranges.to_pylist() if ranges.null_count < len(ranges) else [None] * len(ranges)
                starts, ends, _, first = pieces(block)
                n_words, texts = np.diff(first), {}
                n_removed = np.array([sum(r[1::2]) - sum(r[::2]) if r else 0 for r in listed], np.int64)
                for d in np.flatnonzero(n_removed).tolist():
                    raw, lo, kept, upto, own = block.text(d), block.offsets[d], [], 0, listed[d]
                    for x, y in zip(own[::2], own[1::2]):
                        kept.append(raw[upto : starts[first[d] + x] - lo])
                        upto = int(ends[first[d] + y - 1] - lo)
                    texts[d] = b"".join([*kept, raw[upto:]]).decode("utf-8", "replace").strip() if n_removed[d] < n_words[d] else ""
                old = part.column(k)
                new = pa.array([texts[d] if d in texts else old[d].as_py() for d in range(len(old))], old.type) if texts else old
                yield pa.RecordBatch.from_arrays([*[new if i == k else part.column(i) for i in range(len(inner))], pa.array(n_words), pa.array(n_removed), ranges], names=[*inner, *REPORT])
        give_back()

    schema = documents.toDF(*inner).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<long>")}).schema
    return done.mapInArrow(cut, schema)


#: What drop_repeats() says of each row.
REPORT = ["n_words", "n_removed", "removed"]


def drop_repeats(documents: DataFrame, least_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of documents with later copies of passages cut from its text, and what was cut.

    Columns: those of documents, then `n_words` and `n_removed` (words), `removed` (word ranges a, b, a, b, ...
    of the text as it was); columns of documents with these three names are left out. The first occurrence of a
    passage stays, by document id and place. A document that only repeats becomes an empty text; null and empty
    texts and rows without an id stay as they are; rows of one id are one document and one row each; an
    empty table gives no rows. A repeat of `least_words` words or more goes from its first word to its last; in
    text without white space, from the first cut inside it to the last.

    Only texts with something to cut are shuffled (a 1 MB filter over their ids, of fixed size, passes them);
    the others are copied as they are read.
    """
    cut = _cut(documents, least_words, id_col, text_col)
    keep = [(f"c{i}", name) for i, name in enumerate(documents.columns) if name not in REPORT]
    return cut.select(*[c for c, _ in keep], *REPORT).toDF(*[name for _, name in keep], *REPORT)


def without_repeats(documents: DataFrame, least_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Documents in the columns they came with, later copies of passages cut; those of which nothing is left go.

    `chars_col`, if documents have it, follows a text that was cut. All else as in drop_repeats(); any column names may stand in documents.
    """
    names = documents.columns
    cut = _cut(documents, least_words, id_col, text_col).where("n_removed = 0 or n_removed < n_words")
    if chars_col in names:
        at = f"c{names.index(chars_col)}"
        n_chars = F.when(F.col("n_removed") > 0, F.length(f"c{names.index(text_col)}")).otherwise(F.col(at))
        cut = cut.withColumn(at, n_chars.cast(documents.schema[chars_col].dataType))
    return cut.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
