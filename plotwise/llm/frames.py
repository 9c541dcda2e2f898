"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File format, readable by any zstandard decoder that skips skippable frames:

    frame 0 | frame 1 | ... | document index | seek table

- A frame is a complete zstandard frame of little-endian unsigned ids (2 bytes each, or 4 where the
  vocabulary is larger). A document lies whole in one frame unless it is longer than `frame_ids`.
- The document index is a skippable frame (magic 0x184D2A50): "PWDX", width of an id in bytes (u32), number
  of documents (u64), then for every document its id (i64) and its number of ids (i64), zstandard-compressed.
- The seek table is a skippable frame (magic 0x184D2A5E) as in the public seekable format: per frame
  compressed size, decompressed size and the low 32 bits of the xxHash64 of the decompressed bytes (u32
  each), then the number of frames (u32), a descriptor byte (0x80: checksums) and the magic 0x8F92EAB1.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import new_path, partitions, written
from .textkit import batches, blocks
from .tokens import encoder

_INDEX_MAGIC, _SEEK_MAGIC, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Text of one file on average, at most: what a writer holds for its document index is 16 bytes a document.
FILE_BYTES = 1 << 30
_MANIFEST = "path string, first_doc long, n_docs long, n_ids long, n_frames long, n_bytes long"


def _open(path: str):
    """The file system of a URI (local, hdfs, s3 or gs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes one file. Documents come in order; a frame is closed at `frame_ids` ids or before a document that would pass it."""

    def __init__(self, path: str, dtype: np.dtype, frame_ids: int = 1 << 17, level: int = 3) -> None:
        import zstandard

        self.fs, self.path = _open(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.dtype, self.frame_ids = dtype, frame_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_docs = self.n_ids = self.n_bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []  # blocks of (id, number of ids): 16 bytes a document

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        """One document."""
        self.add_block(np.array([doc_id]), ids, np.array([0, len(ids)]))

    def add_block(self, doc_ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        """Documents whose ids stand one after another in `flat`, from `offsets[i]` to `offsets[i + 1]`."""
        self.docs.append(np.stack([doc_ids, np.diff(offsets)], 1).astype("<i8"))
        self.n_docs += len(doc_ids)
        self.n_ids += int(offsets[-1] - offsets[0])
        at = 0
        while at < len(doc_ids):
            fits = int(np.searchsorted(offsets, offsets[at] + self.frame_ids - self.n_held, side="right")) - 1
            if fits > at:  # whole documents up to the frame's end
                self._hold(flat[offsets[at] : offsets[fits]])
                at = fits
            elif self.n_held:
                self._frame()
            else:  # longer than a frame
                for i in range(int(offsets[at]), int(offsets[at + 1]), self.frame_ids):
                    self._hold(flat[i : min(i + self.frame_ids, int(offsets[at + 1]))])
                at += 1

    def _hold(self, part: np.ndarray) -> None:
        self.held.append(part)
        self.n_held += len(part)
        if self.n_held >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        import xxhash

        raw = np.concatenate(self.held).astype(self.dtype).tobytes()
        packed = self.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.n_bytes += len(packed)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._frame()
        index = self.compress(np.concatenate([*self.docs, np.zeros((0, 2), "<i8")]).tobytes())
        body = struct.pack("<4sIQ", b"PWDX", self.dtype.itemsize, self.n_docs) + index
        table = b"".join([struct.pack("<III", *x) for x in self.seek]) + struct.pack("<IBI", len(self.seek), 0x80, _SEEK_END)
        tail = struct.pack("<II", _INDEX_MAGIC, len(body)) + body + struct.pack("<II", _SEEK_MAGIC, len(table)) + table
        self.out.write(tail)
        self.n_bytes += len(tail)
        self.out.close()
        self.fs.move(self.part, self.path)  # a whole file or none: a task that ran twice leaves one


class FrameReader:
    """Reads ids of chosen documents of one file, decompressing only the frames that hold them."""

    def __init__(self, path: str) -> None:
        import zstandard

        files, name = _open(path)
        self.file = files.open_input_file(name)
        self.decompress = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEK_END:
            raise ValueError(f"{path} has no seek table")
        length = 12 * n + 9
        self.seek = np.frombuffer(self._at(size - length, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.frame_at = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        start = int(self.frame_at[-1])
        magic, length = struct.unpack("<II", self._at(start, 8))
        body = self._at(start + 8, length)
        tag, self.width, n_docs = struct.unpack("<4sIQ", body[:16])
        if magic != _INDEX_MAGIC or tag != b"PWDX":
            raise ValueError(f"{path} has no document index")
        self.docs = np.frombuffer(self.decompress(body[16:]) if n_docs else b"", "<i8").reshape(-1, 2)
        self.doc_at = np.concatenate([[0], np.cumsum(self.docs[:, 1])])
        self.ids_at = np.concatenate([[0], np.cumsum(self.seek[:, 1] // self.width)])
        self.have, self.loaded = -1, None

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        raw = self.decompress(self._at(int(self.frame_at[k]), int(self.seek[k, 0])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file; the last frame read is kept for the next call."""
        parts, k = [], int(np.searchsorted(self.ids_at, a, side="right")) - 1
        while a < b:
            if self.have != k:
                self.have, self.loaded = k, self.frame(k)
            end = min(b, int(self.ids_at[k + 1]))
            parts.append(self.loaded[a - int(self.ids_at[k]) : end - int(self.ids_at[k])])
            a, k = end, k + 1
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, f"<u{self.width}")])

    def runs(self, places: np.ndarray | None = None, ids: int = 1 << 17, docs: int = 4096) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents p to q and their ids one after another, for ascending `places` (all if None), in runs of bounded size or one document."""
        places = np.arange(len(self.docs)) if places is None else places
        cuts = [0, *(np.flatnonzero(np.diff(places) != 1) + 1).tolist(), len(places)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            p, stop = (int(places[i]), int(places[j - 1]) + 1) if i < j else (0, 0)
            while p < stop:
                fits = int(np.searchsorted(self.doc_at, self.doc_at[p] + ids, side="right")) - 1
                q = min(stop, p + docs, max(p + 1, fits))
                yield p, q, self.span(int(self.doc_at[p]), int(self.doc_at[q]))
                p = q

    def read(self, places: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """Document id, number of ids before it in the file, and ids, for the documents at `places` (all if None)."""
        for p, q, flat in self.runs(places):
            for i in range(p, q):
                a, b = int(self.doc_at[i] - self.doc_at[p]), int(self.doc_at[i + 1] - self.doc_at[p])
                yield int(self.docs[i, 0]), int(self.doc_at[i]), flat[a:b]


def write_frames(documents: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = 1 << 17, files: int | None = None) -> DataFrame:
    """Encodes every whole text and writes the ids, in ascending id order over all files, to `path` (a folder URI).

    Each document's ids are its text's and then `end_id`; a null text is empty. Rows without an id are left
    out: they have no place in the order. Repeated ids are written one after another. One range shuffle of
    (id, text); each partition writes one file under a temporary name and renames it, so a task that is run
    again does no harm. Without a number of `files` there are as many as shuffle partitions, or more where a file
    would hold over FILE_BYTES of text. An empty table gives no file and an empty manifest; other columns may have any names and are
    ignored. Returns the manifest: a row for each file, in a table.
    """
    spark = documents.sparkSession
    folder = path or new_path(spark, "frames")

    def write(it) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, out, where, first = encoder(tokenizer), None, "", None
        for ids, texts in batches(it, ["doc_id", "text"]):
            ids = ids.to_numpy()
            for block in blocks(texts):
                flat, offsets = enc.block(block, end_id)
                if not len(block.rows):
                    continue
                if out is None:
                    first = int(ids[block.rows[0]])
                    where = f"{folder}/ids-{TaskContext.get().partitionId():06d}.zst"
                    out = FrameWriter(where, enc.dtype, frame_ids)
                out.add_block(ids[block.rows], flat, offsets)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": where, "first_doc": first, "n_docs": out.n_docs, "n_ids": out.n_ids, "n_frames": len(out.seek), "n_bytes": out.n_bytes}])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(partitions(spark), -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(write, _MANIFEST), "manifest")


def read_frames(manifest: DataFrame, id_col: str = "doc_id", wanted: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """One row a document of the files in a manifest: id_col, start (ids of all documents before it), n_tokens, ids_crc32.

    `wanted`, a table with id_col, restricts it to some documents: only files and frames that hold them are
    read; ids that no file holds, and null ids, give no row. A document with an empty text has its end id; an empty
    manifest gives no rows. The files' starts come from a running sum over the manifest, a row a file.
    """
    spark = manifest.sparkSession
    names = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    tasks = max(partitions(spark), manifest.count())
    starts = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("first_doc", "path")) - F.col("n_ids"))
    if wanted is None:
        plan = starts.select("path", "base", F.lit(None).cast("long").alias("only")).repartition(tasks, "path")
    else:
        firsts = np.array([r.first_doc for r in manifest.select("first_doc").orderBy("first_doc").collect()], np.int64)  # 8 bytes a file

        def where(it) -> Iterator[pa.RecordBatch]:
            for (ids,) in batches(it, ["doc_id"]):
                at = np.searchsorted(firsts, ids.to_numpy(), side="right") - 1
                inside = at >= 0  # an id lies in one file: files are ranges of ids
                yield pa.RecordBatch.from_arrays([pa.array(ids.to_numpy()[inside]), pa.array(firsts[at[inside]])], names=["only", "first_doc"])

        ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        plan = ids.mapInArrow(where, "only long, first_doc long").join(starts, "first_doc").select("path", "base", "only")
        plan = plan.repartition(tasks, "path").sortWithinPartitions("path", "only")

    def read(it) -> Iterator[pa.RecordBatch]:
        reader, have = None, None
        for b in it:
            paths, bases = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "base"))
            only = b.column(b.schema.get_field_index("only"))
            cuts = [0, *[i for i in range(1, len(paths)) if paths[i] != paths[i - 1]], len(paths)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if have != paths[i]:
                    reader, have = FrameReader(paths[i]), paths[i]
                chosen = only.slice(i, j - i)
                places = None if chosen.null_count else np.flatnonzero(np.isin(reader.docs[:, 0], chosen.to_numpy()))
                for p, q, flat in reader.runs(places):
                    yield _rows(reader.docs[p:q, 0], bases[i], reader.doc_at[p : q + 1], flat, with_ids)

    return plan.mapInArrow(read, names).withColumnRenamed("doc_id", id_col)


def _rows(docs: np.ndarray, base: int, at: np.ndarray, flat: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    """Rows of documents whose ids stand one after another in `flat`; `at` are their places in the file, the last one's end included."""
    within = at - at[0]
    raw = memoryview(flat.astype("<u4").tobytes())
    ends = (within * 4).tolist()
    sums = [zlib.crc32(raw[i:j]) for i, j in zip(ends[:-1], ends[1:])]
    columns = [pa.array(docs, pa.int64()), pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(within, pa.int32()), pa.array(flat.astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
