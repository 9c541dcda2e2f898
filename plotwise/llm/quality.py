"""Quality by co-training: a text view and a metadata view teach each other, then vote with calibrated odds.

Each view alone should tell good documents from bad ones. Both start from the labelled sample; in every
round each view labels the documents that it is surest of, out of all documents of the table, and the *other*
view learns from them: a growing share every round, by one Newton step whose sums Spark adds up. At the end
each view's odds are calibrated on labelled documents that took no part, and a logistic over the two decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import remove, written
from .textkit import WHITE_TABLE, U64, Block, batches, blocks, mix, run_hashes, words

HASHED = 256
_KINDS = 8
_BYTE_KIND = np.full(256, 7, np.int64)  # 7: beyond ASCII
_BYTE_KIND[:128] = 5  # other signs
_BYTE_KIND[[32, *range(9, 14)]] = 0
_BYTE_KIND[97:123] = 1
_BYTE_KIND[65:91] = 2
_BYTE_KIND[48:58] = 3
_BYTE_KIND[[ord(c) for c in ".,;:'\"!?()-"]] = 4
_BYTE_KIND[[ord(c) for c in "#$%&*@^_=+<>|~{}[]\\/"]] = 6
TEXT_SIZE = HASHED + _KINDS + 7
META_SOURCES, META_LANGS = 64, 16
META_SIZE = META_SOURCES + META_LANGS + 6


def text_view(block: Block) -> np.ndarray:
    """One row of numbers a document from its words and characters alone."""
    n = len(block.rows)
    out = np.zeros((n, TEXT_SIZE), np.float32)
    size = np.diff(block.offsets)
    doc_of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc_of_byte * _KINDS + _BYTE_KIND[block.data], minlength=n * _KINDS).reshape(n, _KINDS)
    out[:, HASHED : HASHED + _KINDS] = kinds / np.maximum(size, 1)[:, None]
    starts, ends, hashes, first = words(block, WHITE_TABLE)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    bins = np.bincount(doc * HASHED + (hashes >> U64(56)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED).astype(np.float32)
    bins = np.sqrt(bins)
    out[:, :HASHED] = bins / np.maximum(np.linalg.norm(bins, axis=1, keepdims=True), 1e-9)
    more = out[:, HASHED + _KINDS :]
    some = np.maximum(count, 1)
    more[:, 0] = np.bincount(doc, ends - starts, n) / some / 10
    pair = np.unique(doc.astype(U64) << U64(40) | hashes >> U64(24))
    more[:, 1] = np.bincount((pair >> U64(40)).astype(np.int64), minlength=n) / some  # share of distinct words
    lines = np.bincount(doc_of_byte, block.data == 10, n) + 1
    more[:, 2] = np.log1p(count / lines)
    more[:, 3] = np.log1p(lines) / 5
    more[:, 4] = np.log1p(count) / 8
    if len(hashes) > 4:  # runs of four words said again within the document
        at = np.flatnonzero(np.arange(len(hashes)) + 4 <= first[1:][doc])
        four = run_hashes(hashes, at, at + 4)
        pair = np.unique(doc[at].astype(U64) << U64(40) | four >> U64(24))
        more[:, 5] = 1 - np.bincount((pair >> U64(40)).astype(np.int64), minlength=n) / np.maximum(np.bincount(doc[at], minlength=n), 1)
    more[:, 6] = (more[:, 1] < 0.3).astype(np.float32)
    return out


def meta_view(sources: list, langs: list, n_chars: np.ndarray) -> np.ndarray:
    """One row of numbers a document from its source, language and declared length alone; null is a value of its own."""
    out = np.zeros((len(sources), META_SIZE), np.float32)
    rows = np.arange(len(sources))
    for column, size, base in ((sources, META_SOURCES, 0), (langs, META_LANGS, META_SOURCES)):
        known = {v: int(mix(np.array([hash_text(v)], U64))[0] % U64(size)) for v in set(column)}
        out[rows, base + np.array([known[v] for v in column], np.int64)] = 1
    log = np.log1p(np.maximum(np.nan_to_num(n_chars, nan=0.0), 0))
    out[:, -6] = np.isnan(n_chars)
    for k, edge in enumerate((4.5, 5.5, 6.5, 7.5, 9.0)):
        out[:, -5 + k] = np.maximum(log - edge, 0)
    return out


def hash_text(value) -> int:
    h = 1469598103934665603
    for b in ("" if value is None else "=" + str(value)).encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of an L2-penalised logistic regression (the last is the constant), by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    b, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-4:
            break
    return b


def odds(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ b[:-1] + b[-1]


@dataclass
class Model:
    """Weights of either view, and of the logistic over their two odds."""

    text: np.ndarray
    meta: np.ndarray
    vote: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = np.stack([odds(text, self.text), odds(meta, self.meta)], 1)
        return 1 / (1 + np.exp(-np.clip(odds(both, self.vote), -30, 30)))


#: Odds are counted in bins of 1/40 from -25 to 25, so that the surest share of any number of documents is found by counts.
_BINS, _PER_ODD = 2000, 40
#: All pseudo-labelled documents together weigh so much of the labelled ones, however many there are.
PSEUDO = 0.5


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip((z + _BINS / _PER_ODD / 2) * _PER_ODD, 0, _BINS - 1).astype(np.int64)


def odds_counts(views: tuple, fitted: list) -> np.ndarray:
    """How many documents have odds in each bin, view by view."""
    return np.stack([np.bincount(_bin(odds(x, b)), minlength=_BINS) for x, b in zip(views, fitted)])


def taught_sums(views: tuple, fitted: list, cuts: list) -> list[tuple[int, np.ndarray]]:
    """For each view: how many documents the other one is sure of, and the Newton sums over them, the gradient as last column.

    `cuts` are the bins up to and from which a view is sure; odds within 1 of even are never sure.
    """
    z, out = [odds(x, b) for x, b in zip(views, fitted)], []
    for v in range(2):
        said, (low, high) = z[1 - v], cuts[1 - v]
        good = (_bin(said) >= high) & (said > 1)
        own = np.flatnonzero(good | (_bin(said) <= low) & (said < -1))
        out.append((len(own), _newton(views[v][own], good[own].astype(np.float64), np.ones(len(own)), fitted[v])))
    return out


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negative Hessian of the log likelihood at b, and its gradient as one more column."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
    return np.concatenate([(z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z, (z.T @ (weight * (y - p)))[:, None]], 1)


class ArrayPool:
    """Unlabelled documents at hand as two arrays."""

    def __init__(self, text: np.ndarray, meta: np.ndarray) -> None:
        self.views = (text, meta)

    def counts(self, fitted: list) -> np.ndarray:
        return odds_counts(self.views, fitted)

    def sums(self, fitted: list, cuts: list) -> list[tuple[int, np.ndarray]]:
        return taught_sums(self.views, fitted, cuts)


class TablePool:
    """All documents of a table of views, but for the labelled sample: every task adds up its own rows, Spark the tasks' sums."""

    def __init__(self, views: DataFrame, sample: np.ndarray) -> None:
        self.views, self.sample = views, np.sort(sample)

    def _arrays(self, it) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for ids, text, meta in batches(it, ["doc_id", "text_view", "meta_view"]):
            known = np.isin(ids.fill_null(0).to_numpy(), self.sample) & np.asarray(ids.is_valid())
            pair = _unpacked(text, TEXT_SIZE), _unpacked(meta, META_SIZE)
            yield pair[0][~known], pair[1][~known]

    def counts(self, fitted: list) -> np.ndarray:
        arrays = self._arrays

        def count(it) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, _BINS), np.int64)
            for pair in arrays(it):
                total += odds_counts(pair, fitted)
            view, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(view * _BINS + place), pa.array(total[view, place])], names=["at", "n"])

        rows = _without_frame(self, count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # 4,000 rows at most
        out = np.zeros(2 * _BINS, np.int64)
        out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        return out.reshape(2, _BINS)

    def sums(self, fitted: list, cuts: list) -> list[tuple[int, np.ndarray]]:
        arrays = self._arrays

        def add(it) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = [[0, 0.0], [0, 0.0]]
            for pair in arrays(it):
                for t, (n, m) in zip(total, taught_sums(pair, fitted, cuts)):
                    t[0], t[1] = t[0] + n, t[1] + m
            rows = [{"part": TaskContext.get().partitionId(), "v": v, "i": i, "n": n, "sums": line.tobytes()} for v, (n, m) in enumerate(total) if n for i, line in enumerate(m)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("v", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())]))

        def total(key, table):
            table = table.sort_by("part")  # the same order of addition every time
            lines = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.float64).reshape(table.num_rows, -1)
            first, v, i = (k.as_py() for k in key)
            return pa.table({"part": [first], "v": [v], "i": [i], "n": [sum(table.column("n").to_pylist())], "sums": [lines.sum(0).tobytes()]}, schema=pa.schema([("part", pa.int32()), ("v", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())]))

        # one line of the sums a group, a few kilobytes a task each, added up over stretches of 512 tasks and then of 512 of these;
        # the driver gets the lines of two matrices, one for each quarter million tasks
        rows, shape = _without_frame(self, add, "part int, v int, i int, n long, sums binary"), "part int, v int, i int, n long, sums binary"
        for _ in range(2):
            rows = rows.groupBy(F.shiftright("part", 9).alias("stretch"), "v", "i").applyInArrow(total, shape)
        rows = rows.collect()
        out = []
        for v in range(2):
            size, n = len(fitted[v]), 0
            lines = np.zeros((size, size + 1))
            for r in sorted((r for r in rows if r.v == v), key=lambda r: (r.part, r.i)):
                n += r.n * (r.i == 0)
                lines[r.i] += np.frombuffer(bytes(r.sums), np.float64)
            out.append((n, lines))
        return out


def _without_frame(pool: TablePool, f, schema: str) -> DataFrame:
    """pool.views through f; the pool that goes to the tasks carries no table."""
    views, pool.views = pool.views, None
    try:
        return views.mapInArrow(f, schema)
    finally:
        pool.views = views


def _sure(counts: np.ndarray, wanted: float, share: float) -> tuple[int, int]:
    """The bins up to and from which the surest `wanted` documents lie, bad and good ones by their share."""
    upto, downto = np.cumsum(counts), np.cumsum(counts[::-1])
    low = int(np.searchsorted(upto, max(1.0, wanted * (1 - share))))
    high = int(np.searchsorted(downto, max(1.0, wanted * share)))
    return min(low, _BINS - 1), _BINS - 1 - min(high, _BINS - 1)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, calibrate: np.ndarray, pool=None, rounds: int = 4, sure: float = 0.1) -> Model:
    """Learns from rows with label 0 or 1 and a pool (rows with label -1 if none is given); each view labels `sure` more of the pool every round."""
    learn = (label >= 0) & ~calibrate
    share = label[learn].mean() if learn.any() else 0.5
    if not learn.any() or len(set(label[learn].tolist())) < 2:
        constant = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Model(np.zeros(text.shape[1] + 1), np.zeros(meta.shape[1] + 1), np.array([0.0, 0.0, constant]))
    views, y = (text[learn], meta[learn]), label[learn].astype(np.float64)
    pool = pool or ArrayPool(text[label < 0], meta[label < 0])
    fitted = [logistic(x, y, np.ones(len(y))) for x in views]
    for k in range(1, rounds + 1):
        counts = pool.counts(fitted)
        cuts = [_sure(c, k * sure * c.sum(), share) for c in counts]
        if not counts.sum():
            break
        sums = pool.sums(fitted, cuts)
        for v, (n, taught) in enumerate(sums):
            own = _newton(views[v], y, np.ones(len(y)), fitted[v])
            both = own + (PSEUDO * len(y) / n) * taught if n else own
            penalty = np.append(np.ones(len(fitted[v]) - 1), 1e-6)
            step = np.linalg.solve(both[:, :-1] + np.diag(penalty), both[:, -1] - penalty * fitted[v])
            fitted[v] = fitted[v] + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    both = np.stack([odds(text, fitted[0]), odds(meta, fitted[1])], 1)
    own = np.flatnonzero(calibrate & (label >= 0))
    if len(set(label[own].tolist())) < 2:
        own = np.flatnonzero(label >= 0)
    return Model(fitted[0], fitted[1], calibrated_vote(both[own], label[own].astype(np.float64)))


def calibrated_vote(both: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two views' odds and a constant. Each view's odds are calibrated by a logistic of their own, then weighed
    by another; a view that either would turn round (a slope of 0 or less) has weight 0."""
    one = np.ones(len(y))
    alone = [logistic(both[:, [v]], y, one, ridge=0.05) for v in range(2)]
    said = np.stack([both[:, v] * alone[v][0] + alone[v][1] for v in range(2)], 1)
    use = [v for v in range(2) if alone[v][0] > 0]
    while use:
        w = logistic(said[:, use], y, one, ridge=0.05)
        if (w[:-1] > 0).all():
            break
        use = [v for v, x in zip(use, w) if x > 0]
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.array([0.0, 0.0, float(np.log(share / (1 - share)))])
    out = np.zeros(3)
    out[2] = w[-1]
    for v, x in zip(use, w):
        out[v], out[2] = x * alone[v][0], out[2] + x * alone[v][1]
    return out


_ROW = "doc_id long, text_view binary, meta_view binary"
_INPUT = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    have = set(documents.columns)
    return documents.select(*[(F.col(f"`{names.get(c, c)}`") if names.get(c, c) in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _views(texts, langs, sources, n_chars) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    langs, sources = langs.to_pylist(), sources.to_pylist()
    sizes = np.array(n_chars.to_pylist(), np.float64)  # null becomes nan
    for block in blocks(texts):
        r = block.rows
        yield r, text_view(block), meta_view(sources[r[0] : r[-1] + 1], langs[r[0] : r[-1] + 1], sizes[r])


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of numbers as binaries of 16-bit floats."""
    width = 2 * x.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.astype(np.float16).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, size).astype(np.float32)


def train(documents: DataFrame, labels: DataFrame, sample: int = 3000, label_col: str = "quality", **names: str) -> Model:
    """Fits from at most `sample` labelled documents, first by a hash of the id, and all other documents as the pool.

    Labels are learnt only from rows whose crc32 of the id as text is not a multiple of 5; an id whose label rows
    disagree is not learnt from; of an id with several rows the one whose views have the smallest hash is, in whatever order they
    come; a quarter of the sample is kept for calibration. The views of all documents are
    written once (some 700 bytes a document) and read twice a round for sums; the driver gets those, and a
    fixed number of numbers for each sampled document. Without labels of both kinds the score is constant.
    """
    spark = documents.sparkSession
    id_col = names.get("doc_id", "doc_id")
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
    known = labels.where(fold != 0).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")

    def view(it) -> Iterator[pa.RecordBatch]:
        for ids, *rest in batches(it, _INPUT):
            for r, text, meta in _views(*rest):
                yield pa.RecordBatch.from_arrays([ids.slice(r[0], len(r)), _packed(text), _packed(meta)], names=["doc_id", "text_view", "meta_view"])

    views = written(_columns(documents, names).mapInArrow(view, _ROW), "views")
    seen = views.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text_view", "meta_view").alias("h"), "text_view", "meta_view")).alias("v"))
    table = seen.select("doc_id", "label", "v.text_view", "v.meta_view").toArrow().sort_by("doc_id")
    text, meta = _unpacked(table.column("text_view"), TEXT_SIZE), _unpacked(table.column("meta_view"), META_SIZE)
    label, ids = table.column("label").to_numpy().astype(np.int64), table.column("doc_id").to_numpy().astype(np.int64)
    calibrate = mix(ids.view(U64)) % U64(4) == 0
    model = co_train(text, meta, label, calibrate, TablePool(views, ids))
    remove(spark, views.plotwise_path)
    return model


def score_quality(documents: DataFrame, model: Model, **names: str) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text is a multiple of 5), score (0 to 1, higher is better) and keep (score >= 0.5).

    The text view reads the whole text, the metadata view source, lang and n_chars; a missing or null one
    counts as a value of its own, a null or empty text as no words. Repeated rows are scored alike; other
    columns are ignored; an empty table gives no rows. One pass, no shuffle; the broadcast model is a few kilobytes.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(it) -> Iterator[pa.RecordBatch]:
        for ids, *rest in batches(it, _INPUT):
            for r, text, meta in _views(*rest):
                yield pa.RecordBatch.from_arrays([ids.slice(r[0], len(r)), pa.array(held.value.scores(text, meta))], names=["doc_id", "score"])

    rows = _columns(documents, names).mapInArrow(score, "doc_id long, score double")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).alias("keep"))
