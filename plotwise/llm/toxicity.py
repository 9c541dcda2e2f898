"""Toxicity by a gap-weighted subsequence kernel on words, Nyström landmarks and a linear SVM learnt from bags.

Two words are alike by the ordered triples of characters they share, near or with gaps: a triple that
spans s characters weighs DECAY**s, up to SPAN. So an insult with inserted, dotted or spaced-out letters
still shares most triples with the plain one. Words are compared with m landmark words; in the Nyström
space of those comparisons a linear SVM separates insults from other words. Labels are given for whole
documents, not for words: a sentence or document is a bag of words, positive if any of its words is
(mi-SVM): rounds of fitting alternate with picking the words that make the positive bags positive.

Because the triples are an explicit map, the fitted machine folds into one weight per triple, so scoring a
word is a few dozen look-ups. A document's score is a logistic of the margins of its two highest words and of
how many of its words are on the insults' side, and how far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import PLAIN_TABLE, U64, Block, batches, blocks, distinct, give_back, mix, words

SPAN, DECAY = 6, 0.7
_CLASSES = 64
_WIDTH = 32
#: Characters beyond ASCII that have a class of their own; all others share one.
_LETTERS = "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
_GAPS = [(a, s) for s in range(2, SPAN) for a in range(1, s)]


def _class_table() -> dict[int, int]:
    table = {ord(c): 2 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    table |= {ord(c): 28 for c in "0123456789"}
    table |= {ord(c): 29 + i for i, c in enumerate(_LETTERS)}
    return table


_CLASS = np.full(1 << 16, _CLASSES - 1, np.uint8)
for _k, _v in _class_table().items():
    _CLASS[_k] = _v


def coded(texts: list[str]) -> np.ndarray:
    """Words as rows of character classes: 1 marks the start, 0 fills up. Words are lower case and at most _WIDTH - 1 long."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), _WIDTH), np.uint8)
    if len(texts):
        out[:, 0] = 1
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(texts)), lengths)
        col = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        out[row, col] = _CLASS[np.minimum(points, 0xFFFF)]
    return out


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Triple numbers of every start in every word (-1 beyond the end), and their weight, gap pattern by gap pattern."""
    wide = codes.astype(np.int32)
    for a, s in _GAPS:
        third = wide[:, s:]
        yield np.where(third > 0, (wide[:, :-s] * _CLASSES + wide[:, a : a + third.shape[1]]) * _CLASSES + third, -1), DECAY**s


def weighed(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of a word's triples over the word's own length in the kernel's space."""
    total, norm = np.zeros(len(codes), np.float32), np.full(len(codes), 1e-9, np.float32)
    for numbers, w in triples(codes):
        inside = numbers >= 0
        total += w * (weight[numbers] * inside).sum(1, dtype=np.float32)
        norm += w * w * inside.sum(1)
    return total / np.sqrt(norm)


@dataclass
class Model:
    """One weight per triple, the SVM's offset, and the logistic over (1, highest word, second, log of 1 + words above 0)."""

    weight: np.ndarray
    offset: float
    logistic: tuple[float, float, float, float] = (0.0, 4.0, 0.0, 0.0)

    def words(self, texts: list[str]) -> np.ndarray:
        """The machine's value for each word: positive for insults."""
        if not texts:
            return np.zeros(0, np.float32)
        length = np.array([len(t) for t in texts])
        order = np.argsort(length, kind="stable")
        out = np.empty(len(texts), np.float32)
        for lo in range(0, len(order), 20_000):
            part = order[lo : lo + 20_000]
            codes = coded([texts[i] for i in part])[:, : max(int(length[part[-1]]) + 1, SPAN + 1)]
            out[part] = weighed(codes, self.weight) + self.offset
        return out

    def scores(self, seen: np.ndarray) -> np.ndarray:
        """Scores from rows of summed()."""
        return 1 / (1 + np.exp(-np.clip(_design(seen) @ np.array(self.logistic), -30, 30)))


#: What a document without words counts as: far below any word.
NOTHING = -3.0


#: A word counts in full from this margin on.
FULL = 0.5


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the margins of its highest and second-highest word, and its words above 0, each up to FULL by its share of it.

    `values` are the words' margins, document by document, and `first` where each document starts (one entry more).
    A document without a word, or without a second one, has NOTHING there.
    """
    out = np.full((len(first) - 1, 3), NOTHING)
    out[:, 2] = 0
    size = np.diff(first)
    some = np.flatnonzero(size)
    if len(some):
        doc = np.repeat(np.arange(len(size)), size)
        out[some, 0] = np.maximum.reduceat(values, first[some])
        at = np.flatnonzero(values == out[doc, 0])
        rest = np.array(values, np.float64)
        rest[at[np.unique(doc[at], return_index=True)[1]]] = NOTHING
        out[some, 1] = np.maximum.reduceat(rest, first[some])
        out[some, 2] = np.add.reduceat(np.clip(values / FULL, 0, 1), first[some])
    return out


def _design(seen: np.ndarray) -> np.ndarray:
    margins = np.clip(seen[:, :2], NOTHING, -NOTHING)
    return np.concatenate([np.ones((len(seen), 1)), margins, np.log1p(seen[:, 2:])], 1)


def fit_words(positive: list[str], negative: list[str], landmarks: list[str], ridge: float = 1e-5, weights: np.ndarray | None = None) -> Model:
    """A linear SVM (squared hinge, primal Newton steps) in the Nyström space of the landmarks, folded into triple weights."""
    marks = coded(landmarks)
    numbers = [(n, w) for n, w in triples(marks)]
    used = np.unique(np.concatenate([n[n >= 0] for n, _ in numbers]))
    column = np.full(_CLASSES**3 + 1, -1, np.int64)
    column[used] = np.arange(len(used))
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # triples by landmarks; the last row stays 0
    norm = np.full(len(landmarks), 1e-9)
    for n, w in numbers:
        row, _ = np.nonzero(n >= 0)
        np.add.at(dense, (column[n[n >= 0]], row), w)
        norm += w * w * (n >= 0).sum(1)
    dense /= np.sqrt(norm)

    def compare(texts: list[str]) -> np.ndarray:
        out = []
        for lo in range(0, len(texts), 500):
            codes = coded(texts[lo : lo + 500])
            total, size = np.zeros((len(codes), len(landmarks)), np.float32), np.full(len(codes), 1e-9)
            for n, w in triples(codes):
                for j in range(n.shape[1]):
                    if (n[:, j] >= 0).any():
                        total += w * dense[column[n[:, j]]]
                size += w * w * (n >= 0).sum(1)
            out.append(total / np.sqrt(size)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(landmarks)), np.float32)

    gram = compare(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > 1e-3 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm^(-1/2), on the directions that carry anything
    x = np.concatenate([compare(positive), compare(negative)]).astype(np.float64) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    own = np.ones(len(positive)) if weights is None else weights
    c = np.concatenate([0.5 * own / max(1e-9, own.sum()), np.full(len(negative), 0.5 / max(1, len(negative)))])
    beta = np.zeros(x.shape[1])
    for _ in range(20):  # Newton steps over the words inside the margin, some at a time: the driver holds them once
        inside = np.flatnonzero(y * (x @ beta) < 1)
        left, right = ridge * np.eye(len(beta)), np.zeros(len(beta))
        for lo in range(0, len(inside), 1000):
            part = inside[lo : lo + 1000]
            a = x[part] * c[part, None]
            left += a.T @ x[part]
            right += a.T @ y[part]
        new = np.linalg.solve(left, right)
        if np.allclose(new, beta, atol=1e-7):
            break
        beta = new
    alpha = root @ beta[:-1]
    weight = np.zeros(_CLASSES**3 + 1, np.float32)
    weight[used] = dense[:-1] @ alpha.astype(np.float32)
    return Model(weight, float(beta[-1]))


def numbered(bags) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of all bags, and each bag as numbers of them: a word is one string however often it is said."""
    column = bags if isinstance(bags, (pa.Array, pa.ChunkedArray)) else pa.array(bags, pa.list_(pa.string()))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    coded_ = column.flatten().dictionary_encode()
    return coded_.dictionary.to_pylist(), np.split(coded_.indices.to_numpy().astype(np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []


def fit(bags, labels: np.ndarray, calibrate: np.ndarray, n_landmarks: int = 384, rounds: int = 3, least: float = 3.5, clean_weight: float = 1.0, seed: int = 7) -> Model:
    """Learns from bags of words with labels (lists, or an Arrow column of them); bags marked in `calibrate` only set the logistic."""
    rng, floor = np.random.default_rng(seed), -np.inf
    names, rows = numbered(bags)
    learn = ~calibrate
    counts = np.zeros((2, len(names)))
    for row, label, own in zip(rows, labels, learn):
        if own:
            counts[int(label), np.unique(row)] += 1
    n = np.array([max(1, (learn & (labels == k)).sum()) for k in (0, 1)])
    share = counts.sum(0) / n.sum()
    surplus = (counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n[0] + 1 / n[1]))
    clean = np.flatnonzero(counts[0] > 0)
    if not len(clean) or not (surplus > 0).any():
        return Model(np.zeros(_CLASSES**3 + 1, np.float32), -1.0, (-2.0, 0.0, 0.0, 0.0))
    common = clean[np.argsort(-counts[0][clean], kind="stable")[:2000]]
    negative = np.unique(np.concatenate([common, rng.choice(clean, min(6000, len(clean)), replace=False)]))
    # the first guess: what clean bags never hold, by how often toxic ones do; what insults share stands out of it
    fresh = np.flatnonzero((counts[1] > 0) & (counts[0] == 0) & (surplus > 0))
    fresh = fresh[np.argsort(-surplus[fresh], kind="stable")][:2500]
    model, value = None, np.zeros(len(names))
    if len(fresh):
        other = np.setdiff1d(negative, fresh)
        marks = np.concatenate([fresh[: n_landmarks // 2], rng.choice(other, min(n_landmarks // 2, len(other)), replace=False)])
        value = fit_words([names[i] for i in fresh], [names[i] for i in other], [names[i] for i in marks], weights=surplus[fresh] ** 2).words(names)
    for _ in range(rounds):
        # each positive bag names the word that explains it best; a word counts by the bags it explains
        votes = np.zeros(len(names))
        for row, label, own in zip(rows, labels, learn):
            if own and label and len(row):
                merit = surplus[row] + 4 * value[row]
                top = np.argsort(-merit, kind="stable")[:3]  # of all places: a word said again leaves less room for chance finds
                best, at = np.unique(row[top], return_index=True)
                near = merit[top[at]] >= 0.25 * merit[top[0]]
                votes[best[near & (surplus[best] > least) & (value[best] > floor)]] += 1
        chosen = np.flatnonzero(votes)
        if not len(chosen):
            chosen = np.argsort(-surplus, kind="stable")[:5]
            votes[chosen] = 1
        chosen = chosen[np.argsort(-votes[chosen], kind="stable")][:2500]
        other = np.setdiff1d(negative, chosen)
        marks = np.concatenate([chosen[: n_landmarks // 2], rng.choice(other, min(n_landmarks // 2, len(other)), replace=False)])
        model = fit_words([names[i] for i in chosen], [names[i] for i in other], [names[i] for i in marks], weights=np.sqrt(votes[chosen]))
        value = model.words(names)
        hard = clean[np.argsort(-value[clean], kind="stable")[:1500]]
        negative = np.unique(np.concatenate([negative, hard]))
        least, floor = 0.7 * least, 0.0
    seen = summed(value[np.concatenate([*rows, np.zeros(0, np.int64)])].astype(np.float64), np.cumsum([0, *map(len, rows)]))
    model.logistic = _logistic(_design(seen), labels, np.where(calibrate, 4.0, 1.0) * np.where(labels > 0, 1.0, clean_weight))
    return model


#: The least weights of the logistic: either margin always counts, and more insults never lower a score.
_LEAST = np.array([-np.inf, 0.2, 0.1, 0.0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float]:
    """Weighted logistic regression by Newton steps that never raise the loss, weights not below _LEAST."""
    if len(set(y.tolist())) < 2:
        return (0.0, 4.0, 0.0, 0.0)
    ridge = np.array([1e-4, 0.1, 0.1, 0.1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + ridge @ (b * b) / 2)

    b = np.maximum(np.zeros(x.shape[1]), _LEAST)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * b
        free = (b > _LEAST) | (grad < 0)
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.zeros(len(b))
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        now, size = loss(b), 1.0
        while size > 1e-6 and loss(np.maximum(b - size * step, _LEAST)) > now - 1e-4 * size * (grad @ step):
            size /= 2
        if size <= 1e-6 or size * np.abs(step).max() < 1e-7:
            break
        b = np.maximum(b - size * step, _LEAST)
    return tuple(b.tolist())


def bag_words(block: Block) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a block, the word number of every place, and each document's first place.

    Words end at white space; within one, signs are dropped (i.d.i.o.t, id-iot), and runs of words of one
    letter are joined (i d i o t). A longer word than the kernel's width gives overlapping pieces.
    """
    starts, ends, hashes, first = words(block, PLAIN_TABLE)
    mapped = PLAIN_TABLE[block.data]
    doc_starts = first
    # parts of one white-space word, and lone letters in a row, belong together
    short = ends - starts == 1
    white = np.concatenate([[0], np.cumsum(_WHITE[block.data], dtype=np.int64)])
    tight = np.zeros(len(starts), bool)
    if len(starts) > 1:
        same = white[starts[1:]] == white[ends[:-1]]
        tight[1:] = same | (short[1:] & short[:-1])
        tight[doc_starts[:-1][doc_starts[:-1] < len(tight)]] = False
    begin = np.flatnonzero(~tight)
    width = np.diff(np.concatenate([begin, [len(starts)]]))
    joined = np.flatnonzero(width > 1)
    if len(joined):  # a joined word's hash is made of its parts'
        edge = np.concatenate([begin, [len(starts)]])
        own = hashes[begin].copy()
        for i in joined.tolist():
            h = U64(17)
            for x in hashes[edge[i] : edge[i + 1]].tolist():
                h = U64((int(h) * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF)
            own[i] = h
        hashes = mix(own)
    elif len(begin):
        hashes = mix(hashes[begin])
    else:
        hashes = hashes[:0]
    one, number = distinct(hashes)
    data = mapped.tobytes()
    last = ends[np.concatenate([begin[1:], [len(starts)]]) - 1] if len(begin) else ends[:0]
    names = [data[a:b].replace(b"\0", b"").decode("utf-8", "replace").lower() for a, b in zip(starts[begin[one]].tolist(), last[one].tolist())]
    return names, number, np.searchsorted(begin, doc_starts, side="left")


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def pieces(name: str) -> list[str]:
    most = _WIDTH - 1
    if len(name) <= most:
        return [name]
    return [name[i : i + most] for i in range(0, len(name) - most // 2, most // 2 + 1)]


class Scorer:
    """Highest word of documents, with the values of words met before at hand."""

    def __init__(self, model: Model, keep: int = 300_000) -> None:
        self.model, self.keep, self.known = model, keep, {}

    def look(self, block: Block) -> np.ndarray:
        """summed() of each document of a block."""
        names, number, first = bag_words(block)
        known = self.known
        value = list(map(known.get, names))
        new = [i for i, v in enumerate(value) if v is None]
        if new:
            parts = [pieces(names[i]) for i in new]
            flat = self.model.words([p for ps in parts for p in ps]).tolist()
            at = 0
            fresh = {}
            for i, ps in zip(new, parts):
                value[i] = fresh[names[i]] = max(flat[at : at + len(ps)])
                at += len(ps)
            if len(known) + len(fresh) > self.keep:
                self.known = known = {}
            known.update(fresh)
        return summed(np.array(value, np.float64)[number] if len(number) else np.zeros(0), first)


_BAG = "doc_id long, toxic int, words array<string>"


def learnt_from(labels: DataFrame, id_col: str) -> DataFrame:
    """The rows of labels that training may see: the crc32 of the id as text is not a multiple of 5."""
    return labels.where(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 0)


def training_bags(documents: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str, most_words: int = 4000) -> list:
    """Words of at most `sample` labelled documents of each class, first by a hash of the id.

    Labels are learnt only from rows whose crc32 of the id as text is not a multiple of 5; an id whose label rows
    disagree is not learnt from, and equal bags are one, labelled as most of them. A sampled document of more than `most_words` words gives so many of them, spread over it, so the driver's share is bounded: the fit reads part of
    such texts, scores read all of every text.
    """
    known = learnt_from(labels, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def bag(it) -> Iterator[pa.RecordBatch]:
        for ids, toxic, texts in batches(it, ["doc_id", "toxic", "text"]):
            rows = []
            for block in blocks(texts):
                names, number, first = bag_words(block)
                for d in range(len(block.rows)):
                    own = number[first[d] : first[d + 1]]
                    if len(own) > most_words:
                        own = own[np.argsort(mix(np.arange(len(own), dtype=U64)), kind="stable")[:most_words]]
                    rows.append([p for i in own for p in pieces(names[i])])
            yield pa.RecordBatch.from_arrays([ids, toxic, pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    return base.join(F.broadcast(chosen), "doc_id").mapInArrow(bag, _BAG).groupBy("words").agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")).toArrow()


def train(documents: DataFrame, labels: DataFrame, sample: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the machine on the driver from at most `sample` labelled documents of each class; a fifth of them sets the logistic."""
    table = training_bags(documents, labels, sample, id_col, text_col, label_col).sort_by("doc_id")
    ids, toxic = table.column("doc_id").to_numpy(), table.column("toxic").to_numpy().astype(np.int64)
    calibrate = mix(ids.astype(np.int64).view(U64)) % U64(5) == 0
    shares = {r["k"]: r["count"] for r in learnt_from(labels, id_col).where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("int").alias("k")).count().collect()}
    weight = (shares.get(0, 1) / max(1, shares.get(1, 1))) / (max(1, (toxic == 0).sum()) / max(1, (toxic > 0).sum()))
    model = fit(table.column("words"), toxic, calibrate, clean_weight=max(1.0, weight) ** 0.5)
    del table
    give_back()
    return model


def score_toxicity(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out (crc32 of the id as text is a multiple of 5), score and predicted (score >= 0.5) of every whole text.

    Only the text is scored. A null or empty text has no words and gets the score of a value well below any
    word's; null ids have a null held_out; repeated rows are scored alike; other columns are ignored. One
    pass, no shuffle; the broadcast model is one megabyte.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(it) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for ids, texts in batches(it, ["doc_id", "text"]):
            seen = np.concatenate([scorer.look(b) for b in blocks(texts)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(held.value.scores(seen))], names=["doc_id", "score"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return rows.select(F.col("doc_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Documents whose score is below the threshold, in the columns they came with; null and empty texts stay."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def keep(it) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in it:
            if b.num_rows:
                seen = np.concatenate([scorer.look(x) for x in blocks(b.column(b.schema.get_field_index(text_col)))])
                yield b.filter(pa.array(held.value.scores(seen) < threshold))
        give_back()

    return documents.mapInArrow(keep, documents.schema)
