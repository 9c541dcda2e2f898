"""N-gram Jaccard self-join of whole texts, exact, with set-relation skipping.

A set is the distinct word n-grams of a text, as 64-bit hashes. Two relations between sets save most work:

Among index lists. Sets are ordered by hash, with n-grams that are known to be common put last, and only a
prefix is indexed: sets alike enough share an n-gram there. A list is sorted by set size and, within a size, by
the n-gram's place in the set: such a block of one size is skipped whole if its size or the probing set's own
place rules it out, and left at the first place that does. Pairs that stand in a bound's way are never made.

Among answers. Sets that are equal share one answer: only the smallest document of a class is indexed. In
long lists, which near copies make, each set is first compared with one leader for each band of sizes. Then the
answers of a leader's followers are derived from the leader's own: if a leader shares c n-grams with another
set, a follower that has e n-grams beyond the leader shares at most c + e. So leaders (and sets that follow
none) are compared first, and only the followers of those that this leaves open are compared themselves, in
blocks of bounded size. What is in one class already needs no answer at all.

What is left is verified on the texts themselves; classes are components of verified links.

Joins by documents are merges: their sides grow with the table, and one that is broadcast goes through the driver first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import key_filter, lent, packed, partitions, passes, place, remove, written
from .components import components
from .textkit import WHITE_TABLE, U64, Block, batches, blocks, fold64, give_back, mix, windows, words

#: An index list of at most so many sets is paired at once; a longer one goes by leaders.
LIGHT = 64
#: An n-gram in the front of so many sets counts as common, and is put last. At most COMMON_MOST are (4 MB):
#: the order alone depends on them, results do not.
COMMON, COMMON_MOST = 32, 1 << 19
#: Rows of a list compared with one another in one task.
TILE = 2048
#: Counts in a set's histogram: sets of some hundred n-grams that are not alike then seldom pass its bound.
_BINS = 512


class Rule:
    """Word n-grams, the threshold as a whole percentage, and how long a list is paired at once."""

    def __init__(self, n: int, percent: int, light: int = LIGHT) -> None:
        self.n, self.percent, self.light = n, percent, light

    def sets(self, block: Block) -> list[np.ndarray]:
        """Sorted distinct n-gram hashes of each document; with fewer words the whole sequence is one, without words none is."""
        _, _, hashes, first = words(block, WHITE_TABLE)
        every = windows(hashes, self.n)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(np.unique(every[a : b - self.n + 1]) if b - a >= self.n else windows(hashes[a:b], b - a) if b > a else hashes[:0])
        return out

    def front(self, size):
        """Entries of the prefix: sets that link share one of them."""
        return size - -(-self.percent * size // 100) + 1

    def overlap(self, a, b):
        """The least intersection of sets of these sizes that link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return len(a) > 0 and len(b) > 0 and 100 * both >= self.percent * (len(a) + len(b) - both)

    def reach(self, size, other):
        """The last place at which the first n-gram that a set shares with one of the other size can stand: enough must follow it in either."""
        return size - self.overlap(size, other)

    def band(self, size):
        """Sets of one band are within the threshold by size; sets two bands apart are not."""
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(100 / self.percent)) + F.lit(1e-9)).cast("int")


def _histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s & U64(_BINS - 1)).astype(np.int64), minlength=_BINS), 255).astype(np.uint8).tobytes()


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference: counts that differ, bin by bin (kept to 255, which only lowers it)."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(-1, dtype=np.int32)


def _near(rule: Rule, size_a, hist_a, size_b, hist_b) -> np.ndarray:
    return _gap(hist_a, hist_b) <= size_a + size_b - 2 * rule.overlap(size_a, size_b)


def _hists(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _BINS)


def describe_sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, size, d1, d2 (digests of the set) and hist of every row."""

    def describe(it) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, ["doc_id", "text"]):
            for block in blocks(texts):
                sets = rule.sets(block)
                one = np.array([s.sum(dtype=U64) if len(s) else 0 for s in sets], U64)
                two = np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) if len(s) else 0 for s in sets], U64)
                yield pa.RecordBatch.from_arrays([ids.slice(int(block.rows[0]), len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fold64(mix(one))), pa.array(fold64(mix(two))), pa.array([_histogram(s) for s in sets], pa.binary())], names=["doc_id", "size", "d1", "d2", "hist"])

    return rows.mapInArrow(describe, "doc_id long, size long, d1 long, d2 long, hist binary")


def common_grams(rows: DataFrame, rule: Rule, n_buckets: int) -> np.ndarray:
    """Hashes of n-grams in the front of many sets, most frequent first kept, at most COMMON_MOST of them, sorted."""

    def send(it) -> Iterator[pa.RecordBatch]:
        for (texts,) in batches(it, ["text"]):
            held = [s[: rule.front(len(s)) * 13 // 10 + 2] for block in blocks(texts) for s in rule.sets(block)]
            grams, counts = np.unique(np.concatenate([*held, np.zeros(0, U64)]), return_counts=True)
            bucket = (grams % U64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            part = [order[edges[k] : edges[k + 1]] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([grams[x].tobytes() for x in part], pa.binary()), pa.array([np.minimum(counts[x], 65535).astype("<u2").tobytes() for x in part], pa.binary())], names=["bucket", "grams", "counts"])

    def add(it) -> Iterator[pa.RecordBatch]:
        for _, (grams, counts) in _numbered(it, {"grams": U64, "counts": np.dtype("<u2")}):
            order = np.argsort(grams, kind="stable")
            grams, counts = grams[order], counts[order].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            total = np.add.reduceat(counts, at)
            many = total >= COMMON
            yield pa.RecordBatch.from_arrays([pa.array(fold64(grams[at][many])), pa.array(total[many])], names=["gram", "n"])

    sent = dealt(rows.select("text").mapInArrow(send, "bucket int, grams binary, counts binary"))
    found = sent.mapInArrow(add, "gram long, n long").orderBy(F.desc("n"), "gram").limit(COMMON_MOST).select("gram")
    return np.sort(packed(found)["gram"].view(U64))


def index(rows: DataFrame, rule: Rule, common, n_buckets: int) -> DataFrame:
    """Index entries: for each block of documents and bucket one message of packed entries; entries of common n-grams as rows."""
    kinds = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("gram", "doc", "d1", "size", "place")]])

    def send(it) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, number = common.value, TaskContext.get().partitionId() << 22
        for ids, texts in batches(it, ["doc_id", "text"]):
            ids, parts, own, seen = ids.to_numpy(), [[] for _ in range(5)], [], {}
            for block in blocks(texts):
                for row, s in zip(block.rows.tolist(), rule.sets(block)):
                    if len(s):
                        digest = mix(s.sum(dtype=U64, keepdims=True))[0]
                        key = (len(s), int(digest))
                        if key in seen and seen[key] <= ids[row]:
                            continue  # a copy in the same batch of a document that is indexed
                        seen[key] = ids[row]
                        often = np.isin(s, known, assume_unique=True) if len(known) else np.zeros(len(s), bool)
                        front = np.concatenate([s[~often], s[often]])[: rule.front(len(s))]
                        n = len(front)
                        for held, x in zip(parts, (front, np.full(n, ids[row], np.int64), np.full(n, digest), np.full(n, len(s), np.int64), np.arange(n))):
                            held.append(x)
                        own.append(np.arange(n) >= len(s) - np.count_nonzero(often))
            if not own:
                continue
            gram, doc, d1, size, at = (np.concatenate(x) for x in parts)
            often = np.concatenate(own)
            bucket = np.where(often, n_buckets, (gram % U64(n_buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 2))
            some = np.flatnonzero(np.diff(edges))
            # common n-grams' entries are messages of their own, dealt out evenly: their lists are built as rows, not in one task
            cut = [order[i : min(i + 50_000, edges[k + 1])] for k in some for i in range(edges[k], edges[k + 1], 50_000)]
            number += 1
            spread = mix(np.arange(len(cut), dtype=U64) + (U64(number) << U64(20))) % U64(1 << 30)
            label = [int(bucket[x[0]]) if bucket[x[0]] < n_buckets else -1 - int(y) for x, y in zip(cut, spread)]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), *[pa.array([v[x].astype(k).tobytes() for x in cut], pa.binary()) for v, k in ((gram, U64), (doc, "<i8"), (d1, U64), (size, "<u4"), (at, "<u4"))]], schema=kinds)

    sent = rows.mapInArrow(send, "bucket int, gram binary, doc binary, d1 binary, size binary, place binary")
    return dealt(sent)


_CANDIDATES = "a long, b long, gram long, place long, size long, d1 long"


def list_pairs(gram: np.ndarray, size: np.ndarray, place_: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Pairs of entries of one list that size and place leave possible; entries come sorted by (gram, size, place).

    A block is what a list holds of one size. Each entry is set against its own block and the larger sizes that
    can link; a block is skipped where the entry's own place is beyond reach, else read up to the last place
    within reach. Returns both sides of each pair, and how many blocks were met, skipped whole, and left early.
    """
    n = len(gram)
    new = np.ones(n, bool)
    new[1:] = (gram[1:] != gram[:-1]) | (size[1:] != size[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    own = np.cumsum(new) - 1  # the block of each entry
    block_size = size[begin]
    # blocks of a list are in order of size: the last one that an entry of block k can link with
    list_no = np.cumsum(np.concatenate([[True], gram[begin][1:] != gram[begin][:-1]]))
    width = int(block_size.max(initial=0)) + 2
    order = list_no * width + block_size
    last = np.searchsorted(order, list_no * width + np.minimum(100 * block_size // rule.percent, width - 1), side="right")
    count = (last - np.arange(len(begin)))[own]
    x = np.repeat(np.arange(n), count)
    block = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + own[x]
    met = len(x)
    open_ = place_[x] <= rule.reach(size[x], block_size[block])
    x, block = x[open_], block[open_]
    deep = int(place_.max(initial=0)) + 2
    limit = np.minimum(rule.reach(block_size[block], size[x]), deep - 2)
    stop = np.searchsorted(own * deep + place_, block * deep + limit, side="right")
    start = np.where(block == own[x], x + 1, begin[block])
    many = np.maximum(stop - start, 0)
    left = np.repeat(x, many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
    return left, right, {"met": met, "skipped": met - len(x), "left": int((stop < end[block]).sum())}


def candidates(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) from short lists; entries of long lists (a, gram, place, size, d1; b null) for the leaders."""
    names = [x.split()[0] for x in _CANDIDATES.split(", ")]

    def out(a, b=None, gram=None, place_=None, size=None, d1=None) -> pa.RecordBatch:
        columns = (a, b, None if gram is None else fold64(gram), place_, size, None if d1 is None else fold64(d1))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x in columns], names=names)

    def find(it) -> Iterator[pa.RecordBatch]:
        kinds = {"gram": U64, "doc": np.dtype("<i8"), "d1": U64, "size": np.dtype("<u4"), "place": np.dtype("<u4")}
        for bucket, (gram, doc, d1, size, at) in _numbered(it, kinds):
            if bucket < 0:
                yield out(doc, None, gram, at, size, d1)
                continue
            order = np.argsort(gram, kind="stable")
            same = gram[order[1:]] == gram[order[:-1]]
            multi = np.zeros(len(order), bool)
            multi[1:] |= same
            multi[:-1] |= same
            keep = order[multi]
            keep = keep[np.lexsort((doc[keep], d1[keep], gram[keep]))]
            gram, doc, d1, size, at = (x[keep] for x in (gram, doc, d1, size.astype(np.int64), at.astype(np.int64)))
            if not len(gram):
                continue
            new = np.ones(len(gram), bool)  # of equal sets the smallest document stands for all
            new[1:] = (gram[1:] != gram[:-1]) | (d1[1:] != d1[:-1])
            gram, doc, d1, size, at = (x[new] for x in (gram, doc, d1, size, at))
            begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            length = np.diff(np.append(begin, len(gram)))
            long = np.repeat(length > rule.light, length)
            if long.any():
                yield out(doc[long], None, gram[long], at[long], size[long], d1[long])
            short = np.flatnonzero(~long)
            short = short[np.lexsort((at[short], size[short], gram[short]))]
            edges = np.append(np.flatnonzero(np.concatenate([[True], gram[short][1:] != gram[short][:-1]])), len(short))
            edges = np.unique(edges[np.searchsorted(edges, np.minimum(np.arange(0, len(short) + 20_000, 20_000), len(short)))])
            found = []
            for lo, hi in zip(edges[:-1], edges[1:]):  # whole lists, some 20,000 entries at a time
                part = short[lo:hi]
                x, y, _ = list_pairs(gram[part], size[part], at[part], rule)
                x, y = doc[part[x]], doc[part[y]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield out(pairs[:, 0], pairs[:, 1])

    return entries.mapInArrow(find, _CANDIDATES)


def dealt(messages: DataFrame) -> DataFrame:
    """Messages by their bucket's number over all partitions alike, sorted by it."""
    n = partitions(messages.sparkSession)
    return messages.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def _numbered(it, kinds: dict) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Each bucket's number and its messages joined, column by column; the rows of a task come sorted by bucket.

    Messages with a number below 0 belong to no bucket and come one by one.
    """
    now, held = None, [[] for _ in kinds]
    for b in it:
        columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in kinds]
        for i, bucket in enumerate(b.column(b.schema.get_field_index("bucket")).to_pylist()):
            if now is not None and (bucket != now or bucket < 0):
                yield now, tuple(np.frombuffer(b"".join(h), k) for h, k in zip(held, kinds.values()))
                held = [[] for _ in kinds]
            now = bucket
            for h, c in zip(held, columns):
                h.append(c[i])
    if now is not None:
        yield now, tuple(np.frombuffer(b"".join(h), k) for h, k in zip(held, kinds.values()))


def by_histogram(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, size of b) that the histograms of both leave possible; of ids with several sets, that those of any two do."""

    def keep(it) -> Iterator[pa.RecordBatch]:
        for a, b, size_a, hist_a, size_b, hist_b in batches(it, ["a", "b", "size_a", "hist_a", "size_b", "hist_b"]):
            ok = pa.array(_near(rule, size_a.to_numpy(), _hists(hist_a), size_b.to_numpy(), _hists(hist_b)))
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok), size_b.filter(ok)], names=["a", "b", "size"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("hist").alias("hist_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("hist").alias("hist_b"))
    return pairs.distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(keep, "a long, b long, size long")


#: N-grams that are verified against one text in one go: a document with more partners' n-grams is dealt out in shares.
_SHARE = 200_000


def verified(rows: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose texts' sets do link: a, b, and the least number of n-grams that b has beyond a.

    Only texts that a pair names are shuffled, but for a filter's few errors. A pair brings the text of b to a share
    of a, and the text of a goes to each of its shares once: a leader of thousands is dealt over many
    partitions and its set is built once a share, not once a pair.
    """
    spark = rows.sparkSession
    pairs = written(pairs.groupBy("a", "b").agg(F.max("size").alias("size")), "pairs")
    shares = pairs.groupBy("a").agg(F.ceil(F.sum("size") / _SHARE).cast("int").alias("shares"))

    with lent(spark, key_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")) as held:

        def pick(it) -> Iterator[pa.RecordBatch]:
            for ids, texts, at in batches(it, ["doc_id", "text", "at"]):
                ok = pa.array(passes(held.value, at.to_numpy()))
                yield pa.RecordBatch.from_arrays([ids.filter(ok), texts.filter(ok)], names=["doc_id", "text"])

        texts = written(rows.withColumn("at", place(F.col("doc_id")).cast("long")).mapInArrow(pick, "doc_id long, text string"), "texts")

    def check(it) -> Iterator[pa.RecordBatch]:
        key, first = None, []
        for b in it:
            a, share, other = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("a", "share", "b"))
            text, out, at = b.column(b.schema.get_field_index("text")), [], 0
            for block in blocks(text):
                for s in rule.sets(block):
                    if key != (a[at], share[at]):
                        key, first = (a[at], share[at]), []
                    if other[at] is None:
                        first.append(s)  # rows of one id are one document: any of its texts may link
                    else:
                        beyond = [len(s) - len(np.intersect1d(x, s, assume_unique=True)) for x in first if rule.links(x, s)]
                        if beyond:
                            out.append((a[at], other[at], min(beyond)))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "beyond"])
        give_back()

    share = pairs.join(shares.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    other = share.hint("merge").join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "share", "b", "text")
    own = shares.hint("merge").join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "text")
    met = own.unionByName(other).repartition(partitions(spark), "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    links = written(met.mapInArrow(check, "a long, b long, beyond long").groupBy("a", "b").agg(F.min("beyond").alias("beyond")), "links")
    remove(spark, texts.plotwise_path)
    remove(spark, pairs.plotwise_path)
    return links


def leader_pairs(entries: DataFrame, rule: Rule) -> DataFrame:
    """Every set of a long list (b) with the smallest document (a) of its band of sizes, and of the band below."""
    banded = entries.withColumn("band", rule.band(F.col("size")))
    lead = written(banded.groupBy("gram", "band").agg(F.min("doc").alias("lead")), "leaders")
    own = banded.select("gram", "doc", F.explode(F.array("band", F.col("band") - 1)).alias("band")).join(lead, ["gram", "band"])
    return own.where("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"))


def followers(entries: DataFrame, links: DataFrame, labels: DataFrame, several: DataFrame, rule: Rule) -> DataFrame:
    """Entries of long lists whose sets are not all in one component, each with a leader it follows and the n-grams it has beyond it.

    Columns gram, doc, place, size, component, lead, beyond, band. A set that follows no leader, a leader, and an id of
    `several` sets lead themselves.
    """
    leads = links.select(F.col("a").alias("lead")).distinct()
    free = leads.select(F.col("lead").alias("b")).unionByName(several.select(F.col("doc_id").alias("b")))
    follows = links.join(free.hint("merge"), "b", "left_anti").groupBy(F.col("b").alias("doc")).agg(F.min_by("a", F.struct("beyond", "a")).alias("lead"), F.min("beyond").alias("beyond"))
    tagged = entries.join(labels.hint("merge"), entries["doc"] == labels["node"], "left").join(follows.hint("merge"), "doc", "left")
    tagged = tagged.select("gram", "doc", "place", "size", F.coalesce("component", "doc").alias("component"), F.coalesce("lead", "doc").alias("lead"), F.coalesce("beyond", F.lit(0)).alias("beyond"))
    tagged = written(tagged.withColumn("band", rule.band(F.col("size"))), "tagged")
    mixed = tagged.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram")
    return tagged.join(mixed, "gram")


def _tiles(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a list dealt over tiles of about TILE rows by `key`; each pair of tiles (i, j) of a band is a group, so no task holds a list."""
    shares = rows.groupBy("gram").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    held = rows.join(shares, "gram").withColumn("tile", F.pmod(F.xxhash64(key), F.col("tiles")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return held.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))


def open_leaders(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(gram, lead) of the groups that some other group of the list, in another component, may link with.

    Two leaders share at most what their histograms leave; a follower shares at most that and what it, and the other,
    have beyond their leaders. Where even the farthest followers stay below the threshold, the leader's
    answer settles all of them.
    """
    groups = rows.groupBy("gram", "lead").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max("beyond").alias("most"), F.min("component").alias("component"))
    groups = written(groups, "groups")
    # a group stands in every band that its sizes reach, and in the one below: sets that link are in one band or neighbours
    wide = _tiles(groups, "lead").withColumn("group", F.explode(F.sequence(rule.band(F.col("low")) - 1, rule.band(F.col("high")))))
    keyed = wide.join(sets.select(F.col("doc_id").alias("lead"), F.col("size").alias("lead_size"), "hist").hint("merge"), "lead")

    def compare(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        lead, low, high, most, comp, size, tile = (table.column(c).to_numpy() for c in ("lead", "low", "high", "most", "component", "lead_size", "tile"))
        hist = _hists(table.column("hist"))
        first, second, found = np.flatnonzero(tile == i), np.flatnonzero(tile == j), np.zeros(len(lead), bool)
        for x in first.tolist():
            y = second[second > x] if i == j else second
            y = y[(comp[y] != comp[x]) & (rule.percent * low[y] <= 100 * high[x]) & (rule.percent * low[x] <= 100 * high[y])]
            if len(y):
                shared = (size[x] + size[y] - _gap(hist[x][None, :], hist[y])) // 2
                y = y[shared + most[x] + most[y] >= rule.overlap(low[x], low[y])]
                found[y] = True
                found[x] |= len(y) > 0
        own = np.unique(lead[found])
        return pa.table({"lead": own, "gram": np.full(len(own), key[0].as_py())})

    return keyed.groupBy("gram", "group", "i", "j").applyInArrow(compare, "lead long, gram long").distinct()


def open_pairs(entries: DataFrame, links: DataFrame, labels: DataFrame, several: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of sets of a long list, not in one component, that the answers of their leaders and their own histograms leave open."""
    rows = written(followers(entries, links, labels, several, rule), "followers")
    still = written(open_leaders(rows, sets, rule), "open")
    close = written(rows.join(still, ["gram", "lead"], "left_semi"), "close")
    wide = _tiles(close, "doc").withColumn("group", F.explode(F.array("band", F.col("band") - 1)))
    keyed = wide.join(sets.select(F.col("doc_id").alias("doc"), "hist").hint("merge"), "doc")

    def compare(key, table):
        group, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        doc, size, at, comp, band, tile = (table.column(c).to_numpy() for c in ("doc", "size", "place", "component", "band", "tile"))
        hist = _hists(table.column("hist"))
        first, second, found = np.flatnonzero(tile == i), np.flatnonzero(tile == j), [np.zeros((0, 2), np.int64)]
        for x in first.tolist():
            y = second[second > x] if i == j else second
            y = y[(comp[y] != comp[x]) & ((band[y] == group) | (band[x] == group))]
            y = y[(at[y] <= rule.reach(size[y], size[x])) & (at[x] <= rule.reach(size[x], size[y]))]
            y = y[_near(rule, size[x], hist[x][None, :], size[y], hist[y])] if len(y) else y
            found.append(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.groupBy("gram", "group", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_copies(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by alike texts: id_col, n_shingles, component_id, class_id of every row.

    Words are runs between ASCII white space, A-Z in lower case. A document's set is its distinct sequences
    of `n` words; with fewer words the whole sequence is the only one; a null or empty text has none and is
    linked with nothing. Two documents link when 100 * intersection >= percent * union, for every pair of the
    table. component_id is the smallest id reachable by links, itself included; class_id the smallest id
    with an equal set. Rows without an id have a set size and null classes; rows of one id are one document
    (a link of either counts); other columns are ignored; an empty table gives no rows.
    """
    rule = Rule(n, percent)
    spark = documents.sparkSession
    every = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = every.where("doc_id is not null")
    described = written(describe_sets(every, rule), "sets")
    sets = described.where("doc_id is not null and size > 0")
    keys = ["size", "d1", "d2"]
    classes = written(sets.groupBy(*keys).agg(F.min("doc_id").alias("class_id")), "classes")
    leaders = written(sets.join(classes.select(F.col("class_id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", *keys]), "leaders")

    n_buckets = 4 * partitions(spark)
    with lent(spark, common_grams(rows, rule, n_buckets)) as common:
        found = written(candidates(index(rows, rule, common, n_buckets), rule), "candidates")
    long = found.where("b is null").groupBy("gram", "d1").agg(F.min("a").alias("doc"), F.min("place").alias("place"), F.min("size").alias("size"))
    long = written(long, "long")
    short = found.where("b is not null").select("a", "b")
    led = leader_pairs(long, rule)
    links = verified(rows, by_histogram(short.unionByName(led), leaders, rule), rule)
    # an id with several sets ties their classes together
    classed = sets.join(classes.hint("merge"), keys).select("doc_id", "class_id")
    several = written(classed.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z"), "several")
    tied = classed.join(several.hint("merge"), "doc_id").select("a", F.col("class_id").alias("b"))
    stars = components(links.select("a", "b").unionByName(tied))
    known = links.join(led.distinct().hint("merge"), ["a", "b"], "left_semi")
    rest = verified(rows, by_histogram(open_pairs(long, known, stars, several, leaders, rule), leaders, rule), rule)
    joined = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest.select("a", "b")))
    for table in (leaders, found, long, links, several, rest):
        remove(spark, table.plotwise_path)

    # links are between classes' smallest documents; other copies follow their class
    classed = described.join(classes.hint("merge"), keys, "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    classed = classed.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    out = classed.join(joined.hint("merge"), classed["class_id"] == joined["node"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
