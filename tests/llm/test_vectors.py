"""Cover-tree links, importance resampling and annulus clusters against brute force, on clusters, copies and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plotwise.llm import resampling
from plotwise.llm.centroids import Annulus, centroid_clusters
from plotwise.llm.cover_tree import Meeting, Tree, build, near_vectors, pick_pivots, unit_rows
from plotwise.llm.resampling import Trie, importance_sample, pieces, rank_all

INF, NAN = float("inf"), float("nan")


def crowd(n=400, dims=8, seed=5):
    """Loose vectors, tight groups, a chain of small steps and exact copies."""
    rng = np.random.default_rng(seed)
    loose = rng.normal(size=(n, dims))
    tight = rng.normal(size=(5, 1, dims)) + 0.02 * rng.normal(size=(5, 40, dims))
    wide = rng.normal(size=(4, 1, dims)) + 0.3 * rng.normal(size=(4, 40, dims))
    chain = np.stack([np.cos(np.arange(12) * 0.4), np.sin(np.arange(12) * 0.4), *np.zeros((dims - 2, 12))], 1)
    return np.concatenate([loose, tight.reshape(-1, dims), wide.reshape(-1, dims), chain, loose[:30], loose[:10], 3 * loose[30:40]])


def links_by_force(ids, vectors, cosine):
    unit = [None if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, float) / max(map(abs, v)) for v in vectors]
    unit = [None if v is None else v / math.sqrt(math.fsum(v * v)) for v in unit]
    n, low, near = len(ids), list(range(len(ids))), [[] for _ in ids]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and ids[i] is not None and ids[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                near[i].append(j)
                near[j].append(i)
    out, seen = [None] * n, [False] * n
    for i in range(n):
        if not seen[i]:
            stack, members = [i], []
            seen[i] = True
            while stack:
                x = stack.pop()
                members.append(x)
                for y in near[x]:
                    if not seen[y]:
                        seen[y] = True
                        stack.append(y)
            least = min((ids[m] for m in members if ids[m] is not None), default=None)
            for m in members:
                out[m] = (ids[m], len(near[m]), least, ids[m] is not None and ids[m] == least)
    return sorted(out, key=str)


@pytest.mark.parametrize("cosine", [0.9, 0.6])
def test_meetings_find_each_link_once(cosine):
    x = unit_rows(crowd())
    half = len(x) // 2
    trees = []
    for part in (x[:half], x[half:]):
        order, starts, radii = build(part, math.acos(cosine) / 16)
        assert sorted(order) == list(range(len(part)))
        tree = Tree(part[order], np.ones(len(part), np.int64), starts, radii)
        for level, (s, e, r) in enumerate(zip(tree.starts, tree.stops, tree.radii)):
            for a, b, far in zip(s, e, r):  # measured covering radii, inside the level's own
                assert far <= max(math.pi / 2**level, 0) + 1e-9 and np.arccos(np.clip(tree.points[a:b] @ tree.points[a], -1, 1)).max() <= far + 1e-7
        trees.append((tree, order))
    (a, oa), (b, ob) = trees
    cosines = x @ x.T
    both = Meeting(a, b, cosine)
    got_a, got_b = both.links()
    want = cosines[:half, half:] >= cosine
    assert (got_a == want.sum(1)[oa]).all() and (got_b == want.sum(0)[ob]).all()
    own = Meeting(a, None, cosine)
    assert (own.links()[0] == ((cosines[:half, :half] >= cosine).sum(1) - 1)[oa]).all()
    assert own.compared < half * half + 50 * half


def test_whole_nodes_link_without_comparing():
    rng = np.random.default_rng(1)
    x = unit_rows(rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(3000, 16)))
    order, starts, radii = build(x, math.acos(0.9) / 16)
    own = Meeting(Tree(x[order], np.full(3000, 2), starts, radii), None, 0.9)
    assert (own.links()[0] == 2 * 2999).all() and own.compared < 3000 and (own.root == 0).all()


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_near_vectors_against_all_pairs(spark, block):
    x = crowd(150)
    rows = [(int(i * 7 % 1009), [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [NAN] + [1.0] * 7), (5004, [None] + [1.0] * 7), (5005, [INF] * 8), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, [1.0] * 8), (5008, [-0.0, 1.0]), (5009, [0.0, 1.0]), (5010, [1e300, 1e300]), (5011, [1e-300, 1e-300]), (5006, [1.0, 2.0]), (5012, [-1.0, -2.0])]
    table = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, w int, digest string")
    got = sorted((tuple(r) for r in near_vectors(table, 0.9, block=block).collect()), key=str)
    assert got == links_by_force([i for i, _ in rows + odd], [v for _, v in rows + odd], 0.9)


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).collect() == []
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).collect()] == [(3, 0, 3, True)]


def test_hot_copies_keep_every_row(spark):
    """A third of all rows is one vector; its facts go by broadcast, the others' by digest."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(1500)]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.999).collect()), key=str)
    assert got == links_by_force([i for i, _ in rows], [v for _, v in rows], 0.999)


def test_pivots_are_spread():
    x = unit_rows(np.concatenate([np.eye(6)[[0] * 50] + 1e-6 * np.random.default_rng(0).normal(size=(50, 6)), np.eye(6)[1:]]))
    assert len(pick_pivots(x, 6)) == 6 and (pick_pivots(x, 6) @ pick_pivots(x, 6).T < 0.1).sum() == 30


# ---- resampling

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def drawn_by_force(docs, target, longest, buckets, percent, least, seed):
    def runs(text):
        w = WORD.findall(lowered(text))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, text in docs:
        w, f = runs(text)
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w)])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


TEXTS = [None, "", "one", "Ä x1 B-c É" * 9, "tag " * 40, "a b c d e f g h i j k l m n o p q r s t u v", "日本 語テ, スト! " * 30, "w" * 5000, "a\x00b\x85c " * 12]


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 50)])
def test_resampling_against_brute_force(spark, monkeypatch, longest, buckets):
    rng = np.random.default_rng(4)
    made = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(n)) % 500) for n in rng.integers(0, 80, 120)]
    docs = [*enumerate(TEXTS + made), (7, "same id again " * 10), (None, "no id " * 30), (3, TEXTS[3])]
    target = [None, *made[5:9], "tag a b c"]
    table = spark.createDataFrame([(i, t, 0, "k", 1) for i, t in docs], "doc_id long, text string, rank int, score string, n_words int").repartition(3)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    got = sorted((tuple(r) for r in importance_sample(table, goal, longest, buckets, percent=30, least=5).collect()), key=str)
    assert got == drawn_by_force(docs, target, longest, buckets, 30, 5, "2024")


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    goal = spark.createDataFrame([], "text string")
    assert importance_sample(docs, goal).collect() == []
    assert [tuple(r) for r in importance_sample(spark.createDataFrame([(1, None)], "doc_id long, text string"), goal).select("doc_id", "n_features", "weight", "rank").collect()] == [(1, 0, 0, None)]


def test_pieces_and_emptied_tries_change_nothing(monkeypatch):
    text = "Alpha beta gamma-delta ÉÉ alpha beta " * 50
    words = [w.encode() for w in WORD.findall(lowered(text))]
    assert [w for some in pieces(text.encode(), 7) for w in some] == words
    whole, sums = Trie(3, 97), np.zeros(97, np.int64)
    whole.add(words, [])
    monkeypatch.setattr(resampling, "NODES", 5)
    small, open_runs = Trie(3, 97), []
    for some in pieces(text.encode(), 11):
        if small.full():
            sums += small.totals()
            kept = small.spelled(open_runs)
            small.clear()
            open_runs = [small.spell(run) for run in kept]
        small.add(some, open_runs)
    assert (sums + small.totals() == whole.totals()).all() and whole.totals().sum() == 3 * len(words) - 3


def test_trie_states_are_crcs():
    trie = Trie(3, 10)
    node = trie.spell([b"an", b"ox", "é".encode()])
    assert trie.state[node] == zlib.crc32("an ox é".encode())


def test_ranks_cross_partitions(spark):
    rows = [(i, i * 37 % 11) for i in range(500)]
    got = [(r["k"], r["i"], r["r"]) for r in rank_all(spark.createDataFrame(rows, "i long, k long"), ["k", "i"], "r").collect()]
    assert sorted(got) == [(k, i, n) for n, (k, i) in enumerate(sorted((k, i) for i, k in rows), 1)]


# ---- clusters


def clusters_by_force(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for turn in range(rounds + 1):
        found = [(*nearest(v), i, v) for i, v in kept]
        if turn < rounds:
            for n in range(len(centres)):
                mine = [v for _, c, _, v in found if c == n]
                if mine:
                    centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, c, _, _ in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for d, c, i, _ in found), key=str)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 0.3, 4])).tolist()) for i in range(600)]
    rows += [(700 + i, rows[i][1]) for i in range(40)] + [(800, [0.0] * 6), (801, [-0.0] * 6), (3, rows[3][1]), (4, rows[9][1]), (None, [1.0] * 6)]
    bad = [(900, None), (901, [1.0] * 5), (902, [NAN] * 6), (903, [None] + [1.0] * 5), (904, [INF] * 6), (905, [-INF] * 6), (906, [])]
    table = spark.createDataFrame([(i, v, 3, 4) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, n int").repartition(3)
    got = sorted((tuple(r) for r in centroid_clusters(table, k=7, rounds=3, dims=6, scale=16.0).collect()), key=str)
    assert got == clusters_by_force(rows + bad, 7, 3, 6, 16.0, "1")
    big = spark.createDataFrame([(1, [1e200] * 6), (2, [1.0] * 6)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroid_clusters(big, k=7, dims=6).collect()] == [2]


def test_clusters_of_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroid_clusters(empty).collect() == [] and len(centroid_clusters(empty).columns) == 6
    two = spark.createDataFrame([(1, [1.0, 0.5]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert sorted(r["distance"] for r in centroid_clusters(two, k=16, dims=2).collect()) == [0, 0]


def test_annulus_leaves_out_what_norms_rule_out_and_keeps_ties():
    rng = np.random.default_rng(3)
    centres = np.array([[10 * r, 0] for r in range(40)] + [[0, 10 * r] for r in range(40)])
    x = rng.integers(-5, 400, (2000, 2))
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    index = Annulus(centres)
    first, best, all_took = index.nearest(x)
    again, _, took = index.nearest(x, first)
    assert (first == far.argmin(1)).all() and (again == first).all() and (best == far.min(1)).all()
    assert took < 0.8 * far.size
    tied = Annulus(np.array([[2, 0], [0, 2], [-2, 0]]))
    assert tied.nearest(np.array([[0, 0], [1, 1]]))[0].tolist() == [0, 0]
