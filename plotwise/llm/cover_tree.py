"""Exact cosine threshold pairs by dual traversal of cover trees, blocks of vectors against blocks.

Angles are the metric here: the angle between unit vectors obeys the triangle inequality, and cosine >= c is angle <= acos(c).

A tree has nested levels whose radii halve: every node covers its points within its level's radius, its first child has the
node's own centre, its other children's centres are further from it than the children's radius. The last level is the points
themselves. Two trees are walked together, level by level: a pair of nodes whose centres are further apart than the threshold and
both measured covering radii together is pruned; one that is nearer than the threshold less both radii is taken as a whole, each
point linked with each, without a comparison; the others go on to their children. Pairs of points are decided by their cosine.

Equal vectors are one point with a weight. Points go to the nearest of some pivots, a cell beyond the bound of a block is split by
digest, and each block of points is one tree, built once. Blocks meet where the annuli of their points around the pivots allow
a pair at all: each part of the written trees is read beside each other part, so that no block is copied for its meetings. The meetings
of two parts leave numbers of links and a forest of the links they have found, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import lent, remove, small_batches, written
from .components import components

#: Points a block, at first; it grows so that there are at most MOST_BLOCKS of them, whose bounds (40 bytes each) every task gets.
BLOCK, MOST_BLOCKS = 2048, 1 << 16
#: Pivots at most, from a sample of at most SAMPLE points; where they stand decides the work, never the result.
PIVOTS, SAMPLE = 1024, 8192
#: Radians that bounds give way, far above rounding; what they leave undecided is decided by the cosine itself.
SLACK = 1e-7
#: Trees of one file: of few, they are read in as many parts as there are cores.
FEW = 4
#: Entries of a matrix of cosines at a time.
_CELLS = 1 << 21


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; -0.0 counts as 0.0."""
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Tree:
    """Points in the order of their nodes; of each level the first point (its centre) and covering radius of every node."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, starts: list[np.ndarray], radii: list[np.ndarray]) -> None:
        self.points, self.weights, self.n = points, weights, len(points)
        self.starts = [*starts, np.arange(self.n)]
        self.stops = [np.append(s[1:], self.n) for s in self.starts]
        self.radii = [*radii, np.zeros(self.n)]
        self.sums = np.concatenate([[0], np.cumsum(weights)])
        # a node's children follow one another on the next level
        self.children = [np.searchsorted(low, np.append(high, self.n)) for high, low in zip(self.starts[:-1], self.starts[1:])]


def build(unit: np.ndarray, finest: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The order of the points, and starts and radii of each level above the points; levels end at the radius `finest`."""
    groups, starts, radii = [np.arange(len(unit))], [], []
    radius, own = math.pi, [float(_angles(unit @ unit[0]).max())]
    while True:
        starts.append(np.cumsum([0, *(len(g) for g in groups[:-1])]))
        radii.append(np.array(own))
        if radius <= finest or len(groups) == len(unit):
            break
        radius /= 2
        below, own = [], []
        for rest in groups:
            while len(rest):
                far = _angles(unit[rest] @ unit[rest[0]])
                near = far <= radius
                near[0] = True
                below.append(rest[near])
                own.append(float(far[near].max()) if len(below[-1]) > 1 else 0.0)
                rest = rest[~near]
        groups = below
    return np.concatenate(groups), starts, radii


class Meeting:
    """Links between the points of two trees, or within one: numbers of links, and a forest of what hangs together."""

    def __init__(self, a: Tree, b: Tree | None, cosine: float) -> None:
        self.same = b is None
        self.a, self.b = a, a if b is None else b
        self.cosine, self.limit = cosine, math.acos(cosine)
        self.base = 0 if self.same else a.n
        self.one, self.many = [np.zeros(t.n, np.int64) for t in (a, self.b)], [np.zeros(t.n + 1, np.int64) for t in (a, self.b)]
        self.own = np.zeros(a.n + 1, np.int64)
        self.root = np.arange(self.base + self.b.n)
        self.compared = 0
        self._walk()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of each point of a and of b; of a tree with itself, those of a count."""
        of_a, of_b = (x + np.cumsum(y)[:-1] for x, y in zip(self.one, self.many))
        return of_a - self.a.weights * np.cumsum(self.own)[:-1], of_b

    def _walk(self) -> None:
        a, b, la, lb = self.a, self.b, 0, 0
        zero = np.zeros(1, np.int64)
        open_a, open_b = self._decide(0, 0, zero, zero, np.einsum("ij,ij->i", a.points[:1], b.points[:1]))
        while len(open_a):
            (a0, a1), (b0, b1) = self._below(a, la, open_a), self._below(b, lb, open_b)
            la, lb = min(la + 1, len(a.starts) - 1), min(lb + 1, len(b.starts) - 1)
            size, left = (a1 - a0) * (b1 - b0), []
            big = size > 1024
            for k in np.flatnonzero(big):
                left += self._dense(la, lb, np.arange(a0[k], a1[k]), np.arange(b0[k], b1[k]))
            few = np.flatnonzero(~big)
            for some in np.split(few, np.flatnonzero(np.diff(np.cumsum(size[few]) // (_CELLS >> 3))) + 1):
                if len(some):
                    left.append(self._listed(la, lb, a0[some], b0[some], b1[some] - b0[some], size[some]))
            open_a, open_b = (np.concatenate([x[k] for x in left]) for k in (0, 1))

    @staticmethod
    def _below(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level + 1 == len(tree.starts):
            return nodes, nodes + 1
        return tree.children[level][nodes], tree.children[level][nodes + 1]

    def _listed(self, la: int, lb: int, a0: np.ndarray, b0: np.ndarray, wide: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of some pairs, pair by pair."""
        pair = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        x, y = a0[pair] + at // wide[pair], b0[pair] + at % wide[pair]
        self.compared += len(x)
        return self._decide(la, lb, x, y, np.einsum("ij,ij->i", self.a.points[self.a.starts[la][x]], self.b.points[self.b.starts[lb][y]]))

    def _dense(self, la: int, lb: int, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """All children of one pair by a product of matrices, single points and larger nodes apart: the bound is that of the largest radius."""
        a, b, left = self.a, self.b, []
        for xs in self._by_size(a, la, x):
            for ys in self._by_size(b, lb, y):
                across, wide = b.points[b.starts[lb][ys]].T, b.radii[lb][ys].max()
                step = max(1, _CELLS // len(ys))
                for lo in range(0, len(xs), step):
                    some = xs[lo : lo + step]
                    cosines = a.points[a.starts[la][some]] @ across
                    self.compared += cosines.size
                    reach = self.limit + wide + a.radii[la][some].max() + SLACK
                    i, j = np.nonzero(cosines >= (math.cos(reach) if reach < math.pi else -2.0))
                    left.append(self._decide(la, lb, some[i], ys[j], cosines[i, j]))
        return left

    @staticmethod
    def _by_size(tree: Tree, level: int, nodes: np.ndarray) -> list[np.ndarray]:
        single = tree.stops[level][nodes] - tree.starts[level][nodes] == 1
        return [some for some in (nodes[single], nodes[~single]) if len(some)]

    def _decide(self, la: int, lb: int, x: np.ndarray, y: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settles pairs of nodes where bounds, or for points their cosine, allow; gives back those left open."""
        a, b = self.a, self.b
        from_a, to_a, from_b, to_b = a.starts[la][x], a.stops[la][x], b.starts[lb][y], b.stops[lb][y]
        points = (to_a - from_a == 1) & (to_b - from_b == 1)
        linked = points & (cosines >= self.cosine)
        if self.same:
            linked &= from_a != from_b
        self._link(from_a[linked], from_b[linked])
        radii = a.radii[la][x] + b.radii[lb][y]
        angle = _angles(cosines)
        whole = ~points & (angle + radii <= self.limit - SLACK)
        if whole.any():
            self._link_whole(from_a[whole], to_a[whole], from_b[whole], to_b[whole])
        still = ~points & ~whole & (angle - radii <= self.limit + SLACK)
        return x[still], y[still]

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            np.add.at(self.one[0], i, self.b.weights[j])
            np.add.at(self.one[1], j, self.a.weights[i])
            self._union(i, self.base + j)

    def _link_whole(self, from_a: np.ndarray, to_a: np.ndarray, from_b: np.ndarray, to_b: np.ndarray) -> None:
        a, b = self.a, self.b
        for many, lo, hi, more in ((self.many[0], from_a, to_a, b.sums[to_b] - b.sums[from_b]), (self.many[1], from_b, to_b, a.sums[to_a] - a.sums[from_a])):
            np.add.at(many, lo, more)
            np.add.at(many, hi, -more)
        if self.same:
            itself = from_a == from_b
            np.add.at(self.own, from_a[itself], 1)
            np.add.at(self.own, to_a[itself], -1)
        for base, lo, hi in ((0, from_a, to_a), (self.base, from_b, to_b)):  # points that all link with one other hang together
            lo, at = np.unique(lo, return_index=True)
            size = hi[at] - lo
            first = np.repeat(lo, size)
            self._union(base + first, base + first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size))
        self._union(from_a, self.base + from_b)

    def _union(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


class Meetings:
    """Numbers of links and a forest of what hangs together over the meetings of some blocks."""

    def __init__(self, cosine: float) -> None:
        self.cosine, self.at, self.nodes, self.links, self.n = cosine, {}, {}, {}, 0
        self.root = np.zeros(0, np.int64)

    def meet(self, one: int, a: Tree, nodes: np.ndarray, other: int, b: Tree | None, more: np.ndarray) -> None:
        """Block `one` with another, or with itself where `b` is None."""
        meeting = Meeting(a, b, self.cosine)
        for block, own, links in zip((one, other), (nodes, more), meeting.links()[: 1 if b is None else 2]):
            if not links.any():
                continue
            if block not in self.at:
                self.at[block], self.nodes[block], self.links[block] = self.n, own.copy(), np.zeros(len(own), np.int64)
                self.n += len(own)
                if self.n > len(self.root):
                    self.root = np.concatenate([self.root, np.arange(len(self.root), 2 * self.n)])
            self.links[block] += links
        some = np.flatnonzero(meeting.root != np.arange(len(meeting.root)))
        if len(some):
            here = lambda x: np.where(x < meeting.base, self.at.get(one, 0) + x, self.at.get(other, 0) + x - meeting.base)
            self._union(here(some), here(meeting.root[some]))

    def _top(self, i: np.ndarray) -> np.ndarray:
        x = self.root[i]
        while True:
            up = self.root[x]
            if np.array_equal(up, x):
                self.root[i] = x
                return x
            x = up

    def _union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self._top(i), self._top(j)
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Node, number of links and head of all points with links, block by block."""
        if not self.n:
            return
        every = np.concatenate([self.nodes[k] for k in self.at])
        for block, at in self.at.items():
            some = np.flatnonzero(self.links[block])
            yield self.nodes[block][some], self.links[block][some], every[self._top(at + some)]


# ---- on tables


def _packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, dims, digest and bytes of every vector; digest and bytes are null where a row links with nothing."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch["embedding"], batch.num_rows
            values, empty = column.values, np.ones(n, bool)
            dims = np.asarray(column.value_lengths().fill_null(0))
            offsets = np.asarray(column.offsets)[:n]
            numbers = values.to_numpy(zero_copy_only=False).astype(kind)
            fit = np.isfinite(numbers) & ~np.asarray(values.is_null())
            here = np.asarray(batch["vec_id"].is_valid())
            digests, raw = [None] * n, [None] * n
            for d in np.unique(dims[dims > 0]):
                rows = np.flatnonzero((dims == d) & here)
                at = offsets[rows][:, None] + np.arange(d)
                rows, at = rows[fit[at].all(1)], at[fit[at].all(1)]
                rows, at = rows[(numbers[at] != 0).any(1)], at[(numbers[at] != 0).any(1)]
                if not len(rows):
                    continue
                for r, one, unit in zip(rows, numbers[at], unit_rows(numbers[at])):
                    digests[r], raw[r] = hashlib.blake2b(unit.tobytes(), digest_size=16).digest(), one.tobytes()
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dims", "digest", "v"])

    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    return given.mapInArrow(pack, "vec_id long, dims int, digest binary, v binary"), kind


def _by_dims(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = batch["dims"].to_numpy()
    raw = batch["v"].to_pylist()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield int(d), rows, np.frombuffer(b"".join(raw[r] for r in rows), kind).reshape(len(rows), d)


def pick_pivots(unit: np.ndarray, most: int) -> np.ndarray:
    """At most `most` of some points, spread out: each is further than the present radius from those before, and the radius halves."""
    order, far, radius = [0], _angles(unit @ unit[0]), math.pi
    while len(order) < most and radius > 1e-3:
        radius /= 2
        while len(order) < most and (far > radius).any():
            order.append(int(np.argmax(far > radius)))
            far = np.minimum(far, _angles(unit @ unit[order[-1]]))
    return unit[order]


def _place(pivots: dict[int, np.ndarray], d: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and angle to it; -1 and 0 for vectors of a length that the sample did not hold."""
    if d not in pivots:
        return np.full(len(values), -1), np.zeros(len(values))
    cosines = unit_rows(values) @ pivots[d].T
    cell = cosines.argmax(1)
    return cell, _angles(cosines[np.arange(len(values)), cell])


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of a table (vec_id, embedding).

    Rows link if their vectors have as many components and a cosine of at least `cosine` (above 0), in double precision. Vectors that
    are null, empty, zero, or hold null, NaN or infinite components link with nothing, nor do rows without an id. n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable by links, kept whether that is the row's own. Rows of one id
    are vectors each. Further columns are ignored. `block` bounds the points that one tree holds.
    """
    if not 0 < cosine <= 1:
        raise ValueError("a cosine above 0 and at most 1 is needed")
    spark = vectors.sparkSession
    small_batches(spark)
    packed, kind = _packed(vectors)
    # vectors are packed again for their ids, not written for them: their bytes are on disk as points and as trees alone
    alike = packed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("w"), F.min("vec_id").alias("low"), F.first("v").alias("v"), F.first("dims").alias("dims"))
    points = written(alike.withColumn("node", F.monotonically_increasing_id()), "points")
    rows = written(packed.select("vec_id", "digest"), "ids")
    links, joined = _linked(points, kind, cosine, block)
    of_node = points.select("node", "digest", "w", "low").join(links, "node", "left").join(joined, "node", "left")
    lowest = of_node.where("head is not null").groupBy("head").agg(F.min("low").alias("least"))
    facts = of_node.join(lowest, "head", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"), "w")
    facts = written(facts, "links")
    # Copies that hold a thousandth of all rows are fewer than a thousand: their facts go to every task, the others' by digest.
    heavy = rows.count() // 1000 + 1
    few = F.broadcast(facts.where(F.col("w") >= heavy).select("digest", F.col("n_links").alias("many"), F.col("component_id").alias("lowest")))
    rows = rows.join(few, "digest", "left")
    settled = rows.where("many is not null or digest is null").select("vec_id", F.coalesce("many", F.lit(0)).alias("n_links"), F.coalesce("lowest", "vec_id").alias("component_id"))
    rest = rows.where("many is null and digest is not null").join(facts.where(F.col("w") < heavy), "digest").select("vec_id", "n_links", "component_id")
    return settled.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(points: DataFrame, kind: str, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) of points that have links to others, and (node, head) of the components of those links."""
    spark, limit = points.sparkSession, math.acos(cosine)
    total = points.count()
    block = max(block, -(-2 * total // MOST_BLOCKS))
    sample = points.select("dims", "v", "digest").orderBy("digest").limit(SAMPLE).collect()
    pivots = {}
    for d in {r["dims"] for r in sample}:
        unit = unit_rows(np.frombuffer(b"".join(bytes(r["v"]) for r in sample if r["dims"] == d), kind).reshape(-1, d))
        pivots[d] = pick_pivots(unit, max(1, min(PIVOTS, -(-total * len(unit) // (len(sample) * block)))))
    with lent(spark, pivots) as held:
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, _, values in _by_dims(batch, kind):
                    cell, n = np.unique(_place(held.value, d, values)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(cell), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], ["dims", "cell", "n"])

        sizes = points.select("dims", "v").mapInArrow(cells, "dims int, cell int, n long").groupBy("dims", "cell").agg(F.sum("n").alias("n")).orderBy("dims", "cell").collect()
        first, blocks_of = 0, {}
        for r in sizes:
            parts = max(1, -(-r["n"] // block)) if r["n"] > 1.5 * block else 1
            blocks_of[r["dims"], r["cell"]] = (first, parts)
            first += parts
        with lent(spark, blocks_of) as numbers:
            def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = np.zeros((3, batch.num_rows))
                    digest = np.frombuffer(b"".join(x[:4] for x in batch["digest"].to_pylist()), "<u4")
                    for d, rows, values in _by_dims(batch, kind):
                        cell, angle = _place(held.value, d, values)
                        start, parts = np.array([numbers.value[d, c] for c in cell.tolist()]).T
                        out[:, rows] = start + digest[rows] % parts, cell, angle
                    columns = [pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int32)), pa.array(out[2])]
                    yield pa.RecordBatch.from_arrays([batch["node"], batch["w"], batch["dims"], batch["v"], *columns], ["node", "w", "dims", "v", "block", "cell", "angle"])

            dealt = points.select("node", "w", "dims", "v", "digest").mapInArrow(deal, "node long, w long, dims int, v binary, block int, cell int, angle double")
            grown = dealt.groupBy("block").applyInArrow(lambda table: _grow(table, kind, limit, held.value), "block int, dims int, cell int, low double, high double, reach array<double>, body binary")
            trees = written(grown, "trees", rows_per_file=FEW)
    met = written(_met(trees, limit, cosine), "meetings")
    remove(spark, trees.plotwise_path)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(met.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "head").select("node", "head")
    return links, joined


def _grow(table: pa.Table, kind: str, limit: float, pivots: dict[int, np.ndarray]) -> pa.Table:
    d = table["dims"][0].as_py()
    values = np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(-1, d)
    order, starts, radii = build(unit_rows(values), limit / 16)
    cell, angle = table["cell"][0].as_py(), table["angle"].to_numpy()
    body = {"v": values[order], "w": table["w"].to_numpy()[order], "node": table["node"].to_numpy()[order], "starts": [s.astype(np.int32) for s in starts], "radii": radii}
    low, high = (angle.min(), angle.max()) if cell >= 0 else (0.0, math.pi)
    flat = [body["v"].tobytes(), body["w"].astype("<i8").tobytes(), body["node"].astype("<i8").tobytes(), *(x.astype(t).tobytes() for s, r in zip(starts, radii) for x, t in ((s, "<i4"), (r, "<f8")))]
    head = np.array([len(order), d, 4 if kind == "<f4" else 8, len(starts), *(len(s) for s in starts)], "<i8")
    return pa.table({"block": table["block"].slice(0, 1), "dims": pa.array([d], pa.int32()), "cell": pa.array([cell], pa.int32()), "low": [float(low)], "high": [float(high)], "reach": pa.array([_angles(pivots[d] @ pivots[d][cell]) if cell >= 0 else []], pa.list_(pa.float64())), "body": pa.array([head.tobytes() + b"".join(flat)], pa.binary())})


def _read(body: bytes) -> tuple[Tree, np.ndarray]:
    """A block's tree and the numbers of its points, as _grow has written them."""
    n, d, width, levels = np.frombuffer(body, "<i8", 4).tolist()
    sizes = np.frombuffer(body, "<i8", levels, 32).tolist()
    at = 32 + 8 * levels
    takes = [("<f4" if width == 4 else "<f8", n * d), ("<i8", n), ("<i8", n), *(t for m in sizes for t in (("<i4", m), ("<f8", m)))]
    found = []
    for kind, count in takes:
        found.append(np.frombuffer(body, kind, count, at))
        at += count * found[-1].itemsize
    points, weights, nodes, *levels_ = found
    return Tree(unit_rows(points.reshape(n, d)), weights, [x.astype(np.int64) for x in levels_[::2]], levels_[1::2]), nodes


def _met(trees: DataFrame, limit: float, cosine: float) -> DataFrame:
    """(node, links, head) of points with links, once for each two parts of the trees that hold some: sums are the reader's.

    x at angles [low, high] from pivot p and y at [low', high'] from p' are apart by D - high - high', low - D - high' and
    low' - D - high at least, D (`reach` has it for every p') between the pivots. A task reads one part of the written trees and, beside
    each of its blocks, the other part: nothing is shuffled, however many blocks meet.
    """
    one, other = trees.alias("one"), trees.select("block", "dims", "cell", "low", "high", "body").alias("other").hint("shuffle_replicate_nl")
    a, b = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"other.{c}"))
    between = F.get(a("reach"), b("cell"))
    apart = F.coalesce(F.greatest(between - b("high") - a("high"), b("low") - between - a("high"), a("low") - between - b("high")), F.lit(0.0))
    # a difference of lengths, for an equation would shuffle all blocks by their few lengths
    near = (a("block") <= b("block")) & (a("dims") - b("dims") == 0) & (apart <= limit + SLACK)
    pairs = one.join(other, near).select(a("block").alias("a"), a("body").alias("body_a"), b("block").alias("b"), b("body").alias("body_b"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meetings, last, held = Meetings(cosine), None, None
        for batch in batches:
            for one, other, body, more in zip(*(batch[c].to_pylist() for c in ("a", "b")), batch["body_a"], batch["body_b"]):
                if one != last:
                    last, held = one, _read(body.as_py())
                tree, nodes = (None, held[1]) if other == one else _read(more.as_py())
                meetings.meet(one, *held, other, tree, nodes)
        for columns in meetings.found():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "links", "head"])

    return pairs.mapInArrow(meet, "node long, links long, head long")
