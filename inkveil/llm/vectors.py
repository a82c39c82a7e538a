"""Near-duplicate vectors by cover trees and dual traversal, exact at the threshold."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import drop, stash
from .worker import arrow

#: Vectors of one leaf cell; a pair of cells is one unit of work.
CELL = 8192
#: Vectors that the centres of a split cell are chosen from, centres at most, and vectors that one task deals out.
SAMPLE, FAN, SHARE = 1024, 64, 100_000
#: In the name of a cell whose vectors are as good as equal: it is split no further.
DENSE = "!"
#: Points below which a node of a tree is not split further.
LEAF = 24
#: Numbers of a block of distances.
BLOCK = 1 << 20
#: More than distances are off by: the root of what a product of unit vectors is off by.
_EPS = 1e-6


def _net(x: np.ndarray, centre: int, reach: float, most: int | None = None) -> np.ndarray:
    """Rows of x that are more than ``reach`` apart and within reach of all others, the given one first.

    With ``most``, only the first so many, and the rest may be farther off.
    """
    close = 1 - reach * reach / 2
    found = [centre]
    for lo in range(0, len(x), 512):
        at = np.arange(lo, min(lo + 512, len(x)))
        at = at[(x[at] @ x[found].T).max(axis=1) < close]
        near = x[at] @ x[at].T >= close
        free = np.ones(len(at), bool)
        for i in range(len(at)):
            if free[i]:
                found.append(int(at[i]))
                free &= ~near[i]
        if most and len(found) >= most:
            return np.array(found[:most])
    return np.array(found)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest centre, and its distance."""
    who, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, BLOCK // len(centres))
    for lo in range(0, len(x), step):
        dot = x[lo : lo + step] @ centres.T
        who[lo : lo + step] = dot.argmax(axis=1)
        far[lo : lo + step] = np.sqrt(np.maximum(2 - 2 * dot.max(axis=1), 0))
    return who, far


def _halved(radius: float, reach: float = 2.0) -> float:
    """The first of reach, reach / 2, reach / 4 ... below the radius."""
    while reach >= radius:
        reach /= 2
    return reach


@dataclass
class CoverTree:
    """Points in the order of the leaves, and nodes: node k covers points lo[k]:hi[k] within radius[k] of point centre[k].

    Built top down: children's radii are at most half the reach above them,
    a node's own centre is one of its children's (nesting), and those are
    farther apart than the reach (separation). Node k's children are nodes
    first[k]:last[k]; a leaf has none.
    """

    x: np.ndarray
    ids: np.ndarray
    weight: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> CoverTree:
        order = np.arange(len(x))
        nodes: list[list] = [[0, float(_nearest(x, x[:1])[1].max(initial=0.0)), 0, len(x), 0, 0]]
        todo = [0]
        while todo:
            k = todo.pop()
            centre, radius, lo, hi, _, _ = nodes[k]
            if hi - lo <= LEAF or radius <= 10 * _EPS:
                continue
            points = order[lo:hi].copy()
            own = x[points]
            net = _net(own, int(np.flatnonzero(points == centre)[0]), _halved(radius))
            who, far = _nearest(own, own[net])
            by = np.argsort(who, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(net)))])
            reach = np.maximum.reduceat(far[by], cuts[:-1])
            order[lo:hi] = points[by]
            nodes[k][4:] = [len(nodes), len(nodes) + len(net)]
            todo += [len(nodes) + i for i in range(len(net))]
            nodes += [[int(points[c]), float(r), lo + int(i), lo + int(j), 0, 0] for c, r, i, j in zip(net, reach, cuts[:-1], cuts[1:], strict=True)]
        place = np.zeros(len(x), np.int64)
        place[order] = np.arange(len(x))
        centre, radius, lo, hi, first, last = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(x[order], ids[order], weight[order], place[centre], radius, lo, hi, first, last)


class Join:
    """Counts links of weighted points in two trees (or one with itself) and gathers edges that connect what is linked."""

    def __init__(self, a: CoverTree, b: CoverTree, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.reach = math.sqrt(2 - 2 * cosine)
        self.na, self.nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0
        todo = self._nodes(np.array([0]), np.array([0]), self.same)
        while todo:
            todo += self._visit(*todo.pop())
        if self.same:
            self.na += self.nb

    def _visit(self, p: int, q: int) -> list[tuple[int, int]]:
        a, b = self.a, self.b
        twin = self.same and p == q
        if twin and 2 * a.radius[p] <= self.reach - _EPS:
            self._among(p)
            return []
        if a.first[p] == a.last[p] and b.first[q] == b.last[q]:
            self._points(np.arange(a.lo[p], a.hi[p]), np.arange(b.lo[q], b.hi[q]), twin)
            return []
        left, right = self._groups(a, p), self._groups(b, q)
        out: list[tuple[int, int]] = []
        for g, h, same in [(g, h, g is h) for i, g in enumerate(left) for h in left[i:]] if twin else [(g, h, False) for g in left for h in right]:
            step = max(1, BLOCK // len(h))
            for at in range(0, len(g), step):
                out += self._nodes(g[at : at + step], h[at:] if same else h, same)
        return out

    def _groups(self, tree: CoverTree, p: int) -> list[np.ndarray]:
        """A node's children, or a leaf itself, those of small radius apart: one bound then rules out most pairs of a block."""
        nodes = np.arange(tree.first[p], tree.last[p]) if tree.last[p] > tree.first[p] else np.array([p])
        small = tree.radius[nodes] <= self.reach / 4
        return [g for g in (nodes[small], nodes[~small]) if len(g)]

    def _nodes(self, ps: np.ndarray, qs: np.ndarray, twin: bool) -> list[tuple[int, int]]:
        """Pairs of nodes that are neither too far off nor near as a whole. In a block of twins each pair is seen once."""
        a, b = self.a, self.b
        dot = a.x[a.centre[ps]] @ b.x[b.centre[qs]].T
        self.compared += dot.size
        bound = a.radius[ps].max() + b.radius[qs].max() + self.reach + _EPS
        i, j = np.nonzero(dot >= 1 - min(bound, 2.0) ** 2 / 2 - 1e-12)
        s, t, far = ps[i], qs[j], np.sqrt(np.maximum(2 - 2 * dot[i, j], 0))
        maybe = far <= a.radius[s] + b.radius[t] + self.reach + _EPS
        if twin:
            maybe &= s <= t
        s, t, far, dots = s[maybe], t[maybe], far[maybe], dot[i[maybe], j[maybe]]
        one = (a.hi[s] - a.lo[s] == 1) & (b.hi[t] - b.lo[t] == 1)
        other = (s != t) if twin else np.ones(len(s), bool)
        hit = one & other & (dots >= self.cosine)
        if hit.any():
            self._link(a.centre[s[hit]], b.centre[t[hit]])
        whole = ~one & other & (far + a.radius[s] + b.radius[t] <= self.reach - _EPS)
        for k in np.flatnonzero(whole):
            self._all(int(s[k]), int(t[k]))
        rest = ~one & ~whole
        return list(zip(s[rest].tolist(), t[rest].tolist(), strict=True))

    def _points(self, i: np.ndarray, j: np.ndarray, twin: bool) -> None:
        self.compared += len(i) * len(j)
        hit = self.a.x[i] @ self.b.x[j].T >= self.cosine
        if twin:
            hit = np.triu(hit, 1)
        s, t = np.nonzero(hit)
        if len(s):
            self._link(i[s], j[t])

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.na, i, self.b.weight[j])
        np.add.at(self.nb, j, self.a.weight[i])
        self.edges.append((i, j))

    def _among(self, p: int) -> None:
        """All points of p link with each other."""
        i = np.arange(self.a.lo[p], self.a.hi[p])
        self.na[i] += self.a.weight[i].sum() - self.a.weight[i]
        self.edges.append((i[1:], np.full(len(i) - 1, i[0])))

    def _all(self, p: int, q: int) -> None:
        """Every point of p links with every point of q: counted, not listed."""
        i, j = np.arange(self.a.lo[p], self.a.hi[p]), np.arange(self.b.lo[q], self.b.hi[q])
        self.na[i] += self.b.weight[j].sum()
        self.nb[j] += self.a.weight[i].sum()
        self.edges += [(i, np.full(len(i), j[0])), (np.full(len(j), i[0]), j)]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """(point, least point of its component) over the points of both trees; b's are numbered after a's."""
        shift = 0 if self.same else len(self.a.x)
        label = np.arange(len(self.a.x) + (0 if self.same else len(self.b.x)))
        if not self.edges:
            return label[:0], label[:0]
        i = np.concatenate([e[0] for e in self.edges])
        j = np.concatenate([e[1] for e in self.edges]) + shift
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            for at in (i, j, label[i], label[j]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(label != np.arange(len(label)))
        return at, label[at]


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision, as bytes; vectors with no direction go."""
    for batch in batches:
        every = batch.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(every), 0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            values = every.take(pa.array(rows)).flatten()
            whole = ~np.asarray(values.is_null()).reshape(-1, size).any(axis=1)
            x = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
            top = np.abs(x).max(axis=1)
            ok = whole & np.isfinite(x).all(axis=1) & (top > 0)
            x = x[ok] / top[ok][:, None]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            at = pa.array(rows[ok])
            yield pa.RecordBatch.from_arrays([batch.column("label").take(at), batch.column("vec_id").take(at), pa.array([r.tobytes() for r in x + 0.0], pa.binary())], ["label", "vec_id", "x"])


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell's sample: separated centres, at the first halved radius that gives more than one; a single one where all are as good as equal."""
    for batch in batches:
        out = []
        for rows in batch.column("sample").to_pylist():
            x = _matrix([r["x"] for r in rows])
            reach = _halved(float(_nearest(x, x[:1])[1].max()) + _EPS)
            while len(net := _net(x, 0, reach, FAN)) < 2 and reach > _EPS:
                reach /= 2
            out.append(x[net].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(out, pa.binary())], ["cell", "centres"])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to the nearest of their cell's centres, which come before them (with a null vec_id)."""
    now, centres = None, None
    for batch in batches:
        cells = batch.column("cell").to_pylist()
        blobs, ids = batch.column("x").to_pylist(), batch.column("vec_id").to_pylist()
        i = 0
        while i < len(cells):
            if ids[i] is None:
                now, centres = cells[i], np.frombuffer(blobs[i], np.float64)
                i += 1
                continue
            j = i
            while j < len(cells) and ids[j] is not None and cells[j] == now:
                j += 1
            x = _matrix(blobs[i:j])
            who, far = _nearest(x, centres.reshape(-1, x.shape[1]))
            part, name = batch.slice(i, j - i), now if len(centres) > x.shape[1] else now + DENSE
            yield pa.RecordBatch.from_arrays([part.column("cell"), pa.array([f"{name}.{k}" for k in who]), part.column("vec_id"), part.column("weight"), part.column("x"), pa.array(far)], ["parent", "cell", "vec_id", "weight", "x", "far"])
            i = j


def _survivors(reach: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right")), strict=True):
                dot = _matrix([r["x"] for r in left]) @ _matrix([r["x"] for r in right]).T
                far = np.sqrt(np.maximum(2 - 2 * dot, 0))
                maybe = far <= np.array([r["radius"] for r in left])[:, None] + np.array([r["radius"] for r in right])[None, :] + reach + _EPS
                for i, j in zip(*np.nonzero(maybe), strict=True):
                    if a != b or left[i]["cell"] <= right[j]["cell"]:
                        out_a.append(left[i]["cell"])
                        out_b.append(right[j]["cell"])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.string()), pa.array(out_b, pa.string())], ["a", "b"])

    return work


def _cells(classes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """The upper levels of the trees, as tables: cells of at most CELL vectors, and pairs of cells that may hold links.

    A cell is named by its label, its bytes a vector, and the numbers of the
    centres that it went to. A larger cell is dealt out to separated centres of a sample of it, and the
    radius of each part is measured over all its vectors, so what the radii
    rule out is ruled out for all.
    """
    rows = stash(classes.select(F.concat_ws("/", "label", F.length("x")).alias("cell"), "vec_id", "weight", "x"), "cells")
    pairs = stash(rows.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct(), "pairs")
    balls = None  # radius and centre of every cell that is part of another
    while True:
        large = stash(rows.groupBy("cell").count().where((F.col("count") > CELL) & ~F.col("cell").endswith(f"{DENSE}.0")).select("cell", (1 + F.floor(F.col("count") / SHARE)).alias("shares")), "large")
        if large.isEmpty():
            drop(large, balls)
            return rows, pairs
        order = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id"), "vec_id")
        some = rows.join(large, "cell").select("cell", "vec_id", "x", F.row_number().over(order).alias("n")).where(F.col("n") <= SAMPLE)
        centres = stash(some.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("sample")).transform(arrow(_centres, "cell string, centres binary")), "centres")
        first = centres.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("weight"), F.col("centres").alias("x"))
        then = rows.join(large, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "shares").alias("share"), "vec_id", "weight", "x")
        dealt = first.union(then).repartition("cell", "share").sortWithinPartitions("cell", "share", F.asc_nulls_first("vec_id"))
        dealt = stash(dealt.select("cell", "vec_id", "weight", "x").transform(arrow(_deal, "parent string, cell string, vec_id long, weight long, x binary, far double")), "dealt")
        parts = dealt.groupBy("parent", "cell").agg(F.max("far").alias("radius")).join(centres.withColumnRenamed("cell", "parent"), "parent")
        number = F.element_at(F.split("cell", r"\."), -1).cast("int")
        size = F.element_at(F.split(F.element_at(F.split("cell", "/"), -1), r"\."), 1).cast("int")
        new = parts.select("parent", "cell", "radius", F.substring(F.col("centres"), number * size + 1, size).alias("x"))
        names = pairs.select(F.col("a").alias("cell")).union(pairs.select("b")).distinct().join(large, "cell", "left_anti")
        kept = names.select(F.col("cell").alias("parent"), "cell")
        if balls is not None:
            kept = kept.join(balls.select("cell", "radius", "x"), "cell", "left")
        else:
            kept = kept.withColumn("radius", F.lit(None).cast("double")).withColumn("x", F.lit(None).cast("binary"))
        nodes = stash(new.unionByName(kept), "nodes")
        kids = nodes.groupBy("parent").agg(F.collect_list(F.struct("cell", "radius", "x")).alias("kids"))
        both = pairs.join(kids.select(F.col("parent").alias("a"), F.col("kids").alias("left")), "a").join(kids.select(F.col("parent").alias("b"), F.col("kids").alias("right")), "b")
        whole = (F.size("left") == 1) & F.col("left")[0].x.isNull() & (F.size("right") == 1) & F.col("right")[0].x.isNull()
        next_pairs = both.where(~whole).select("a", "b", "left", "right").transform(arrow(_survivors(reach), "a string, b string")).union(both.where(whole).select("a", "b"))
        next_pairs = stash(next_pairs, "pairs")
        next_rows = stash(rows.join(large, "cell", "left_anti").select("cell", "vec_id", "weight", "x").union(dealt.select("cell", "vec_id", "weight", "x")), "cells")
        drop(large, centres, dealt, rows, pairs, balls)
        rows, pairs, balls = next_rows, next_pairs, nodes


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of each cell, built once."""
    for batch in batches:
        out = []
        for rows in batch.column("rows").to_pylist():
            out.append(pickle.dumps(CoverTree.build(_matrix([r["x"] for r in rows]), np.array([r["vec_id"] for r in rows]), np.array([r["weight"] for r in rows]))))
        yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(out, pa.binary())], ["cell", "tree"])


def _compare(cosine: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, to = [], [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                a = pickle.loads(left)
                b = a if right is None else pickle.loads(right)
                join = Join(a, b, cosine)
                for who, n in [(a.ids, join.na)] if b is a else [(a.ids, join.na), (b.ids, join.nb)]:
                    hit = n > 0
                    ids += who[hit].tolist()
                    counts += n[hit].tolist()
                    to += [None] * int(hit.sum())
                every = a.ids if b is a else np.concatenate([a.ids, b.ids])
                at, root = join.forest()
                ids += every[at].tolist()
                counts += [0] * len(at)
                to += every[root].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(to, pa.int64())], ["vec_id", "n", "other"])

    return work


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Links and components of vectors of the same non-null label whose cosine is at least ``cosine``.

    Equal unit vectors are one class with a weight. Classes of a label with
    more than CELL go down a cover tree whose upper levels are tables: halving
    radii, separated centres, parts ruled out by their measured radii. Each
    cell's own tree is built once; pairs of cells that remain are one unit of
    work each, joined by dual traversal of two trees. Node pairs that are near
    as a whole are counted without listing their pairs, and a unit returns a
    count and at most one connecting edge a vector. Where vectors are far from
    each other in all directions radii rule out little above the leaves, and
    the work grows with the square of a label's classes.

    Labels of any type that has an equality are compared as they are. Returns
    vec_id, n_links, component_id, kept, a row for each input row. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows
    of null label or null vec_id: no links. Vectors of different lengths are
    not compared. Rows that share a vec_id are vectors of their own that share
    its links. Other columns are not read.
    """
    label = F.col("label")
    if dict(vectors.dtypes)["label"] in ("float", "double"):
        label = label + F.lit(0.0)  # a negative zero equals zero
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label.cast("string").alias("label"))
    unit = vectors.where("label is not null and vec_id is not null").select("label", "vec_id", "embedding").transform(arrow(_unit, "label string, vec_id long, x binary"))
    key = ["label", "f1", "f2"]
    member = stash(unit.select("label", "vec_id", F.xxhash64("x").alias("f1"), F.xxhash64(F.lit(7), "x").alias("f2"), "x"), "unit")
    found = member.groupBy(*key).agg(F.min(F.struct("vec_id", "x")).alias("m"), F.count(F.lit(1)).alias("weight"))
    classes = stash(found.select(*key, F.col("m.vec_id").alias("vec_id"), "weight", F.col("m.x").alias("x")), "classes")
    rows, pairs = _cells(classes, math.sqrt(2 - 2 * cosine))
    trees = stash(rows.groupBy("cell").agg(F.collect_list(F.struct("vec_id", "weight", "x")).alias("rows")).transform(arrow(_plant, "cell string, tree binary")), "trees")
    one = pairs.where("a = b").join(trees.withColumnRenamed("cell", "a"), "a").select(F.col("tree").alias("left"), F.lit(None).cast("binary").alias("right"))
    two = pairs.where("a <> b").join(trees.select(F.col("cell").alias("a"), F.col("tree").alias("left")), "a").join(trees.select(F.col("cell").alias("b"), F.col("tree").alias("right")), "b").select("left", "right")
    out = stash(one.union(two).transform(arrow(_compare(cosine), "vec_id long, n long, other long")), "links")
    drop(rows, pairs, trees)
    counts = out.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = components(out.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    classes = classes.select(*key, "vec_id", "weight").join(counts, "vec_id", "left").join(comps.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left")
    classes = classes.select(*key, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    linked = member.select(*key, "vec_id").join(classes, key).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return vectors.select("vec_id").join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
