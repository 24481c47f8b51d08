"""Regression trees, forests and boosting (M2a-M2e) grown by Spark jobs.

One grower serves all presets: a node's split is the one of highest ``SL^2 / (CL + l2) + SR^2 / (CR + l2)`` (S: sum of weight times target, C: of weights),
either over all cut points between neighbouring values, or (extra trees) over one random threshold a feature.

* **Cells.**  A node of more than ``local_rows`` training rows is split by all tasks together: rows are binned at quantiles, each task sums
  weight and target per (tree, node, feature, bin), Spark adds the sums, and the split is read off.  A node of at most ``local_rows`` rows is a cell: its rows
  go to one task, which grows the subtree level by level, all nodes of a level at once.  Many trees share a pass, in both phases.
* **Leaf cap.**  Trees with ``max_leaves`` grow best-first: the open leaf whose split gains most is split next.  A node's split does not depend on the
  order, so trees are grown level by level and cut back by replaying the gains from a priority queue.
* **Draws** (bootstrap weights, row and feature subsets, random thresholds) are hashes of the row's key, the tree and the node's path: they do not depend
  on partitioning, and the two phases draw alike.  ``rows_share`` and ``features_share`` take exactly that share for each tree, by rank of the hash.
* **Boosting** adds trees fitted to what is left of the label; ``depth`` or ``max_leaves`` bound a tree.  With at most ``local_rows`` rows it runs in
  one task, with gradient sums per bin (the larger child's are the parent's less the smaller's); beyond, each round is grown by the pass above.

A model is a table of trees, one row each (arrays of features, thresholds, children, values).  Prediction meets blocks of rows with bundles of trees and adds up.

Rows whose label or a feature is missing take no part in the fit and get NULL as prediction.  The series enters as a feature: its rank by mean label.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

LOCAL_ROWS = 1 << 16
BINS = 256
BUNDLE = 25
BLOCK_ROWS = 1 << 18
TREE = "tree int, node long, feature binary, threshold binary, left binary, value binary, gain binary"
FIELDS = {"feature": "<i4", "threshold": "<f8", "left": "<i4", "value": "<f8", "gain": "<f8"}


@dataclass(frozen=True)
class Spec:
    """What to grow.  ``min_leaf`` and ``min_split``: rows, or a share of the training rows if below 1."""

    trees: int = 1
    depth: int = 64
    max_leaves: int = 0
    min_leaf: float = 1
    min_split: float = 2
    l2: float = 0.0
    bootstrap: bool = False
    rows_share: float = 1.0
    features_share: float = 1.0
    random: bool = False
    boost: float = 0.0  # step size; 0: the mean of the trees
    bins: int = 0  # boosting on binned values; 0: every value
    base: float | None = None  # boosting starts here; None: the mean label
    seed: int = 42

    def sized(self, n: int) -> "Spec":
        count = lambda x: max(1, math.ceil(x * n)) if 0 < x < 1 else max(1, int(x))
        return replace(self, min_leaf=count(self.min_leaf), min_split=max(2, count(self.min_split)))


PRESETS = {
    "DecisionTreeRegressor": Spec(depth=25, min_split=0.018, min_leaf=0.007),
    "RandomForestRegressor": Spec(trees=1000, depth=30, max_leaves=1000, bootstrap=True),
    "BaggingRegressor": Spec(trees=350, rows_share=0.9, features_share=0.7),
    "ExtraTreeRegressor": Spec(random=True),
    "ExtraTreesRegressor": Spec(trees=1000, random=True),
    "GradientBoostingRegressor": Spec(trees=1000, boost=0.01, depth=3),
    "XGBRegressor": Spec(trees=100, boost=0.3, depth=6, l2=1.0, bins=BINS, base=0.5),
    "LGBMRegressor": Spec(trees=1000, boost=0.01, max_leaves=31, min_leaf=20, bins=BINS - 1),
}


# --- hashed draws


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def _draw(a, b: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each ``a`` with ``b``."""
    salt = _mix(np.array([b * 2654435761 + seed * 97 + 1], np.uint64))
    with np.errstate(over="ignore"):
        return _mix(np.atleast_1d(np.asarray(a)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def tree_weights(spec: Spec, rows: np.ndarray, tree: int, cut: int | None = None) -> np.ndarray:
    """How often each row counts in a tree; ``cut``: the last hash that is taken, if only some of all rows are here."""
    h = _draw(rows.view(np.uint64), tree, spec.seed)
    if spec.bootstrap:
        return np.searchsorted(_POISSON, _unit(h), side="right").astype(np.float64)
    if spec.rows_share < 1:
        if cut is None:
            w = np.zeros(len(rows))
            w[np.argsort(h, kind="stable")[: int(spec.rows_share * len(rows))]] = 1.0
            return w
        return (h <= np.uint64(cut)).astype(np.float64)
    return np.ones(len(rows))


def tree_features(spec: Spec, n: int, tree: int) -> np.ndarray:
    """The features a tree may use."""
    if spec.features_share >= 1:
        return np.arange(n)
    return np.sort(np.argsort(_draw(np.arange(n), tree, spec.seed + 1), kind="stable")[: max(1, int(spec.features_share * n))])


def _child(node: np.ndarray, side: int) -> np.ndarray:
    """Names of nodes by their path: 1 is the root."""
    with np.errstate(over="ignore"):
        return _mix(node * np.uint64(2) + np.uint64(side))


ROOT = np.uint64(1)


# --- one tree in one task


def _at(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums before each start."""
    return np.concatenate([[0.0], values])[starts]


def _cuts_of_level(x, w, wy, order, starts, sizes, spec):
    """Per node the best cut of one feature, rows of a node standing in its order: ``(score, threshold)``."""
    xs = x[order]
    cw, cs = np.cumsum(w[order]), np.cumsum(wy[order])
    node = np.repeat(np.arange(len(starts)), sizes)
    ends = starts + sizes
    c0, s0 = _at(cw, starts), _at(cs, starts)
    c, s = _at(cw, ends) - c0, _at(cs, ends) - s0
    cl, sl = cw - c0[node], cs - s0[node]
    at = np.arange(len(xs)) - starts[node] + 1
    ok = np.empty(len(xs), bool)
    ok[:-1] = xs[1:] > xs[:-1]
    ok[ends - 1] = False
    ok &= (at >= spec.min_leaf) & (sizes[node] - at >= spec.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(ok, sl * sl / (cl + spec.l2) + (s[node] - sl) ** 2 / (c[node] - cl + spec.l2), -np.inf)
    best = np.maximum.reduceat(score, starts)
    hits = np.flatnonzero((score == best[node]) & ok)
    first = np.full(len(starts), -1)
    first[node[hits[::-1]]] = hits[::-1]
    low, high = xs[first], xs[np.minimum(first + 1, len(xs) - 1)]
    middle = low + (high - low) / 2
    return best, np.where(middle < high, middle, low)


def _drawn_cut(x, w, wy, order, starts, sizes, spec, names, tree, f):
    """Per node the score of one random threshold of a feature inside the node's range."""
    xs = x[order]
    low, high = np.minimum.reduceat(xs, starts), np.maximum.reduceat(xs, starts)
    cut = drawn_threshold(low, high, names, tree, f, spec)
    left = xs <= np.repeat(cut, sizes)
    add = lambda v: np.add.reduceat(v, starts)
    n, nl = sizes, add(left.astype(np.int64))
    cl, sl = add(w[order] * left), add(wy[order] * left)
    c, s = add(w[order]), add(wy[order])
    ok = (high > low) & (nl >= spec.min_leaf) & (n - nl >= spec.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ok, sl * sl / (cl + spec.l2) + (s - sl) ** 2 / (c - cl + spec.l2), -np.inf), cut


def drawn_threshold(low, high, names, tree, f, spec):
    u = _unit(_draw(names, tree * 4096 + f, spec.seed + 2))
    cut = low + u * (high - low)
    return np.where(cut < high, cut, low)


@dataclass
class Tree:
    """Arrays over nodes: ``left`` is the left child (the right one follows), -1 for a leaf; a row goes left if its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        on = np.flatnonzero(self.left[at] >= 0)
        while len(on):
            a = at[on]
            at[on] = self.left[a] + (x[on, self.feature[a]] > self.threshold[a])
            on = on[self.left[at[on]] >= 0]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.apply(x)]

    def capped(self, leaves: int) -> "Tree":
        """The tree that best-first growth up to ``leaves`` leaves gives."""
        if not leaves or int((self.left >= 0).sum()) < leaves:
            return self
        left, queue, made = np.full(len(self.left), -1), [], 1
        push = lambda i: self.left[i] >= 0 and heapq.heappush(queue, (-self.gain[i], i))
        push(0)
        while queue and made < leaves:
            _, i = heapq.heappop(queue)
            left[i] = self.left[i]
            made += 1
            push(left[i])
            push(left[i] + 1)
        return replace(self, left=left).packed()

    def packed(self) -> "Tree":
        """Without nodes that cannot be reached; children keep standing side by side."""
        keep, at = [0], 0
        new = np.full(len(self.left), -1)
        while at < len(keep):
            i = keep[at]
            at += 1
            if self.left[i] >= 0:
                new[i] = len(keep)
                keep += [int(self.left[i]), int(self.left[i]) + 1]
        k = np.array(keep)
        return Tree(self.feature[k], self.threshold[k], new[k], self.value[k], self.gain[k])

    def blobs(self) -> list[bytes]:
        return [getattr(self, f).astype(t).tobytes() for f, t in FIELDS.items()]

    @staticmethod
    def of(row: dict) -> "Tree":
        return Tree(*(np.frombuffer(row[f], t) for f, t in FIELDS.items()))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, spec: Spec, tree: int, features=None, name: np.uint64 = ROOT, depth: int = 0, orders=None) -> Tree:
    """One tree (or the subtree under the node ``name`` at ``depth``) of the rows with weight; ``spec`` is sized."""
    features = tree_features(spec, x.shape[1], tree) if features is None else features
    on = np.flatnonzero(w > 0)
    middle = float(np.dot(w, y) / w.sum()) if len(on) else 0.0
    wy = w * (y - middle)
    if spec.random:
        orders = [on]
    elif orders is None:
        orders = [on[np.argsort(x[on, f], kind="stable")] for f in features]
    starts, sizes = np.array([0]), np.array([len(on)])
    names = np.array([name], np.uint64)
    out: dict[str, list] = {f: [] for f in FIELDS}
    made = 1
    wyy = wy * (y - middle)
    while len(starts) and len(on):
        order = orders[0]
        add = lambda v: np.add.reduceat(v[order], starts)  # noqa: E731, B023
        c, s, q = add(w), add(wy), add(wyy)
        own = s * s / (c + spec.l2)
        best, cut, feature = np.full(len(starts), -np.inf), np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        if depth < spec.depth:
            for k, f in enumerate(features):
                if spec.random:
                    score, thr = _drawn_cut(x[:, f], w, wy, order, starts, sizes, spec, names, tree, int(f))
                else:
                    score, thr = _cuts_of_level(x[:, f], w, wy, orders[k], starts, sizes, spec)
                more = score > best + 1e-12 * np.abs(np.where(np.isfinite(best), best, 0))  # equal cuts: the first feature
                best[more], cut[more], feature[more] = score[more], thr[more], f
        gain = best - own
        noise = 1e-11 * (np.abs(q) + 1e-300)
        split = (sizes >= spec.min_split) & (q - s * s / c > noise) & np.isfinite(best)
        split &= (gain > noise) if not spec.random else True
        number = np.cumsum(split) - 1
        out["feature"].append(np.where(split, feature, -1))
        out["threshold"].append(cut)
        out["left"].append(np.where(split, made + 2 * number, -1))
        out["value"].append(s / (c + spec.l2) + middle)
        out["gain"].append(np.where(split, gain, 0.0))
        made += 2 * int(split.sum())
        if not split.any():
            break
        node = np.repeat(np.arange(len(starts)), sizes)
        is_right = np.zeros(len(w), bool)
        is_right[order] = x[order, feature[node]] > cut[node]
        lefts = sizes - np.add.reduceat(is_right[order].astype(np.int64), starts)
        kid = np.stack([lefts, sizes - lefts], 1)[split].ravel()
        begin = np.concatenate([[0], np.cumsum(kid)[:-1]])
        base = np.zeros(len(starts), np.int64)
        base[split] = begin[0::2]
        keep = split[node]
        moved = []
        for o in orders:
            r = is_right[o]
            rights = np.cumsum(r)
            before = rights - _at(rights, starts)[node].astype(np.int64)
            place = np.arange(len(o)) - starts[node]
            to = base[node] + np.where(r, lefts[node] + before - 1, place - before)
            new = np.empty(len(begin) and int(kid.sum()), np.int64)
            new[to[keep]] = o[keep]
            moved.append(new)
        orders = moved
        names = np.stack([_child(names[split], 0), _child(names[split], 1)], 1).ravel()
        starts, sizes = begin, kid
        depth += 1
    if not out["left"]:
        return Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([middle]), np.zeros(1))
    return Tree(*(np.concatenate(out[f]) for f in FIELDS)).capped(spec.max_leaves)


# --- boosting in one task


def _bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points per feature: between all values, or between values at even ranks if there are more than ``bins``."""
    out = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        if len(v) > bins:
            s = np.sort(x[:, f])
            v = np.unique(s[np.linspace(0, len(s) - 1, bins).astype(int)])
        out.append(v[:-1] + (v[1:] - v[:-1]) / 2)
    return out


def _grow_binned(codes: np.ndarray, edges: list[np.ndarray], width: int, y: np.ndarray, spec: Spec) -> tuple[Tree, np.ndarray]:
    """A tree from sums per bin, and each row's value in it.  Leaves are split by gain, the largest first; the sums of a
    larger child are those of its parent less the smaller's."""
    n, nf = codes.shape
    flat = codes + np.arange(nf) * width

    def sums(rows):
        at = flat[rows].ravel()
        return np.bincount(at, np.repeat(y[rows], nf), nf * width), np.bincount(at, minlength=nf * width)

    def best(s, c):
        total, count = s[:width].sum(), c[:width].sum()
        sl, cl = np.cumsum(s.reshape(nf, width), 1), np.cumsum(c.reshape(nf, width), 1)
        sr, cr = total - sl, count - cl
        ok = (cl >= spec.min_leaf) & (cr >= spec.min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(ok, sl * sl / (cl + spec.l2) + sr * sr / (cr + spec.l2), -np.inf)
        i = int(np.argmax(score))
        return score.flat[i] - total * total / (count + spec.l2), divmod(i, width), total / (count + spec.l2)

    nodes = {f: [] for f in FIELDS}
    leaf_rows: dict[int, np.ndarray] = {}
    queue: list = []

    def add(rows, s, c, depth):
        i = len(nodes["left"])
        gain, (f, b), value = best(s, c)
        for k, v in zip(FIELDS, (-1, 0.0, -1, value, 0.0)):
            nodes[k].append(v)
        leaf_rows[i] = rows
        if depth < spec.depth and len(rows) >= spec.min_split and gain > 1e-12:
            heapq.heappush(queue, (-gain, i, f, b, s, c, depth))

    add(np.arange(n), *sums(np.arange(n)), 0)
    leaves, most = 1, spec.max_leaves or n
    while queue and leaves < most:
        gain, i, f, b, s, c, depth = heapq.heappop(queue)
        rows = leaf_rows.pop(i)
        right = codes[rows, f] > b
        a, z = rows[~right], rows[right]
        small = a if len(a) <= len(z) else z
        s1, c1 = sums(small)
        pair = ((s1, c1), (s - s1, c - c1))
        pair = pair if small is a else pair[::-1]
        nodes["feature"][i], nodes["threshold"][i], nodes["left"][i], nodes["gain"][i] = f, edges[f][b], len(nodes["left"]), -gain
        add(a, *pair[0], depth + 1)
        add(z, *pair[1], depth + 1)
        leaves += 1
    out = np.empty(n)
    for i, rows in leaf_rows.items():
        out[rows] = nodes["value"][i]
    return Tree(*(np.array(nodes[f]) for f in FIELDS)), out


def boost(x: np.ndarray, y: np.ndarray, spec: Spec) -> list[Tree]:
    """The trees of a boosting run; ``spec`` is sized.  The first one is the start value."""
    start = float(y.mean()) if spec.base is None else spec.base
    out = [Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([start / spec.boost]), np.zeros(1))]
    left = y - start
    if spec.bins:
        edges = _bin_edges(x, spec.bins)
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        width = max(len(e) for e in edges) + 1
    else:
        orders, w = [np.argsort(x[:, f], kind="stable") for f in range(x.shape[1])], np.ones(len(y))
    for k in range(spec.trees):
        if spec.bins:
            t, p = _grow_binned(codes, edges, width, left, spec)
        else:
            t = grow(x, left, w, spec, k, orders=orders)
            p = t.predict(x)
        left = left - spec.boost * p
        out.append(t)
    return out


# --- Spark side


def _pack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = batch.column(0).to_numpy()
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return rows, x, batch.column(2).to_numpy()


CELL = "lo int, hi int, node long, rows binary, x binary, y binary"


def _cell(lo, hi, node, rows, x, y):
    return pa.record_batch([pa.array([v], t) for v, t in ((lo, pa.int32()), (hi, pa.int32()), (node, pa.int64()), (rows.tobytes(), pa.binary()), (np.ascontiguousarray(x).tobytes(), pa.binary()), (y.tobytes(), pa.binary()))], names=["lo", "hi", "node", "rows", "x", "y"])


def _whole(spans):
    """All rows to each span of trees."""

    def run(batches):
        for batch in batches:
            for lo, hi in spans:
                yield _cell(lo, hi, 0, *_pack(batch))

    return run


def _deal(tops):
    """Each tree's rows to the cells under its top."""

    def run(batches):
        for batch in batches:
            rows, x, y = _pack(batch)
            for tree, top in tops.value.items():
                leaf = top.tree().apply(x)
                for i in np.unique(leaf):
                    if top.open[i]:
                        on = leaf == i
                        yield _cell(tree, tree + 1, int(i), rows[on], x[on], y[on])

    return run


def _grow_cells(spec: Spec, tops=None):
    def run(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t.column("rows").to_pylist()), np.int64)
        y = np.frombuffer(b"".join(t.column("y").to_pylist()), np.float64)
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(rows), -1)
        order = np.lexsort([y, rows])  # the same rows in the same order whatever the partitions
        rows, x, y = rows[order], x[order], y[order]
        lo, hi, node = (t.column(c)[0].as_py() for c in ("lo", "hi", "node"))
        made = []
        if spec.boost:
            made = [(k, b) for k, b in enumerate(boost(x, y, spec))]
        else:
            for tree in range(lo, hi):
                top = tops.value[tree] if tops else None
                w = tree_weights(spec, rows, tree, top.cut if top else None)
                where = {"name": top.names[node], "depth": top.depths[node]} if top else {}
                made.append((tree, grow(x, y, w, spec, tree, **where)))
        cols = list(zip(*(m[1].blobs() for m in made)))
        return pa.table([pa.array([m[0] for m in made], pa.int32()), pa.array([node] * len(made)), *[pa.array(c, pa.binary()) for c in cols]], names=["tree", "node", *FIELDS])

    return run


@dataclass
class Top:
    """The part of a tree that all tasks grow together.  ``open``: 1 for leaves still to grow (in a cell, or here)."""

    names: list = field(default_factory=lambda: [ROOT])
    depths: list = field(default_factory=lambda: [0])
    feature: list = field(default_factory=lambda: [-1])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    open: list = field(default_factory=lambda: [1])
    todo: list = field(default_factory=lambda: [0])
    cut: int | None = None

    def tree(self) -> Tree:
        return Tree(*(np.array(getattr(self, f)) for f in FIELDS))

    def split(self, i: int, r: dict, spec: Spec, local_rows: int) -> None:
        """Split node ``i`` as the row ``r`` says; children of over ``local_rows`` rows are to be split here too."""
        self.value[i], self.open[i] = r["value"], 0
        if r["feature"] < 0:
            return
        self.feature[i], self.threshold[i], self.gain[i], self.left[i] = r["feature"], r["threshold"], r["gain"], len(self.left)
        for side, n, v in ((0, r["nl"], r["vl"]), (1, r["n"] - r["nl"], r["vr"])):
            at = len(self.left)
            self.names.append(_child(np.array([self.names[i]], np.uint64), side)[0])
            self.depths.append(self.depths[i] + 1)
            for f, x in (("feature", -1), ("threshold", 0.0), ("left", -1), ("value", v), ("gain", 0.0)):
                getattr(self, f).append(x)
            grows = self.depths[at] < spec.depth and n >= spec.min_split
            self.open.append(int(grows))
            if grows and n > local_rows:
                self.todo.append(at)


def _ranges(tops, spec: Spec):
    """Least and largest value per (tree, node, feature) of the nodes to split."""

    def run(batches):
        for batch in batches:
            rows, x, y = _pack(batch)
            for tree, top in tops.value.items():
                w = tree_weights(spec, rows, tree, top.cut)
                leaf = np.where(w > 0, top.tree().apply(x), -1)
                for i in top.todo:
                    v = x[leaf == i]
                    if len(v):
                        f = x.shape[1]
                        yield pa.record_batch([pa.array(np.full(f, tree, np.int32)), pa.array(np.full(f, i, np.int64)), pa.array(np.arange(f, dtype=np.int32)), pa.array(v.min(0)), pa.array(v.max(0))], names=["tree", "node", "feature", "low", "high"])

    return run


def _sums(tops, edges, spec: Spec, middle: float):
    """Rows, weight, target and its square per (tree, node, feature, bin) of the nodes to split."""

    def run(batches):
        e = edges.value
        for batch in batches:
            rows, x, y = _pack(batch)
            y = y - middle
            codes = None if spec.random else [np.searchsorted(e[f], x[:, f], side="left") for f in range(x.shape[1])]
            for tree, top in tops.value.items():
                w = tree_weights(spec, rows, tree, top.cut)
                leaf = np.where(w > 0, top.tree().apply(x), -1)
                for i in top.todo:
                    on = np.flatnonzero(leaf == i)
                    if not len(on):
                        continue
                    for f in tree_features(spec, x.shape[1], tree):
                        code = (x[on, f] > e[tree, i][f]).astype(np.int64) if spec.random else codes[f][on]
                        add = lambda v: np.bincount(code, v)  # noqa: E731, B023
                        n = np.bincount(code)
                        at = np.flatnonzero(n)
                        k = len(at)
                        cols = [np.full(k, tree, np.int32), np.full(k, i, np.int64), np.full(k, f, np.int32), at, n[at], add(w[on])[at], add(w[on] * y[on])[at], add(w[on] * y[on] ** 2)[at]]
                        yield pa.record_batch([pa.array(c) for c in cols], names=["tree", "node", "feature", "bin", "n", "c", "s", "q"])

    return run


SPLIT = "tree int, node long, feature int, bin long, gain double, value double, n long, nl long, vl double, vr double"


def _best(spec: Spec, middle: float):
    """The best split of a node from its sums per bin (feature -1: a leaf)."""

    def run(t: pa.Table) -> pa.Table:
        d = {c: t.column(c).to_numpy() for c in ("feature", "bin", "n", "c", "s", "q")}
        order = np.lexsort([d["bin"], d["feature"]])
        d = {c: v[order] for c, v in d.items()}
        one = d["feature"] == d["feature"][0]
        n, c, s, q = (d[k][one].sum() for k in "ncsq")
        best = (-np.inf, -1, 0, 0, 0.0, 0.0)
        for f in np.unique(d["feature"]):
            on = d["feature"] == f
            nl, cl, sl = (np.cumsum(d[k][on]) for k in "ncs")
            ok = (nl >= spec.min_leaf) & (n - nl >= spec.min_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(ok, sl * sl / (cl + spec.l2) + (s - sl) ** 2 / (c - cl + spec.l2), -np.inf)
            i = int(np.argmax(score))
            if score[i] > best[0] + 1e-12 * abs(best[0] if np.isfinite(best[0]) else 0):
                best = (float(score[i]), int(f), int(d["bin"][on][i]), int(nl[i]), sl[i] / (cl[i] + spec.l2), (s - sl[i]) / (c - cl[i] + spec.l2))
        gain = best[0] - s * s / (c + spec.l2)
        if not (np.isfinite(gain) and n >= spec.min_split and q - s * s / c > 1e-11 * q and (spec.random or gain > 1e-11 * q)):
            best, gain = (0, -1, 0, 0, 0.0, 0.0), 0.0
        vals = [t.column("tree")[0].as_py(), t.column("node")[0].as_py(), best[1], best[2], float(gain), float(s / (c + spec.l2) + middle), int(n), best[3], best[4] + middle, best[5] + middle]
        names = ["tree", "node", "feature", "bin", "gain", "value", "n", "nl", "vl", "vr"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array([v], k) for v, k in zip(vals, kinds)], names=names)

    return run


def _row_cuts(rows: DataFrame, spec: Spec, trees: range, n: int) -> dict[int, int]:
    """For each tree the hash of its last row, if it takes a share of all: sixteen bits a pass, by counts."""
    want = {t: int(spec.rows_share * n) for t in trees}
    known = {t: 0 for t in trees}
    for shift in (48, 32, 16, 0):

        def count(batches, shift=shift, known=dict(known)):  # noqa: B006
            for batch in batches:
                for t, high in known.items():
                    h = _draw(batch.column(0).to_numpy().view(np.uint64), t, spec.seed)
                    on = h if shift == 48 else h[h >> np.uint64(shift + 16) == np.uint64(high)]
                    part, k = np.unique((on >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(k), t, np.int32)), pa.array(part.astype(np.int64)), pa.array(k)], names=["tree", "part", "k"])

        got = rows.select("row").mapInArrow(count, "tree int, part long, k long").groupBy("tree", "part").agg(F.sum("k").alias("k"))
        run = got.withColumn("upto", F.sum("k").over(Window.partitionBy("tree").orderBy("part")))
        goal = F.create_map(*[F.lit(v) for t in trees for v in (t, want[t])])[F.col("tree")]
        for r in run.where((F.col("upto") >= goal) & (F.col("upto") - F.col("k") < goal)).collect():
            known[r["tree"]] = known[r["tree"]] << 16 | r["part"]
            want[r["tree"]] -= r["upto"] - r["k"]
    return known


def _grow_tops(rows: DataFrame, spec: Spec, trees: range, n: int, nf: int, local_rows: int, bins: int, whole: bool) -> dict[int, Top]:
    """The tops of some trees: every node of over ``local_rows`` rows is split by sums over all tasks."""
    spark = rows.sparkSession
    tops = {t: Top() for t in trees}
    if spec.rows_share < 1:
        for t, cut in _row_cuts(rows, spec, trees, n).items():
            tops[t].cut = cut
    middle = rows.agg(F.avg("y")).first()[0]
    edges: dict = {}
    if not spec.random:
        cols = [F.col("x")[f].alias(f"f{f}") for f in range(nf)]
        at = [i / bins for i in range(1, bins)]
        edges = {f: np.unique(q) for f, q in enumerate(rows.select(*cols).approxQuantile([f"f{f}" for f in range(nf)], at, 1 / (8 * bins)))}
    while any(t.todo for t in tops.values()):
        sent = spark.sparkContext.broadcast({k: t for k, t in tops.items() if t.todo})
        if spec.random:
            low = rows.mapInArrow(_ranges(sent, spec), "tree int, node long, feature int, low double, high double").groupBy("tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            edges = {}
            for r in low.collect():
                name = np.array([tops[r["tree"]].names[r["node"]]], np.uint64)
                edges.setdefault((r["tree"], r["node"]), np.zeros(nf))[r["feature"]] = drawn_threshold(np.array([r["low"]]), np.array([r["high"]]), name, r["tree"], r["feature"], spec)[0]
        cuts = spark.sparkContext.broadcast(edges)
        sums = rows.mapInArrow(_sums(sent, cuts, spec, middle), "tree int, node long, feature int, bin long, n long, c double, s double, q double")
        sums = sums.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ncsq"])
        splits = sums.groupBy("tree", "node").applyInArrow(_best(spec, middle), SPLIT).collect()
        for t in tops.values():
            t.todo = []
        for r in sorted(splits, key=lambda r: (r["tree"], r["node"])):
            f, b = r["feature"], r["bin"]
            thr = 0.0 if f < 0 else float(edges[r["tree"], r["node"]][f] if spec.random else edges[f][b])
            tops[r["tree"]].split(r["node"], {**r.asDict(), "threshold": thr}, spec, 0 if whole else local_rows)
        sent.unpersist()
        cuts.unpersist()
    return tops


def _join_cells(tops, max_leaves: int):
    """A tree's top with its cells' subtrees in their places, cut back to ``max_leaves``."""

    def run(t: pa.Table) -> pa.Table:
        tree = t.column("tree")[0].as_py()
        top = tops.value[tree].tree()
        parts = {f: [getattr(top, f)] for f in FIELDS}
        size = len(top.left)
        for r in sorted(t.to_pylist(), key=lambda r: r["node"]):
            sub, i = Tree.of(r), r["node"]
            for f in ("feature", "threshold", "value", "gain"):
                parts[f][0][i] = getattr(sub, f)[0]
                parts[f].append(getattr(sub, f)[1:])
            moved = np.where(sub.left >= 0, sub.left - 1 + size, -1)
            parts["left"][0][i] = moved[0]
            parts["left"].append(moved[1:])
            size += len(sub.left) - 1
        whole = Tree(*(np.concatenate(parts[f]) for f in FIELDS)).capped(max_leaves)
        return pa.table([pa.array([tree], pa.int32()), pa.array([0], pa.int64()), *[pa.array([b], pa.binary()) for b in whole.blobs()]], names=["tree", "node", *FIELDS])

    return run


def _add_trees():
    """The sum of a bundle's trees for a block of rows."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(rows.column("rows").to_pylist()), np.int64)
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
        total = np.zeros(len(ids))
        for r in sorted(trees.to_pylist(), key=lambda r: r["tree"]):
            total += Tree.of(r).predict(x)
        return pa.table([pa.array(ids), pa.array(total)], names=["row", "total"])

    return run


class TreeModel:
    """A model of trees over the rows of all series; same methods as :class:`panelcast.models.ml.Pooled`."""

    def __init__(self, spec: Spec, features: Sequence[str], label: str, series_col: str | None = None, key_cols: Sequence[str] = (), out: str = "y_pred", local_rows: int = LOCAL_ROWS, bins: int = BINS):
        self.spec, self.features, self.label, self.series_col, self.key_cols, self.out = spec, list(features), label, series_col, list(key_cols), out
        self.local_rows, self.bins = local_rows, bins
        self.trees: DataFrame | None = None
        self.ranks: DataFrame | None = None

    def _inputs(self, df: DataFrame) -> DataFrame:
        """``df`` with the features as one array ``x``, NULL if one is missing."""
        cols = [F.col(f).cast("double") for f in self.features]
        if self.series_col:
            df = df.join(self.ranks, self.series_col, "left")
            cols.append(F.coalesce(F.col("__rank"), F.lit(-1.0)))
        x = F.array(*cols)
        known = F.lit(True)
        for f in self.features:
            known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
        return df.withColumn("__x", F.when(known, x)).drop("__rank")

    def fit(self, df: DataFrame) -> "TreeModel":
        ensure_checkpoint_dir(df.sparkSession)
        spark = df.sparkSession
        df = df.where(F.col(self.label).isNotNull() & ~F.isnan(F.col(self.label).cast("double")))
        if self.series_col:
            means = df.groupBy(self.series_col).agg(F.avg(self.label).alias("__mean")).withColumn("__one", F.lit(1))
            # one row a series
            rank = F.row_number().over(Window.partitionBy("__one").orderBy("__mean", self.series_col)).cast("double")
            self.ranks = means.withColumn("__rank", rank).select(self.series_col, "__rank").checkpoint()
        keys = self.key_cols or [c for c in df.columns]
        rows = self._inputs(df).where("__x IS NOT NULL").select(F.xxhash64(*keys).alias("row"), F.col("__x").alias("x"), F.col(self.label).cast("double").alias("y")).checkpoint()
        n = rows.count()
        if not n:
            raise ValueError("no complete training rows")
        spec, nf = self.spec.sized(n), len(self.features) + bool(self.series_col)
        if n <= self.local_rows:
            spans = [(0, spec.trees)] if spec.boost else [(a, min(a + BUNDLE, spec.trees)) for a in range(0, spec.trees, BUNDLE)]
            cells = rows.mapInArrow(_whole(spans), CELL).repartition(min(4 * len(spans), 2000), "lo")
            self.trees = cells.groupBy("lo", "hi", "node").applyInArrow(_grow_cells(spec), TREE).checkpoint()
        elif spec.boost:
            self.trees = self._boost(rows, spec, n, nf).checkpoint()
        else:
            parts = [self._grow(rows, spec, range(a, min(a + BUNDLE, spec.trees)), n, nf) for a in range(0, spec.trees, BUNDLE)]
            for p in parts[1:]:
                parts[0] = parts[0].unionAll(p)
            self.trees = parts[0]
        return self

    def _grow(self, rows, spec, trees, n, nf, whole: bool = False) -> DataFrame:
        tops = _grow_tops(rows, spec, trees, n, nf, self.local_rows, self.bins, whole)
        spark = rows.sparkSession
        if whole:
            made = [t.tree().capped(spec.max_leaves) for t in tops.values()]
            return spark.createDataFrame([(k, 0, *(bytearray(b) for b in m.blobs())) for k, m in zip(trees, made)], TREE)
        sent = spark.sparkContext.broadcast(tops)
        cells = rows.mapInArrow(_deal(sent), CELL).groupBy("lo", "hi", "node").applyInArrow(_grow_cells(spec, sent), TREE)
        ended = [(k, 0, *(bytearray(b) for b in t.tree().capped(spec.max_leaves).blobs())) for k, t in tops.items() if not any(t.open)]
        if ended:  # trees without a cell
            cells = cells.where(~F.col("tree").isin([e[0] for e in ended]))
            return cells.groupBy("tree").applyInArrow(_join_cells(sent, spec.max_leaves), TREE).unionAll(spark.createDataFrame(ended, TREE)).checkpoint()
        return cells.groupBy("tree").applyInArrow(_join_cells(sent, spec.max_leaves), TREE).checkpoint()

    def _boost(self, rows, spec, n, nf) -> DataFrame:
        """Boosting rounds over all tasks: each grows one tree by sums per bin and lowers what is left of the label."""
        spark = rows.sparkSession
        start = rows.agg(F.avg("y")).first()[0] if spec.base is None else spec.base
        first = Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([start / spec.boost]), np.zeros(1))
        made, left = [first], rows.withColumn("y", F.col("y") - F.lit(float(start)))
        for k in range(spec.trees):
            tree = Tree.of(self._grow(left, spec, range(1), n, nf, whole=True).first().asDict())
            made.append(tree)
            sent = spark.sparkContext.broadcast(tree)

            def lower(batches, sent=sent):
                for batch in batches:
                    r, x, y = _pack(batch)
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(y - spec.boost * sent.value.predict(x))], names=["row", "x", "y"])

            left = left.mapInArrow(lower, "row long, x array<double>, y double").checkpoint()
        return spark.createDataFrame([(k, 0, *(bytearray(b) for b in m.blobs())) for k, m in enumerate(made)], TREE)

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row of ``df`` with its prediction."""
        ensure_checkpoint_dir(df.sparkSession)
        rows = self._inputs(df).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
        blocks = max(1, -(-rows.count() // BLOCK_ROWS))
        bundles = max(1, -(-(self.spec.trees + 1) // (4 * BUNDLE)))

        def pack(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                block = ids % blocks
                for b in np.unique(block):
                    on = block == b
                    for k in range(bundles):
                        yield pa.record_batch([pa.array([int(b)]), pa.array([k]), pa.array([ids[on].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x[on]).tobytes()], pa.binary())], names=["block", "bundle", "rows", "x"])

        packed = rows.where("__x IS NOT NULL").select("__id", "__x").mapInArrow(pack, "block long, bundle long, rows binary, x binary")
        trees = self.trees.withColumn("bundle", F.pmod(F.col("tree"), F.lit(bundles)).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        sums = packed.groupBy("block", "bundle").cogroup(trees.groupBy("block", "bundle")).applyInArrow(_add_trees(), "row long, total double")
        scale = self.spec.boost or 1.0 / self.spec.trees
        got = sums.groupBy("row").agg((F.sum("total") * F.lit(scale)).alias(self.out))
        return rows.join(got, F.col("__id") == F.col("row"), "left").drop("__id", "row", "__x")

    def save(self, path: str) -> None:
        """IO6: one saved version."""
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        if self.ranks is not None:
            self.ranks.write.mode("overwrite").parquet(f"{path}/ranks")

    def load(self, spark, path: str) -> "TreeModel":
        """The saved version at ``path`` in this model's place."""
        self.trees = spark.read.parquet(f"{path}/trees")
        self.ranks = spark.read.parquet(f"{path}/ranks") if self.series_col else None
        return self


class Chain:
    """Boosted models fitted one after the other, each to what those before it leave of the label; their sum predicts.  ``unfitted`` makes the next one."""

    def __init__(self, unfitted):
        self.unfitted, self.models = unfitted, []

    def fit(self, df: DataFrame) -> "Chain":
        m = self.unfitted()
        if self.models:
            m.spec = replace(m.spec, base=0.0)
            df = self.transform(df, "__sofar").withColumn(m.label, F.col(m.label) - F.col("__sofar")).drop("__sofar")
        self.models.append(m.fit(df))
        return self

    def transform(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        total = F.lit(0.0)
        for i, m in enumerate(self.models):
            df = m.transform(df).withColumnRenamed(m.out, f"__p{i}")
            total = total + F.col(f"__p{i}")
        return df.withColumn(out, total).drop(*[f"__p{i}" for i in range(len(self.models))])
