"""Random forests of unlimited depth (M2, M6, M7), grown as PLANET does (Panda et al., 2009).

A tree grown until its leaves are pure has about as many nodes as rows, and its
lower levels are many small nodes.  Passing over all rows once a level, as a
level-wise learner does, wastes nearly all of that work.  Here:

1. *Bootstrap.*  How often a row is drawn for a tree is a Poisson(1) number from
   a hash of (row key, tree): the same in every pass, whatever the layout.
2. *Top.*  Nodes of more than a bounded number of drawn rows are split level by
   level over all of their rows.  Each feature's rows are stored once, sorted
   and cut into chunks (as SPRINT's attribute lists, Shafer et al., 1996); per
   level one pass finds the nodes' labels, one the sums of every chunk, and one
   the best cut of every chunk, given the sums of the chunks before it.
3. *Parts.*  One pass sends every drawn row to its part; ``(tree, part)``
   groups of a bounded size are grown to purity, all in parallel.
4. *Model.*  The forest is a table with one row per (tree, part), its nodes
   packed in arrays: it is never gathered.  Scoring broadcasts a forest of at
   most :data:`BLOCK_BYTES`; with a larger one the rows go to the parts they
   end in, or, where that moves more bytes, pass by one block after another.

Rows of at most :data:`WHOLE_BYTES` are broadcast instead, and each task grows
whole trees from them: steps 2 and 3 need no shuffle then.  Both ways try every
cut on every row of a node and name a node by its way from the root, so they
grow the same trees: the size decides where the work is done, not what comes out.

A split is the best of all thresholds between two neighbouring values (variance
reduction, which for 0/1 labels is the Gini criterion); ``x <= threshold`` goes
left, so NaN goes right.  A node ends when its labels are equal but for
rounding, no feature tells its rows apart, or ``max_depth`` is reached.  A
quotient that is the same for many rows differs in its last bits: splitting
those would chain thousands of levels for predictions that are equal in 14
digits (scikit-learn ends such nodes, too).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolake.session import scratch_path

# the tasks run this module's kernels: see isolation.py
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a part of a tree holds at most so many drawn rows where a task grows whole trees ...
SMALL = 32_768
#: ... and so many times as many where the rows are sent to it: fewer levels pass over all rows
SENT = 16
#: rows (key, features, label) that are broadcast, in bytes
WHOLE_BYTES = 64 << 20
#: rows of a chunk of a sorted feature
CHUNK = 131_072
#: sums of chunks that the driver holds at once, in bytes
TOP_BYTES = 48 << 20
#: nodes that are broadcast at once, in bytes
BLOCK_BYTES = 256 << 20
#: bytes of a node that scoring needs: feature, threshold or value, left child
NODE_BYTES = 13
#: rows that are hashed or walk down a tree together
WALK = 8192
#: rows (and bytes of them) that a task routes or scores at once, so that a part's share of them is not a few rows
ROUTE_ROWS, ROUTE_BYTES = 1 << 17, 64 << 20
#: rows whose scores by many trees are summed together: 2 to this power
HOME = 13

PART_SCHEMA = ("tree int, part int, n_nodes long, feature binary, threshold binary, child binary, value binary, "
               "size binary, depth int")
NODE_SCHEMA = "tree int, part int, node int, feature int, threshold double, left int, right int, value double, size long"
LEAF, HANDED = -1, -2
#: gains that differ by rounding only are equal: the first feature and the lowest threshold win
TIE = 1.0 - 1e-9
#: labels that differ by at most so many units of their last bit are equal but for rounding
ROUNDING = 8


# -- hashing ------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finalizer), in place."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x


def _unit(key: np.ndarray, tree: int, seed: int, salt: int) -> np.ndarray:
    """A uniform number of [0, 1) for each key."""
    step = np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + salt * 0x8CB92BA72F3D8DD7) % (1 << 64))
    out = np.empty(len(key))
    for i in range(0, len(key), WALK):      # pieces that stay in a core's cache
        with np.errstate(over="ignore"):
            h = _mix(_mix(key[i:i + WALK].view(np.uint64) + step))
        h >>= np.uint64(11)
        out[i:i + WALK] = h
    out /= float(1 << 53)
    return out


# P(draws <= k) of a Poisson(1) number; beyond 12 the chance is under 1e-10
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 13.0)]))


def draws(key: np.ndarray, tree: int, seed: int | None) -> np.ndarray:
    """How often each row is drawn for a tree (no seed: once)."""
    if seed is None:
        return np.ones(len(key), np.uint8)
    u = _unit(key, tree, seed, 1)
    w = np.zeros(len(key), np.uint8)
    for p in _POISSON:
        more = u >= p
        if not more.any():
            break
        w += more
    return w


def _root(seed: int, tree: int) -> int:
    """The name of a tree's root."""
    return int(_mix(np.array([(seed * 0xD1B54A32D192ED03 + (tree + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])


def _kids(names: np.ndarray) -> np.ndarray:
    """The names of the left children, then of the right ones: a node's name tells the way to it from its root."""
    with np.errstate(over="ignore"):
        return _mix(np.concatenate([names + np.uint64(0x8CB92BA72F3D8DD7), names + np.uint64(0xD1B54A32D192ED03)]))


# -- growing a part -----------------------------------------------------------
@dataclass
class Nodes:
    """A (part of a) tree; the right child follows the left one."""

    feature: np.ndarray    # int8: LEAF, HANDED or the feature
    threshold: np.ndarray  # float64; a LEAF's value
    child: np.ndarray      # int32: the left child, or the part a HANDED node is grown in
    value: np.ndarray      # float64: the weighted mean label
    size: np.ndarray       # int64: drawn rows
    depth: int


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None = None, tries: int | None = None,
         root: int = 0, stop_size: float = 0.0) -> Nodes:
    """One tree over rows ``x`` drawn ``w`` times, level by level, all nodes of a level at once.

    Each feature's rows stay sorted by (node, value): a split is a stable
    partition of that order, so that nothing is sorted after the root.  Rows of
    a node that ends leave the orders before they are partitioned.
    ``tries`` features that can split are picked per node by a hash of its name
    (None: all); ``root`` is the first node's.  With ``stop_size``, nodes of at
    most so many drawn rows are left open (HANDED).
    """
    k = x.shape[1]
    w = w.astype(float)
    feature, threshold, child, value, size = [], [], [], [], []
    xf = [np.ascontiguousarray(x[:, f]) for f in range(k)]
    flat = np.ascontiguousarray(x).ravel()
    order = _orders(xf, tries)
    rows = order[0]                        # the level's rows, node after node
    count = np.array([len(y)], np.int64)   # rows per node, in that layout
    place = np.array([0])                  # the node's number within its level
    name = np.array([root], np.uint64)
    base = 0                               # id of the level's first node
    level = 0
    side = np.zeros(len(y), np.uint8)      # 1 left, 2 right, 0 in a node that ended
    z = w + 0j                             # the weight, and the weighted distance from the node's mean: summed at once
    while True:
        m = len(count)
        start = np.r_[0, np.cumsum(count)[:-1]]
        wr, yr = w.take(rows), y.take(rows)
        total = np.add.reduceat(wr, start)
        mean = np.add.reduceat(wr * yr, start) / total
        low, high = np.minimum.reduceat(yr, start), np.maximum.reduceat(yr, start)
        same = low == high
        mean[same] = low[same]
        pure = _pure(low, high)
        handed = np.zeros(m, bool)
        if stop_size:
            handed = ~pure & (total <= stop_size)
        ended = pure | handed
        if max_depth is not None and level >= max_depth:
            ended = np.ones(m, bool)
            handed[:] = False
        feat = np.full(m, LEAF, np.int8)
        thr = np.zeros(m)
        on = np.flatnonzero(~ended)
        if len(on):
            if len(on) < m:
                keep = np.repeat(~ended, count)
                side[rows.take(np.flatnonzero(~keep))] = 0
                keep = np.flatnonzero(keep)
                rows, wr, yr = rows.take(keep), wr.take(keep), yr.take(keep)
            order[0] = rows
            if level:
                for f in range(1, k):
                    if order[f] is not None:
                        s = side.take(order[f])
                        order[f] = order[f].take(np.concatenate([np.flatnonzero(s == 1), np.flatnonzero(s == 2)]))
            c = count[on]
            start = np.r_[0, np.cumsum(c)[:-1]]
            seg = np.repeat(np.arange(len(on)), c)
            # labels from the node's lowest on, in units of about the node's range, so that sums are as exact in a node of
            # labels that hardly differ as in any other (a power of two: nothing is rounded)
            unit = _label_unit(low[on], high[on])
            yr -= low[on].take(seg)
            yr *= unit.take(seg)
            yr -= (np.add.reduceat(wr * yr, start) / total[on]).take(seg)
            yr *= wr
            z.imag[rows] = yr
            gains, cuts = _best_cuts(xf, order, z, start, c, seg, total[on], name[on], tries)
            best_f, can = _best_features(gains)
            cols = np.arange(len(on))
            feat[on[can]] = best_f[can]
            thr[on[can]] = cuts[best_f, cols][can]
        thr[feat == LEAF] = mean[feat == LEAF]
        feat[handed] = HANDED
        split = feat >= 0
        n_split = int(split.sum())
        flag = np.zeros(m, np.int64)
        flag[place] = split
        kids = np.where(flag > 0, base + m + 2 * (np.cumsum(flag) - 1), -1)
        level_out = [np.empty_like(a) for a in (feat, thr, mean, total)]
        for to, a in zip(level_out, (feat, thr, mean, total)):
            to[place] = a
        feature.append(level_out[0]), threshold.append(level_out[1]), child.append(kids)
        value.append(level_out[2]), size.append(level_out[3])
        if not n_split:
            break
        if not can.all():
            keep = can.take(seg)
            side[rows.take(np.flatnonzero(~keep))] = 0
            keep = np.flatnonzero(keep)
            rows, seg = rows.take(keep), seg.take(keep)
        cell = rows * k
        cell += feat[on].astype(np.int64).take(seg)
        go_left = flat.take(cell) <= thr[on].take(seg)
        side[rows] = 2 - go_left.view(np.uint8)
        lefts = np.flatnonzero(go_left)
        n_left = np.bincount(seg.take(lefts), minlength=len(on))[can]
        rows = rows.take(np.concatenate([lefts, np.flatnonzero(~go_left)]))
        first = kids[place[split]] - base - m
        count, place = np.concatenate([n_left, c[can] - n_left]), np.concatenate([first, first + 1])
        name = _kids(name[split])
        base += m
        level += 1
    return Nodes(np.concatenate(feature), np.concatenate(threshold), np.concatenate(child).astype(np.int32),
                 np.concatenate(value), np.rint(np.concatenate(size)).astype(np.int64), level)


def _pure(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Labels that are equal but for rounding."""
    return high - low <= ROUNDING * np.spacing(np.maximum(np.abs(low), np.abs(high)))


def _label_unit(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.ldexp(1.0, np.clip(-np.frexp(high - low)[1], -1000, 1000))


def _best_features(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node: the first of the best features, and whether any can split it."""
    best = np.argmax(gains >= np.where(gains > 0, gains, 0).max(axis=0) * TIE, axis=0)
    return best, ~np.isneginf(gains[best, np.arange(gains.shape[1])])


def _picks(can: np.ndarray, names: np.ndarray, tries: int) -> np.ndarray:
    """Which features (of those that can split, by rows) each node tries."""
    pick = np.stack([_unit(names, f, 0, 7) for f in range(len(can))])
    pick[~can] = np.inf
    return (np.argsort(np.argsort(pick, axis=0, kind="stable"), axis=0) < tries) & can


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The threshold between two neighbouring values."""
    mid = a + (b - a) / 2.0
    return np.where((mid >= a) & (mid < b), mid, a)


def _orders(xf: list[np.ndarray], tries: int | None) -> list[np.ndarray | None]:
    """Each feature's rows by value; None for a feature that never wins a split.

    Where a feature does not fall while an earlier one rises, and is equal where that is equal, each of its cuts is a cut
    of the earlier one, which wins ties.  Features picked by a hash (``tries``) are all kept.
    """
    order = []
    for f, v in enumerate(xf):
        before = [] if tries is not None else [(o, xf[g]) for g, o in enumerate(order) if o is not None]
        order.append(None if any(_follows(v, u, o) for o, u in before) else np.argsort(v, kind="stable"))
    return order


def _follows(v: np.ndarray, u: np.ndarray, by: np.ndarray) -> bool:
    """Whether ``v`` is a function of ``u`` that does not fall; ``by`` sorts ``u``."""
    for n in (256, len(by)):        # most pairs are told apart by a few rows
        a, b = v.take(by[:n]), u.take(by[:n])
        if not np.where(b[:-1] < b[1:], a[:-1] <= a[1:], a[:-1] == a[1:]).all():
            return False
    return True


def _best_cuts(xf, order, z, start, count, seg, total, names, tries):
    """Per feature and node: the gain of the best cut (-inf where none is tried) and the cut."""
    k, m = len(xf), len(start)
    gains = np.full((k, m), -np.inf)
    cuts = np.zeros((k, m))
    picked = None
    if tries is not None and tries < k:
        last = start + count - 1
        picked = _picks(np.stack([xf[f][order[f][start]] < xf[f][order[f][last]] for f in range(k)]), names, tries)
    top = np.empty(m)
    for f in range(k):
        o, st, sg, tot, node = order[f], start, seg, total, None
        if o is None:
            continue
        if picked is not None and not picked[f].all():
            node = np.flatnonzero(picked[f])
            if not len(node):
                continue
            o = o.take(np.flatnonzero(picked[f].take(seg)))
            st = np.r_[0, np.cumsum(count[node])[:-1]]
            sg, tot = np.repeat(np.arange(len(node)), count[node]), total[node]
        v = xf[f].take(o)
        ok = v[:-1] < v[1:]
        ok[st[1:] - 1] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        zo = z.take(o)
        cum = np.cumsum(zo)
        sg = sg.take(at)
        left = cum.take(at)
        left -= (cum[st] - zo[st]).take(sg)
        nl = left.real
        gain = tot.take(sg)
        gain -= nl
        gain *= nl
        np.divide(left.imag ** 2, gain, out=gain)
        first = np.flatnonzero(np.r_[True, sg[1:] != sg[:-1]])
        best = np.maximum.reduceat(gain, first)
        mine = sg[first]
        top[mine] = best * TIE
        hit = np.flatnonzero(gain >= top.take(sg))
        by = sg.take(hit)
        spot = at[hit[np.r_[True, by[1:] != by[:-1]]]]
        who = mine if node is None else node[mine]
        gains[f, who] = best
        cuts[f, who] = _middle(v[spot], v[spot + 1])
    return gains, cuts


def descend(t: Nodes, x: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The node (LEAF or HANDED) where each row ends; rows start at the root, or at their node of ``begin``."""
    k = x.shape[1]
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), WALK):
        flat = np.ascontiguousarray(x[i:i + WALK]).ravel()
        n = len(flat) // k
        at = np.arange(i, i + n)
        cell = np.arange(0, n * k, k)
        node = np.zeros(n, np.int64) if begin is None else begin[i:i + n].astype(np.int64)
        while len(at):
            f = t.feature.take(node)
            end = f < 0
            ends = np.count_nonzero(end)
            if ends == len(at):
                out[at] = node
                break
            if ends > len(at) >> 2:
                out[at[end]] = node[end]
                go = ~end
                at, cell, node, f = at[go], cell[go], node[go], f[go]
                ends = 0
            right = ~(flat.take(cell + f, mode="wrap") <= t.threshold.take(node))
            after = t.child.take(node) + right
            node = np.where(end, node, after) if ends else after
            if node.dtype != np.int64:
                node = node.astype(np.int64)
    return out


def _pack(t: Nodes, tree: int, part: int) -> dict:
    return {"tree": tree, "part": part, "n_nodes": len(t.feature), "feature": t.feature.tobytes(),
            "threshold": t.threshold.tobytes(), "child": t.child.tobytes(), "value": t.value.tobytes(),
            "size": t.size.tobytes(), "depth": int(t.depth)}


def _unpack(r) -> Nodes:
    return Nodes(np.frombuffer(r["feature"], np.int8), np.frombuffer(r["threshold"]), np.frombuffer(r["child"], np.int32),
                 np.frombuffer(r["value"]), np.frombuffer(r["size"], np.int64), int(r["depth"]))


_PART_ARROW = pa.schema([("tree", pa.int32()), ("part", pa.int32()), ("n_nodes", pa.int64()), ("feature", pa.binary()),
                         ("threshold", pa.binary()), ("child", pa.binary()), ("value", pa.binary()), ("size", pa.binary()),
                         ("depth", pa.int32())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_PART_ARROW)


def _matrix(b: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """Double columns as a matrix; null is NaN."""
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch)
                            else b.column(c).to_numpy() for c in names]).astype(float, copy=False)


# -- the forest ---------------------------------------------------------------
@dataclass
class ForestModel:
    """A fitted forest: a stored table of parts, in the shared folder or where it was saved."""

    features: list[str]
    num_trees: int
    path: str
    n_nodes: int
    classes: bool = False
    #: nodes above the parts, per tree (empty where a tree is one part)
    tops: dict[int, Nodes] = field(default_factory=dict)

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(PART_SCHEMA).parquet(self.path)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table: one row per node, children within the same part (a HANDED node's ``left`` is its part)."""
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    t = _unpack(r)
                    n = len(t.feature)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, r["tree"], np.int32)), pa.array(np.full(n, r["part"], np.int32)),
                         pa.array(np.arange(n, dtype=np.int32)), pa.array(t.feature.astype(np.int32)),
                         pa.array(np.where(t.feature >= 0, t.threshold, 0.0)),
                         pa.array(t.child), pa.array(np.where(t.feature >= 0, t.child + 1, -1).astype(np.int32)),
                         pa.array(t.value), pa.array(t.size)],
                        names=["tree", "part", "node", "feature", "threshold", "left", "right", "value", "size"])
        return self.parts(spark).mapInArrow(run, NODE_SCHEMA)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, num_trees: int, seed: int, key: Sequence[str] | None = None,
               max_depth: int | None = None, tries: int | None = None, classes: bool = False, small: int = SMALL,
               path: str | None = None, bootstrap: bool = True, whole: int = WHOLE_BYTES, chunk: int = CHUNK) -> ForestModel:
    """Fit on all rows of ``df`` (no feature and no label null); ``key`` names the columns that tell rows apart.

    The rows are read once to store them (key, features, label) and once per
    pass.  ``small``, ``whole`` and ``chunk`` change how the trees are cut into
    parts and where they are grown, not the trees.  Without ``bootstrap`` every tree sees every row once.  Without ``key`` a row is drawn by a hash of all its columns; equal
    rows are then drawn alike.
    """
    spark = df.sparkSession
    features = list(features)
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.select(F.xxhash64(*(key or sorted(df.columns))).alias("_key"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)],
                        F.col(label).cast("double").alias("_y"))
    store = scratch_path(spark, "forest-rows")
    rows.write.parquet(store)
    rows = spark.read.schema(rows.schema).parquet(store)
    n = rows.count()
    if n < 1:
        raise ValueError("a forest needs at least one row")
    out = path or scratch_path(spark, "forest")
    cores = spark.sparkContext.defaultParallelism

    def columns(b):
        return (b.column("_key").to_numpy(zero_copy_only=False).astype(np.int64, copy=False), _matrix(b, names),
                b.column("_y").to_numpy(zero_copy_only=False))

    if n * 8 * (len(names) + 2) <= whole:
        _grow_trees(rows, columns, names, num_trees, seed, bootstrap, max_depth, tries, small, out)
    else:
        if rows.rdd.getNumPartitions() < cores:     # few unsplittable files: use all cores
            rows = rows.repartition(2 * cores, "_key")
        # a feature that follows an earlier one wins no split: it is not sorted, stored or sent
        used = list(range(len(names))) if tries is not None else _independent(rows, names)
        names = [names[f] for f in used]        # what ``columns`` reads from here on
        rows = rows.select("_key", *names, "_y")
        tops = _grow_tops(rows, columns, names, n, num_trees, seed, bootstrap, max_depth, tries, SENT * small, chunk)
        _grow_parts(rows, columns, tops, num_trees, seed, bootstrap, max_depth, tries, np.array(used, np.int8), out)
    parts = spark.read.schema(PART_SCHEMA).parquet(out)
    facts = parts.agg(F.sum("n_nodes"), F.count(F.lit(1))).first()
    return ForestModel(features, num_trees, out, int(facts[0]), classes, _read_tops(parts))


def _read_tops(parts: DataFrame) -> dict[int, Nodes]:
    """The nodes above the parts of the trees that have several."""
    cut = parts.filter("part > 0").select("tree").distinct()
    top = parts.filter("part = 0").join(cut, "tree", "left_semi")
    return {r["tree"]: _unpack(r) for r in top.toLocalIterator()}


def _grow_trees(rows: DataFrame, columns, names, num_trees: int, seed: int, bootstrap: bool, max_depth: int | None,
                tries: int | None, small: int, out: str) -> None:
    """A bounded table: each task grows whole trees from it."""
    spark = rows.sparkSession
    data = spark.sparkContext.broadcast(columns(rows.orderBy("_key", *names, "_y").toArrow().combine_chunks().to_batches()[0]))

    def run(batches):
        key, x, y = data.value
        for b in batches:
            for tree in b.column("id").to_pylist():
                w = draws(key, tree, seed if bootstrap else None)
                if not w.any():
                    w = np.ones(len(y), np.uint8)
                on = np.flatnonzero(w)
                for part, got in enumerate(_grow_cut(x[on], y[on], w[on], max_depth, tries, _root(seed, tree), small)):
                    yield _batch([_pack(got, tree, part)])

    cores = spark.sparkContext.defaultParallelism
    spark.range(0, num_trees, 1, min(num_trees, 4 * cores)).mapInArrow(run, PART_SCHEMA).write.mode("overwrite").parquet(out)


def _grow_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_depth: int | None, tries: int | None, root: int,
              small: int) -> Iterator[Nodes]:
    """A tree: its top and its parts 1, 2, ... of at most ``small`` drawn rows (one part if it has no more)."""
    top = grow(x, y, w, max_depth, tries, root, stop_size=small if w.sum(dtype=np.int64) > small else 0)
    handed = np.flatnonzero(top.feature == HANDED)
    top.child[handed] = 1 + np.arange(len(handed))
    yield top
    if not len(handed):
        return
    end = descend(top, x)
    part = np.where(top.feature[end] == HANDED, top.child[end], 0)
    by = _by_part(part)
    cut = np.searchsorted(part[by], np.arange(len(handed) + 2))
    hang = _hang(top, root)
    for p in range(1, len(handed) + 1):
        at = by[cut[p]:cut[p + 1]]      # in the order of the rows: sums come out as in one piece
        deep, name = hang[p]
        yield grow(x[at], y[at], w[at], None if max_depth is None else max_depth - deep, tries, name)


def _hang(top: Nodes, root: int) -> dict[int, tuple[int, int]]:
    """How deep each part of a tree hangs, and the name of its first node."""
    node, names, deep, out = np.array([0]), np.array([root], np.uint64), 0, {}
    while len(node):
        on = top.feature[node] == HANDED
        out.update((int(p), (deep, int(i))) for p, i in zip(top.child[node[on]], names[on]))
        on = top.feature[node] >= 0
        first = top.child[node[on]].astype(np.int64)
        node, names = np.concatenate([first, first + 1]), _kids(names[on])
        deep += 1
    return out


def _read_payload(chunks, k: int):
    a = np.concatenate([np.frombuffer(c).reshape(-1, k + 3) for c in chunks])
    # chunks arrive in any order: sort by key, so that sums and ties come out alike on every run
    key = a[:, 0].copy().view(np.int64)
    by = np.argsort(key, kind="stable")
    if (key[by[1:]] == key[by[:-1]]).any():
        by = np.lexsort((*[a[:, 1 + i] for i in range(k + 1)][::-1], key))
    a = a[by]
    return a[:, 1:1 + k].copy(), a[:, 1 + k].copy(), a[:, 2 + k].copy()


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, joined to about ROUTE_ROWS rows or ROUTE_BYTES bytes."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= ROUTE_ROWS or size >= ROUTE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, size = [], 0, 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _by_part(part: np.ndarray) -> np.ndarray:
    """The stable order of the rows by part (16 bits are sorted by radix)."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def _binary(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The rows of a matrix, from one cut to the next, as binary values."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [
        None, pa.py_buffer((cut * (data.shape[1] * data.itemsize)).astype(np.int32)), pa.py_buffer(data)])


def _plain(tops: dict[int, Nodes]) -> dict[int, tuple]:
    """What a walk down the tops needs, without this module's classes (a broadcast names them, workers may lack them)."""
    return {t: (top.feature, top.threshold, top.child) for t, top in tops.items()}


def _walkable(plain: tuple) -> Nodes:
    return Nodes(*plain, None, None, 0)


_CHUNK = "tree int, part int, data binary"


def _send(rows: DataFrame, columns, trees: Sequence[int], tops: dict[int, Nodes], pick) -> DataFrame:
    """One pass: the rows of each (tree, part) that ``pick`` chooses, packed per share of a task's rows.

    ``pick`` gets the keys, the tree and a function that finds the part of rows (-1: they end in the top), and returns
    the rows chosen, their parts and their draws.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_plain(tops))

    def run(batches: Iterator[pa.RecordBatch]):
        above = {t: _walkable(top) for t, top in shared.value.items()}
        for b in _gather(batches):
            key, x, y = columns(b)
            for tree in trees:
                top = above.get(tree)

                def part_of(at, top=top):
                    if top is None:
                        return np.zeros(len(at), np.int32)
                    end = descend(top, x[at])
                    return np.where(top.feature[end] == HANDED, top.child[end], -1)

                at, part, w = pick(key, tree, part_of)
                if not len(at):
                    continue
                by = _by_part(part)
                at, p, w = at[by], part[by], w[by]
                cut = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(at)]
                data = np.column_stack([key[at].view(float), x[at], y[at], w])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut) - 1, tree, np.int32)), pa.array(p[cut[:-1]].astype(np.int32)), _binary(data, cut)],
                    names=["tree", "part", "data"])

    return rows.mapInArrow(run, _CHUNK)


def _independent(rows: DataFrame, names: Sequence[str]) -> list[int]:
    """The features that follow no earlier one (see :func:`_orders`), found over all rows."""
    few = _matrix(rows.limit(256).toArrow(), names)     # most pairs are told apart by a few rows
    left = list(range(len(names)))
    for u in range(len(names)):
        by = np.argsort(few[:, u], kind="stable")
        may = [v for v in left if v > u and _follows(few[:, v], few[:, u], by)]
        if u not in left or not may:
            continue

        def run(batches, may=may, u=names[u], vs=[names[v] for v in may]):
            first = last = None
            ok = np.ones(len(may), bool)
            for b in batches:
                if not b.num_rows:
                    continue
                a = _matrix(b, [u, *vs])
                if last is not None:
                    a = np.concatenate([last[None], a])
                first = a[0] if first is None else first
                for i in range(len(may)):
                    ok[i] &= _follows(a[:, 1 + i], a[:, 0], np.arange(len(a)))
                last = a[-1]
            if first is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (first, last, ok)], names=["first", "last", "ok"])

        cuts = 2 * rows.sparkSession.sparkContext.defaultParallelism
        by = [names[u], *[names[v] for v in may], "_key"]
        got = (rows.select(*by).repartitionByRange(cuts, *by).sortWithinPartitions(*by)
               .mapInArrow(run, "first binary, last binary, ok binary").collect())
        ends = np.array([np.frombuffer(e) for r in got for e in (r["first"], r["last"])])
        ends = ends[np.lexsort(ends.T[::-1])]
        for i, v in enumerate(may):
            if all(np.frombuffer(r["ok"], bool)[i] for r in got) and _follows(ends[:, 1 + i], ends[:, 0], np.arange(len(ends))):
                left.remove(v)
    return left


_LIST = "feature int, chunk int, data binary"
_SUMS = "feature int, chunk int, tree int, data binary"


def _sorted_lists(rows: DataFrame, columns, names: Sequence[str], n: int, chunk: int) -> DataFrame:
    """The rows once for every feature: sorted by it, in chunks whose numbers rise with the values."""
    spark = rows.sparkSession
    store = scratch_path(spark, "forest-lists")
    for f, name in enumerate(names):
        def pack(batches, f=f):
            held = [columns(b) for b in batches if b.num_rows]
            if held:
                key, x, y = (np.concatenate(c) for c in zip(*held))
                data = np.column_stack([key.view(float), x, y])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
                     pa.array([data.tobytes()], pa.binary())], names=["feature", "chunk", "data"])

        (rows.repartitionByRange(-(-n // chunk), name, "_key").sortWithinPartitions(name, "_key")
         .mapInArrow(pack, _LIST).write.mode("append").parquet(store))
    return spark.read.schema(_LIST).parquet(store)


@dataclass
class _Level:
    """The open nodes of a tree's top: its last level."""

    node: np.ndarray    # where they are in the top
    name: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    total: np.ndarray | None = None
    pick: np.ndarray | None = None      # features x nodes
    mean: np.ndarray | None = None      # of the labels in units, from the lowest on
    sums: np.ndarray | None = None      # features x chunks x nodes: weight and labels before the chunk, and the value behind it


def _grow_tops(rows: DataFrame, columns, names: Sequence[str], n: int, num_trees: int, seed: int, bootstrap: bool,
               max_depth: int | None, tries: int | None, small: int, chunk: int) -> dict[int, Nodes]:
    """Splits of all nodes of more than ``small`` drawn rows, over all of their rows.

    The driver holds the sums of every chunk's open nodes for as many trees at
    once as :data:`TOP_BYTES` allow, and about ``rows / small`` nodes a tree.
    """
    lists = _sorted_lists(rows, columns, names, n, chunk)
    k = len(names)
    n_chunks = 1 + lists.agg(F.max("chunk")).first()[0]
    at_once = max(1, TOP_BYTES // (64 * k * n_chunks * max(1, n // small)))
    tops: dict[int, Nodes] = {}
    # without a bootstrap and with all features tried, all trees are one
    several = num_trees if bootstrap or tries is not None else 1
    for lo in range(0, several, at_once):
        trees = range(lo, min(several, lo + at_once))
        open_ = {}
        for t in trees:
            tops[t] = Nodes(np.array([HANDED], np.int8), np.zeros(1), np.zeros(1, np.int32), np.zeros(1), np.array([n]), 0)
            open_[t] = _Level(np.array([0]), np.array([_root(seed, t)], np.uint64))
        level = 0
        while open_:
            open_ = _next_level(lists, tops, open_, k, n_chunks, seed if bootstrap else None, tries,
                                max_depth is not None and level >= max_depth, small)
            level += 1
    for top in tops.values():
        handed = np.flatnonzero(top.feature == HANDED)
        top.child[handed] = 1 + np.arange(len(handed))
    for t in range(several, num_trees):
        tops[t] = tops[0]
    return tops


def _next_level(lists: DataFrame, tops: dict[int, Nodes], open_: dict[int, _Level], k: int, n_chunks: int, seed: int | None,
                tries: int | None, deepest: bool, small: int) -> dict[int, _Level]:
    """Splits the open nodes (or ends them) and returns those of their children that are open."""
    stats = _pass(lists.filter("feature = 0"), tops, open_, k, seed, _labels)
    for t, at in list(open_.items()):
        top, m = tops[t], len(at.node)
        got = np.concatenate(stats[t][1])
        slot = got[:, 0].astype(np.int64)
        at.total, weighted = np.bincount(slot, got[:, 1], m), np.bincount(slot, got[:, 2], m)
        at.low, at.high = np.full(m, np.inf), np.full(m, -np.inf)
        np.minimum.at(at.low, slot, got[:, 3])
        np.maximum.at(at.high, slot, got[:, 4])
        mean = np.where(at.low == at.high, at.low, weighted / at.total)
        top.value[at.node], top.size[at.node] = mean, np.rint(at.total)
        # a root may hold few rows: that of another tree is open
        few = at.total <= small
        ends = np.flatnonzero(_pure(at.low, at.high) | deepest)
        top.feature[at.node[ends]], top.threshold[at.node[ends]] = LEAF, mean[ends]
        go = ~few
        go[ends] = False
        open_[t] = _Level(at.node[go], at.name[go], at.low[go], at.high[go], at.total[go])
        if not go.any():
            del open_[t]
    if not open_:
        return {}

    sums = _pass(lists, tops, open_, k, seed, _chunk_sums)
    for t, at in open_.items():
        m = len(at.node)
        w, s, first, last = np.zeros((4, k, n_chunks, m))
        first += np.nan     # no row: NaN, which is below no value
        last += np.nan
        for (f, c), got in zip(*sums[t]):
            slot = got[:, 0].astype(np.int64)
            w[f, c, slot], s[f, c, slot], first[f, c, slot], last[f, c, slot] = got[:, 1:].T
        at.mean = s[0].sum(axis=0) / at.total
        behind = np.fmin.accumulate(first[:, ::-1], axis=1)[:, ::-1]     # the least value from a chunk on
        behind = np.concatenate([behind[:, 1:], np.full((k, 1, m), np.nan)], axis=1)
        before_w, before_s = np.cumsum(w, axis=1) - w, np.cumsum(s, axis=1) - s
        at.sums = np.stack([before_w, before_s - at.mean * before_w, behind], axis=-1)
        can = np.fmin.reduce(first, axis=1) < np.fmax.reduce(last, axis=1)
        at.pick = can if tries is None or tries >= k else _picks(can, at.name, tries)

    best = _pass(lists, tops, open_, k, seed, _chunk_cuts)
    after = {}
    for t, at in open_.items():
        m, top = len(at.node), tops[t]
        gain, a, b, w, s = np.zeros((5, k, n_chunks, m))
        gain -= np.inf
        for (f, c), got in zip(*best.get(t, ((), ()))):
            slot = got[:, 0].astype(np.int64)
            gain[f, c, slot], a[f, c, slot], b[f, c, slot], w[f, c, slot], s[f, c, slot] = got[:, 1:].T
        gains = gain.max(axis=1)
        spot = np.argmax(gain >= np.where(gains > 0, gains * TIE, gains)[:, None], axis=1)     # the lowest of the best cuts
        f, can = _best_features(gains)
        ends = at.node[~can]
        top.feature[ends], top.threshold[ends] = LEAF, top.value[ends]
        on = np.flatnonzero(can)
        if not len(on):
            continue
        f, c = f[on], spot[f[on], on]
        left, moved = w[f, c, on], s[f, c, on]
        right = at.total[on] - left
        unit, low, mean = _label_unit(at.low[on], at.high[on]), at.low[on], at.mean[on]
        first = len(top.feature) + 2 * np.arange(len(on))
        top.feature[at.node[on]], top.threshold[at.node[on]] = f, _middle(a[f, c, on], b[f, c, on])
        top.child[at.node[on]] = first
        size = np.column_stack([left, right])
        value = low[:, None] + (np.column_stack([moved / left, -moved / right]) + mean[:, None]) / unit[:, None]
        more = 2 * len(on)
        tops[t] = Nodes(np.r_[top.feature, np.full(more, HANDED, np.int8)], np.r_[top.threshold, np.zeros(more)],
                        np.r_[top.child, np.zeros(more, np.int32)], np.r_[top.value, value.ravel()],
                        np.r_[top.size, np.rint(size.ravel()).astype(np.int64)], top.depth + 1)
        node, size = np.concatenate([first, first + 1]), np.concatenate([left, right])
        big = size > small
        if big.any():
            after[t] = _Level(node[big], _kids(at.name[on])[big])
    return after


def _pass(lists: DataFrame, tops: dict[int, Nodes], open_: dict[int, _Level], k: int, seed: int | None, what) -> dict[int, tuple]:
    """One pass over the sorted features: what ``what`` gives for every chunk and tree, as (where, arrays) of the tree."""
    plain = _plain({t: tops[t] for t in open_})
    shared = lists.sparkSession.sparkContext.broadcast(
        {t: (plain[t], at.node, at.low, at.high, at.total, at.pick, at.mean, at.sums) for t, at in open_.items()})

    def run(batches):
        for b in batches:
            for f, c, data in zip(b.column("feature").to_pylist(), b.column("chunk").to_pylist(), b.column("data")):
                rows = np.frombuffer(data.as_buffer()).reshape(-1, k + 2)
                key, x, y = rows[:, 0].copy().view(np.int64), np.ascontiguousarray(rows[:, 1:1 + k]), rows[:, 1 + k].copy()
                for t, (top, node, *state) in shared.value.items():
                    top = _walkable(top)
                    slots = np.full(len(top.feature), -1)
                    slots[node] = np.arange(len(node))
                    w = draws(key, t, seed)
                    at = np.flatnonzero(w)
                    slot = slots[descend(top, x[at])]
                    pick = state[3]
                    on = np.flatnonzero(slot >= 0 if pick is None else (slot >= 0) & pick[f][slot])
                    if not len(on):
                        continue
                    on = on[_by_part(slot[on])]
                    at, slot = at[on], slot[on]
                    start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                    got = what(f, c, x[at, f], y[at], w[at].astype(float), slot, start, *state)
                    if len(got):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], pa.int32()) for v in (f, c, t)] + [pa.array([got.tobytes()], pa.binary())],
                            names=["feature", "chunk", "tree", "data"])

    out: dict[int, tuple] = {}
    # sorted: sums over the chunks come out alike on every run
    for r in sorted(lists.mapInArrow(run, _SUMS).collect(), key=lambda r: (r["tree"], r["feature"], r["chunk"])):
        where, arrays = out.setdefault(r["tree"], ([], []))
        where.append((r["feature"], r["chunk"]))
        raw = np.frombuffer(r["data"])
        arrays.append(raw.reshape(-1, what.width))
    shared.unpersist()
    return out


def _labels(f, c, v, y, w, slot, start, *_) -> np.ndarray:
    """Per node: weight, weighted label, least and largest label."""
    return np.column_stack([slot[start], np.add.reduceat(w, start), np.add.reduceat(w * y, start),
                            np.minimum.reduceat(y, start), np.maximum.reduceat(y, start)])


def _chunk_sums(f, c, v, y, w, slot, start, low, high, *_) -> np.ndarray:
    """Per node: weight, weighted labels (in units, from the lowest on), first and last value."""
    label = (y - low[slot]) * _label_unit(low, high)[slot]
    end = np.r_[start[1:], len(v)] - 1
    return np.column_stack([slot[start], np.add.reduceat(w, start), np.add.reduceat(w * label, start), v[start], v[end]])


def _chunk_cuts(f, c, v, y, w, slot, start, low, high, total, pick, mean, sums) -> np.ndarray:
    """Per node: the best cut in or right behind this chunk: gain, the values beside it, weight and labels on its left."""
    label = (y - low[slot]) * _label_unit(low, high)[slot]
    label -= mean[slot]
    label *= w
    end = np.r_[start[1:], len(v)] - 1
    after = np.r_[v[1:], np.nan]
    after[end] = sums[f, c, slot[end], 2]
    at = np.flatnonzero(v < after)
    if not len(at):
        return np.empty((0, 6))
    size = np.diff(np.r_[start, len(v)])
    left, moved = np.cumsum(w), np.cumsum(label)
    left -= np.repeat(left[start] - w[start] - sums[f, c, slot[start], 0], size)
    moved -= np.repeat(moved[start] - label[start] - sums[f, c, slot[start], 1], size)
    left, moved, by = left[at], moved[at], slot[at]
    gain = moved ** 2 / ((total[by] - left) * left)
    first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    best = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain >= np.repeat(best * TIE, np.diff(np.r_[first, len(by)])))
    hit = hit[np.r_[True, by[hit][1:] != by[hit][:-1]]]
    return np.column_stack([by[first], best, v[at[hit]], after[at[hit]], left[hit], moved[hit]])


_labels.width, _chunk_sums.width, _chunk_cuts.width = 5, 5, 6


def _grow_parts(rows: DataFrame, columns, tops: dict[int, Nodes], num_trees: int, seed: int, bootstrap: bool,
                max_depth: int | None, tries: int | None, used: np.ndarray, out: str) -> None:
    """Sends the rows to the parts and grows them; ``used`` are the features that the rows bring."""
    k = len(rows.columns) - 2
    hang = {t: _hang(top, _root(seed, t)) for t, top in tops.items()}

    def pick(key, tree, part_of):
        w = draws(key, tree, seed if bootstrap else None)
        at = np.flatnonzero(w)
        part = part_of(at)
        on = part >= 0
        return at[on], part[on], w[at[on]]

    def named(t: Nodes) -> Nodes:
        return Nodes(np.where(t.feature >= 0, used[t.feature], t.feature).astype(np.int8), t.threshold, t.child, t.value, t.size, t.depth)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t, p = int(pdf["tree"].iloc[0]), int(pdf["part"].iloc[0])
        x, y, w = _read_payload(pdf["data"], k)
        deep, name = hang[t][p]
        return pd.DataFrame([_pack(named(grow(x, y, w, None if max_depth is None else max_depth - deep, tries, name)), t, p)])

    spark = rows.sparkSession
    # part 0 of a tree with a top is the top itself: the parts are numbered from 1
    sent = _send(rows, columns, range(num_trees), tops, pick)
    sent.groupBy("tree", "part").applyInPandas(build, PART_SCHEMA).write.mode("overwrite").parquet(out)
    above = pd.DataFrame([_pack(named(top), t, 0) for t, top in tops.items()])
    spark.createDataFrame(above, PART_SCHEMA).write.mode("append").parquet(out)


# -- scoring ------------------------------------------------------------------
def _blocks(model: ForestModel, spark: SparkSession, limit: int) -> list[list[int]]:
    """Trees dealt to blocks of at most ``limit`` bytes (a block holds at least one part of a tree)."""
    sizes = [(r["tree"], r["part"], int(r["n_nodes"]) * NODE_BYTES) for r in
             model.parts(spark).select("tree", "part", "n_nodes").orderBy("tree", "part").toLocalIterator()]
    blocks, room = [[]], limit
    for tree, part, size in sizes:
        if part == 0 and tree in model.tops:
            continue
        if blocks[-1] and size > room:
            blocks.append([])
            room = limit
        blocks[-1].append((tree, part))
        room -= size
    return blocks


def _load(model: ForestModel, spark: SparkSession, block: list[tuple[int, int]]) -> list[tuple]:
    """The block's trees: each one's parts joined to one node array, and where each part's root is (-1: not here)."""
    if not block:       # no tree reaches below its top
        return []
    lo, hi = block[0], block[-1]
    got = (model.parts(spark).filter(F.col("tree").between(lo[0], hi[0]))
           .filter(F.struct("tree", "part") >= F.struct(F.lit(lo[0]).cast("int").alias("tree"), F.lit(lo[1]).cast("int").alias("part")))
           .filter(F.struct("tree", "part") <= F.struct(F.lit(hi[0]).cast("int").alias("tree"), F.lit(hi[1]).cast("int").alias("part")))
           .drop("size", "value").orderBy("tree", "part").toArrow())
    wanted, held = set(block), {}
    for r in got.to_pylist():
        if (r["tree"], r["part"]) in wanted:
            held.setdefault(r["tree"], []).append((r["part"], _unpack(r | {"size": b"", "value": b""})))
    out = []
    for tree, parts in held.items():
        off = np.r_[0, np.cumsum([len(t.feature) for _, t in parts])]
        roots = np.full(1 + max(p for p, _ in parts), -1, np.int64)
        roots[[p for p, _ in parts]] = off[:-1]
        out.append((tree, roots, np.concatenate([t.feature for _, t in parts]), np.concatenate([t.threshold for _, t in parts]),
                    np.concatenate([t.child + np.int32(o) for o, (_, t) in zip(off, parts)])))
    return out


def predict_sum(x: np.ndarray, trees: list[tuple], tops: dict[int, Nodes], with_tops: bool) -> np.ndarray:
    """The sum of these trees' (parts') values for each row; rows of other parts add nothing."""
    out = np.zeros(len(x))
    if with_tops:
        for top in tops.values():
            end = descend(top, x)
            out += np.where(top.feature[end] == LEAF, top.threshold[end], 0.0)
    for tree, roots, *nodes in trees:
        t, top = _walkable(nodes), tops.get(tree)
        if top is None:
            out += t.threshold[descend(t, x)]
            continue
        end = descend(top, x)
        part = np.where(top.feature[end] == HANDED, top.child[end], len(roots))
        root = np.append(roots, -1)[np.minimum(part, len(roots))]
        at = np.flatnonzero(root >= 0)
        at = at[_by_part(part[at])]     # rows of a part walk together
        out[at] += t.threshold[descend(t, x[at], root[at])]
    return out


def score_forest(df: DataFrame, model: ForestModel, out: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``out``: the mean of the trees' values (classes: 1 where that is at least 0.5).

    A forest of at most ``limit`` bytes is broadcast and no row moves.  A larger
    one is either scored block by block (the rows with the sum so far are
    written to the shared folder between two blocks), or the rows go to the
    parts that they end in (:func:`_score_routed`), whichever moves fewer
    bytes: blocks grow with the forest and with the rows, so with a forest as
    large as its table their work would grow with its square.
    """
    spark = df.sparkSession
    total = "_forest_sum"
    blocks = _blocks(model, spark, limit)
    state = df
    if len(blocks) > 1:
        path = scratch_path(spark, "forest-score")
        df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        state = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_row", T.LongType())])).parquet(path)
        n = state.count()
        routed = n * model.num_trees * 8 * (len(model.features) + 3)
        in_blocks = len(blocks) * (4 * limit + 2 * n * 8 * (len(df.columns) + 1))
        if routed <= in_blocks:
            return _finish(_score_routed(state, model, total), model, total, out)
        state = state.drop("_row")
    return _finish(_score_blocks(state, model, total, blocks), model, total, out)


def _score_blocks(state: DataFrame, model: ForestModel, total: str, blocks: list[list[tuple[int, int]]]) -> DataFrame:
    """Adds the sum of the trees' values, a broadcast block of the forest at a time; no row moves."""
    spark, features = state.sparkSession, list(model.features)
    state = state.withColumn(total, F.lit(0.0))
    for i, block in enumerate(blocks):
        if i:
            path = scratch_path(spark, "forest-score")
            state.write.parquet(path)
            state = spark.read.schema(state.schema).parquet(path)
        shared = spark.sparkContext.broadcast((_load(model, spark, block), _plain(model.tops)))

        def run(batches, shared=shared, first=i == 0):
            trees, plain = shared.value
            tops = {t: _walkable(top) for t, top in plain.items()}
            for b in _gather(batches):
                got = b.column(total).to_numpy(zero_copy_only=False) + predict_sum(_matrix(b, features), trees, tops, first)
                yield b.set_column(b.schema.get_field_index(total), total, pa.array(got))

        state = state.mapInArrow(run, state.schema)
    return state


def _finish(state: DataFrame, model: ForestModel, total: str, out: str) -> DataFrame:
    mean = F.col(total) / F.lit(float(model.num_trees))
    value = F.when(mean >= 0.5, F.lit(1)).otherwise(F.lit(0)) if model.classes else mean
    return state.withColumn(out, value).drop(total)


_ROUTED = "tree int, part int, kind int, home long, data binary"
_SCORED = "home long, tree int, data binary"


def _score_routed(rows: DataFrame, model: ForestModel, total: str) -> DataFrame:
    """Adds the sum of the trees' values to stored rows with a ``_row`` number; the work grows with rows x trees.

    Every row goes to the (tree, part) where it ends, beside the part's nodes:
    within a partition the nodes come first and the rows stream past them, so a
    task holds one part, however many rows end there.  The values go back to
    the row's home (8,192 neighbouring rows), where they are summed tree by tree.
    """
    spark = rows.sparkSession
    features, num_trees, k = list(model.features), model.num_trees, len(model.features)
    shared = spark.sparkContext.broadcast(_plain(model.tops))
    low = (1 << HOME) - 1

    def send(batches):
        tops = {t: _walkable(top) for t, top in shared.value.items()}
        for b in _gather(batches):
            ids = b.column("_row").to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            x = _matrix(b, features)
            by = np.argsort(ids, kind="stable")
            home, x = ids[by] >> HOME, x[by]
            data = np.column_stack([(ids[by] & low).astype(float), x])
            ended = np.zeros(len(ids))

            def chunks(tree, part, at, kind, values):
                p, h = part, home[at]
                cut = np.r_[0, np.flatnonzero((p[1:] != p[:-1]) | (h[1:] != h[:-1])) + 1, len(at)]
                n = len(cut) - 1
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tree, np.int32)), pa.array(p[cut[:-1]].astype(np.int32)), pa.array(np.full(n, kind, np.int32)),
                     pa.array(h[cut[:-1]]), _binary(values, cut)], names=["tree", "part", "kind", "home", "data"])

            for tree in range(num_trees):
                top = tops.get(tree)
                part, at = np.zeros(len(x), np.int32), np.arange(len(x))
                if top is not None:
                    end = descend(top, x)
                    leaf = top.feature[end] == LEAF
                    ended[leaf] += top.threshold[end[leaf]]
                    at = np.flatnonzero(~leaf)
                    part = top.child[end[at]]
                    by = _by_part(part)
                    part, at = part[by], at[by]
                if len(at):
                    yield chunks(tree, part, at, 1, data[at])
            # what the tops gave, already summed
            yield chunks(-1, home % 4096, np.arange(len(x)), 2, np.column_stack([data[:, 0], ended]))

    def walk(batches):
        nodes = None
        for b in batches:
            tree, kind = (b.column(c).to_numpy() for c in ("tree", "kind"))
            part, home, col = b.column("part").to_numpy(), b.column("home").to_numpy(), b.column("data")
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
            raw = np.frombuffer(col.buffers()[2], np.uint8)
            new = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for i, j in zip(new, np.r_[new[1:], len(tree)]):
                got = raw[offsets[i]:offsets[j]]
                cut = offsets[i:j + 1] - offsets[i]
                if kind[i] == 0:
                    n = int(home[i])
                    got = got.tobytes()
                    nodes = Nodes(np.frombuffer(got, np.int8, n), np.frombuffer(got[n:9 * n]), np.frombuffer(got[9 * n:], np.int32), None, None, 0)
                    continue
                if kind[i] == 1:
                    a = np.frombuffer(got.tobytes()).reshape(-1, k + 1)
                    values = np.column_stack([a[:, 0], nodes.threshold[descend(nodes, a[:, 1:])]])
                    cut = cut // (8 * (k + 1))
                else:
                    values, cut = np.frombuffer(got.tobytes()).reshape(-1, 2), cut // 16
                yield pa.RecordBatch.from_arrays([pa.array(home[i:j]), pa.array(tree[i:j]), _binary(values, cut)],
                                                 names=["home", "tree", "data"])

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks = right.column("data").to_pylist()
        by = np.argsort(right.column("tree").to_numpy(), kind="stable")     # the same order of adding on every run
        a = np.concatenate([np.frombuffer(chunks[i]).reshape(-1, 2) for i in by])
        sums = np.bincount(a[:, 0].astype(np.int64), a[:, 1], 1 << HOME)
        at = left.column("_row").to_numpy() & low
        return left.drop_columns(["_row", "_home"]).append_column(total, pa.array(sums[at]))

    sent = rows.select("_row", *[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(send, _ROUTED)
    whole = sorted(model.tops)      # their part 0 is the top itself
    nodes = model.parts(spark).filter(~((F.col("part") == 0) & F.col("tree").isin(whole)) if whole else F.lit(True)).select(
        "tree", "part", F.lit(0).alias("kind"), F.col("n_nodes").alias("home"), F.concat("feature", "threshold", "child").alias("data"))
    scored = (nodes.unionByName(sent).repartition("tree", "part").sortWithinPartitions("tree", "part", "kind")
              .mapInArrow(walk, _SCORED))
    homes = rows.withColumn("_home", F.shiftright("_row", HOME))
    schema = T.StructType([*rows.drop("_row").schema.fields, T.StructField(total, T.DoubleType())])
    return homes.groupBy("_home").cogroup(scored.groupBy("home")).applyInArrow(merge, schema)


# -- persistence --------------------------------------------------------------
META = "features string, num_trees int, n_nodes long, classes boolean, parts_with_top string"


def save(spark: SparkSession, model: ForestModel, path: str) -> None:
    base = path.rstrip("/")
    model.parts(spark).write.mode("overwrite").parquet(f"{base}/parts")
    meta = [("\x1f".join(model.features), model.num_trees, model.n_nodes, model.classes,
             ",".join(str(t) for t in sorted(model.tops)))]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")


def load(spark: SparkSession, path: str) -> ForestModel:
    base = path.rstrip("/")
    m = spark.read.parquet(f"{base}/meta").first()
    parts = spark.read.schema(PART_SCHEMA).parquet(f"{base}/parts")
    tops = _read_tops(parts) if m["parts_with_top"] else {}
    return ForestModel(m["features"].split("\x1f"), m["num_trees"], f"{base}/parts", m["n_nodes"], m["classes"], tops)

