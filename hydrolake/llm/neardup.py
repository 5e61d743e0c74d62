"""Near-duplicate documents by chosen-path set similarity join (operator 4).

Texts become sets of word shingles, sets become ``COORDS`` minwise tokens, and
equal sets are one set from there on.  In each of several independent random
trees, every node draws one of the coordinates (one time in four a second one)
from its own path; a set moves to the child named by its minwise token there.  A
pair of similarity s stays together with probability s a child, and 1.25
children a node keep the expected number of common paths at 1 for s = 0.8, but
the chance that none is left grows with the depth.  Nodes of at most ``LEAF`` sets
are compared exhaustively; larger ones branch on, and their sets get as many
further trees as it takes that a pair of similarity 0.8 shares no node of the
next depth with a chance of at most ``MISS`` (:func:`trees_at`: 10 trees at depth
2, 39 at depth 8).

A large node whose sets are much alike is a family of near copies or of texts
around one passage, which branching would not part (and so is what is still
large at the last depth).  Its sets are compared with the node's pivot first;
then, block against block, every set with all sets of the family that it is
not connected with yet, so no pair is given up and a family of copies mostly
costs its size.

Comparisons on minwise tokens only propose pairs (``SKETCH`` leaves a wide
margin); each is confirmed on the full sets.  Pairs inside a component that
confirmed pairs already connect are not verified again, which cannot change
the components.

Defined cases: a null text or one without words has no shingles and no link; a
text of fewer words than a shingle is one shingle; rows with equal sets are
one class; rows that repeat an id are one document; a null id is never linked
(``component_id`` null, kept); a very long text is read whole, as one set; a
similarity of exactly the threshold is a link; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from itertools import count
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import bloom
from hydrolake.llm import text as T
from hydrolake.llm.common import components, stored, table

COORDS, TREES = 96, 10
START, LAST, LEAF = 2, 8, 48
#: chance a depth that a pair of similarity 0.8 meets in no tree, over the spread of its ``COORDS`` tokens
MISS = 2e-5
#: a node is a family if its sets agree with its pivot in so many of the first ``PROBE`` coordinates on average
FAMILY, PROBE, BLOCK = 0.4, 16, 512
#: agreement of minwise tokens from which a pair is verified: at similarity 0.8 five standard deviations are 0.2
SKETCH = 0.6


def _shingles(data: np.ndarray, offs: np.ndarray, k: int):
    """Distinct shingle hashes, ordered by text and hash, and their texts."""
    h, doc, _, _ = T.words(data, offs, T.LOWERED, T.NOT_SPACE)
    n_docs = len(offs) - 1
    g, ok = T.grams(h, doc, k, seed=31)
    at = np.flatnonzero(ok)
    g, d = g[at], doc[at]
    # shorter texts: all their words as one shingle
    size = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = []
        for i, f in zip(short, first):
            with np.errstate(over="ignore"):
                x = np.uint64(size[i])
                for w in h[f:f + size[i]]:
                    x = T.mix(x * np.uint64(0x100000001B3) + w)
            extra.append(x)
        g, d = np.r_[g, np.array(extra, np.uint64)], np.r_[d, short]
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])] if len(g) else np.zeros(0, bool)
    return g[new], d[new]


def _sketches(k: int):
    odd = T.stream(COORDS, 41) | np.uint64(1)
    add = T.stream(COORDS, 42)

    def run(rest: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, valid: np.ndarray):
        n_docs = len(offs) - 1
        g, d = _shingles(data, offs, k)
        size = np.bincount(d, minlength=n_docs)
        sig = np.zeros((n_docs, COORDS), np.uint32)
        s1, s2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
        if len(g):
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            own = d[first]
            with np.errstate(over="ignore"):
                s1[own] = np.add.reduceat(T.mix(g), first)
                s2[own] = np.add.reduceat(T.mix(g ^ np.uint64(0x5851F42D4C957F2D)), first)
                for j in range(COORDS):
                    x = g * odd[j] + add[j]
                    x ^= x >> np.uint64(32)
                    x *= odd[(j + 1) % COORDS]
                    sig[own, j] = (np.minimum.reduceat(x >> np.uint64(8), first) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        flat = pa.array(sig.reshape(-1).view(np.int32))
        sigs = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * COORDS), flat)
        return {"d": rest.column(0), "n": size.astype(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64), "sig": sigs}
    return run


def _sigs(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().view(np.uint32).reshape(len(col), COORDS)


def _branch(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, set) rows: row and child; the coordinates depend on the node alone."""
    r = T.mix(node ^ np.uint64(0xA0761D6478BD642F))
    rows = np.arange(len(node))
    c1 = (r % np.uint64(COORDS)).astype(np.int64)
    second = (r >> np.uint64(40)) % np.uint64(4) == 0
    c2 = (c1 + 1 + ((r >> np.uint64(20)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
    out_rows, out = [], []
    for at, c in ((rows, c1), (rows[second], c2[second])):
        with np.errstate(over="ignore"):
            child = T.mix(node[at] * np.uint64(0x9E3779B97F4A7C15) + (sig[at, c].astype(np.uint64) << np.uint64(7)) + c.astype(np.uint64))
        out_rows.append(at), out.append(child)
    return np.concatenate(out_rows), np.concatenate(out)


def miss_chance(trees: int, depth: int, similarity: float = 0.8) -> float:
    """Chance that two sets share no node at ``depth`` in any of ``trees`` trees."""
    out = 0.0
    for agree in range(COORDS + 1):
        parted = 0.0
        for _ in range(depth):
            child = 1 - agree / COORDS * (1 - parted)
            parted = 0.75 * child + 0.25 * child * child
        out += comb(COORDS, agree) * similarity**agree * (1 - similarity)**(COORDS - agree) * parted**trees
    return out


def trees_at(depth: int) -> int:
    """Trees with which a pair of similarity 0.8 is missed at ``depth`` with a chance of at most ``MISS``."""
    return next(n for n in count(1) if miss_chance(n, depth) <= MISS)


def _grow(first: int, trees: int, depth: int):
    """``(d, sig)`` to the nodes at ``depth`` of the trees from ``first`` to before ``trees``."""
    def run(batches):
        for b in batches:
            sig, d = _sigs(b.column(1)), b.column(0).to_numpy()
            if not len(d):
                continue
            for tree in range(first, trees):
                rows, node = np.arange(len(d)), np.full(len(d), T.stream(1, 500 + tree)[0])
                for _ in range(depth):
                    at, node = _branch(node, sig[rows])
                    rows = rows[at]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(d[rows])], names=["node", "d"])
    return run


def _deeper(batches):
    """``(node, d, sig)`` to the node's children."""
    for b in batches:
        if not b.num_rows:
            continue
        node, d = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        rows, child = _branch(node, _sigs(b.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(d[rows])], names=["node", "d"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _leaf_pairs(batches):
    """Candidate pairs within nodes; rows ``(node, d, sig)`` come sorted by node, at most ``LEAF`` ids a node."""
    held = None
    for b in _and_end(batches):
        if b is None:
            if held is not None:
                yield from _pairs_of(*held)
            return
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), _sigs(b.column(2))]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last:
            yield from _pairs_of(*[x[:last] for x in cols])
        held = [x[last:] for x in cols]


def _and_end(batches):
    yield from batches
    yield None


def _pairs_of(node: np.ndarray, d: np.ndarray, sig: np.ndarray):
    # a node of at most ``LEAF`` ids holds more rows where ids repeat with different texts
    for k in count(1):
        at = np.flatnonzero(node[:-k] == node[k:]) if len(node) > k else np.zeros(0, np.int64)
        if not len(at):
            return
        at = np.concatenate([x[_agree(sig[x], sig[x + k]) >= SKETCH] for x in np.array_split(at, len(at) // 20_000 + 1)])
        if len(at):
            a, b = d[at], d[at + k]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _block_links(percent: int):
    """Links between two blocks of sets of different components, on the full sets.

    Common shingles are counted by matrix products over the shingles that both
    blocks hold, some thousand at a time.  One link from a set to another
    component is enough.
    """
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            sizes, flat = [], []
            for side in (left, right):
                sets = side["s"].to_list()
                sizes.append(np.array([len(x) for x in sets]))
                flat.append(np.concatenate(sets))
            both = np.intersect1d(*flat)
            rows, cols = [], []
            for size, x in zip(sizes, flat):
                at = np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0))
                ok = both[at] == x if len(both) else np.zeros(len(x), bool)
                rows.append(np.repeat(np.arange(len(size)), size)[ok]), cols.append(at[ok])
            common = np.zeros((len(left), len(right)), np.float32)
            for lo in range(0, len(both), 4096):
                part = []
                for size, r, c in zip(sizes, rows, cols):
                    m = np.zeros((len(size), min(4096, len(both) - lo)), np.float32)
                    here = (c >= lo) & (c < lo + 4096)
                    m[r[here], c[here] - lo] = 1
                    part.append(m)
                common += part[0] @ part[1].T
            union = sizes[0][:, None] + sizes[1][None, :] - common
            lc, rc = left["c"].to_numpy(), right["c"].to_numpy()
            i, j = np.nonzero((100 * common >= percent * union) & (lc[:, None] != rc[None, :]))
            if len(i):
                hit = pd.DataFrame({"i": i, "c": rc[j], "j": j}).drop_duplicates(["i", "c"])
                d, e = left["d"].to_numpy()[hit["i"]], right["d"].to_numpy()[hit["j"]]
                out.append(pd.DataFrame({"a": np.minimum(d, e), "b": np.maximum(d, e)}))
        return out[0] if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    return run


def _sets(k: int):
    def run(rest: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, valid: np.ndarray):
        g, d = _shingles(data, offs, k)
        return {"d": rest.column(0), "s": T.lists(d, len(offs) - 1, g.view(np.int64))[0]}
    return run


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the similarity; ``rows``: ``(d, x)``."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "ids")
    sets = stored(T.text_udf(bloom.semi_join(rows, ids, "d"), "x", ["d"], "d long, s array<long>", _sets(k)), "sets")
    sa, sb = sets.select(F.col("d").alias("a"), F.col("s").alias("sa")), sets.select(F.col("d").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    ok = 100 * common >= percent * (F.size("sa") + F.size("sb") - common)
    return stored(both.filter(ok).select("a", "b").distinct(), "links")


def _labels(links: DataFrame) -> DataFrame:
    return stored(components(links), "labels")


def _crossing(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    la = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    lb = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").filter(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80,
         trees: int = TREES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("x"))
    base = stored(T.text_udf(rows, "x", ["d"], "d long, n long, s1 long, s2 long, sig array<int>", _sketches(shingle)), "sketches")
    usable = base.filter("n > 0 and d is not null")
    classes = stored(usable.groupBy("s1", "s2", "n").agg(F.min("d").alias("rep")), "classes")
    own = stored(usable.select("d", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select("d", "rep").distinct(), "members")
    sig = usable.join(classes.withColumnRenamed("rep", "d"), ["d", "s1", "s2", "n"], "left_semi").select("d", "sig")
    sig = stored(sig, "signatures")

    few = sig.select("d", F.slice("sig", 1, PROBE).alias("few"))
    nodes = sig.mapInArrow(_grow(0, trees, START), "node long, d long").distinct()
    pairs, families = [], []
    for depth in range(START, LAST + 1):
        nodes = stored(nodes, "nodes")
        # the same sets meet in many nodes: one of them stands for all
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("d").cast("decimal(38,0)")).alias("f1"),
                                          F.bit_xor(F.xxhash64(F.lit(3), "d")).alias("f2"), F.min_by("d", F.xxhash64("node", "d")).alias("p")).filter("c > 1")
        sizes = stored(sizes.groupBy("c", "f1", "f2").agg(F.min(F.struct("node", "p")).alias("x")).select("x.node", "x.p", "c"), "sizes")
        leaves = nodes.join(sizes.filter(F.col("c") <= LEAF).select("node"), "node", "left_semi").join(sig, "d")
        leaves = leaves.select("node", "d", "sig").repartition("node").sortWithinPartitions("node", "d")
        pairs.append(stored(leaves.mapInArrow(_leaf_pairs, "a long, b long").distinct(), "pairs"))
        big = sizes.filter(F.col("c") > LEAF).select("node", "p")
        if not big.limit(1).count():
            break
        big = stored(nodes.join(big, "node").select("node", "d", "p"), "big")
        if depth == LAST:
            families.append(big)
            break
        # alike with its pivot, a node is a family of near copies, which branching would not part
        pivot = few.select(F.col("d").alias("p"), F.col("few").alias("pf"))
        alike = F.aggregate(F.zip_with("few", "pf", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / PROBE
        tight = big.join(few, "d").join(pivot, "p").groupBy("node").agg(F.avg(alike).alias("like")).filter(F.col("like") >= FAMILY).select("node")
        tight = stored(tight, "tight")
        families.append(big.join(tight, "node", "left_semi"))
        open_ = big.join(tight, "node", "left_anti").select("node", "d")
        nodes = open_.join(sig, "d").select("node", "d", "sig").mapInArrow(_deeper, "node long, d long")
        # a pair that is still open has both sets here: further trees for them make up for the depth
        more = max(trees, trees_at(depth + 1))
        if more > trees:
            again = stored(open_.select("d").distinct(), "again")
            nodes = nodes.unionByName(sig.join(again, "d", "left_semi").select("d", "sig").mapInArrow(_grow(trees, more, depth + 1), "node long, d long"))
        trees = more
        nodes = nodes.distinct()

    family = None
    if families:
        family = families[0]
        for f in families[1:]:
            family = family.unionByName(f)
        family = stored(family.select("node", "d", "p"), "families")
        star = family.filter("d <> p").select(F.least("d", "p").alias("a"), F.greatest("d", "p").alias("b"))
        pairs.append(stored(star.distinct(), "star"))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    found = stored(found.distinct(), "candidates")
    # first a set's smallest partner, which mostly connects it; then what is not connected yet
    first = found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(first, rows, shingle, percent)
    labels = _labels(links)
    more = verified(stored(_crossing(found, labels).distinct(), "crossing"), rows, shingle, percent)
    links = links.unionByName(more)
    if family is not None:
        labels = _labels(links)
        links = links.unionByName(_remaining(family, labels, rows, shingle, percent))
    labels = _labels(links)
    out = own.join(labels, own.rep == labels.id, "left").select("d", F.coalesce("component", "rep").alias("c"))
    # rows that repeat an id may lie in several classes
    out = out.groupBy("d").agg(F.min("c").alias("c")).withColumnRenamed("d", "_k")
    return base.select("d", "n").join(out, F.col("d") == F.col("_k"), "left").select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "d").alias("component_id"),
        F.coalesce(F.col("d") == F.coalesce("c", "d"), F.lit(True)).alias("kept"))


def _remaining(family: DataFrame, labels: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within families of near copies between sets that are not connected yet.

    Nodes with the same most frequent component are one family, in which a set
    stands once.  Sets of that component need no comparison with each other;
    every other set is compared with all sets of the family, block by block,
    on the full sets.
    """
    lab = labels.select(F.col("id").alias("d"), F.col("component").alias("k"))
    members = stored(family.select("node", "d").join(lab, "d", "left").select("node", "d", F.coalesce("k", "d").alias("c")), "labelled")
    top = members.groupBy("node", "c").count().groupBy("node").agg(
        F.max_by("c", F.struct("count", "c")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    top = top.filter("kinds > 1").select("node", "top")
    members = stored(members.join(top, "node").select("top", "d", "c").distinct(), "mixed")
    size = members.groupBy("top").agg((F.sum((F.col("c") != F.col("top")).cast("long")) / BLOCK).cast("long").alias("nl"),
                                      (F.count(F.lit(1)) / BLOCK).cast("long").alias("nr"))
    open_ = stored(members.join(size, "top"), "open")
    ids = stored(open_.select("d").distinct(), "ids")
    sets = stored(T.text_udf(bloom.semi_join(rows, ids, "d"), "x", ["d"], "d long, s array<long>", _sets(k)), "sets")

    def block(count: str):
        return F.pmod(F.xxhash64("d"), F.col(count) + 1)

    def every(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count)))

    # a task holds one block of each side
    left = open_.filter("c <> top").select("top", block("nl").alias("lb"), every("nr").alias("rb"), "d", "c").join(sets, "d")
    right = open_.select("top", every("nl").alias("lb"), block("nr").alias("rb"), "d", "c").join(sets, "d")
    names = ["top", "lb", "rb", "d", "c", "s"]
    left, right = left.select(*names).toDF(*names), right.select(*names).toDF(*names)
    links = left.groupBy("top", "lb", "rb").cogroup(right.groupBy("top", "lb", "rb")).applyInPandas(_block_links(percent), "a long, b long")
    return stored(links.distinct(), "links")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates of a document with a smaller id (five-word shingles).

    Only the ids that go are joined with the rows, and no text is shuffled for
    it (see :func:`bloom.anti_join`); rows with a null id stay.
    """
    gone = link(docs.select("doc_id", "text"), shingle=shingle).filter("not kept")
    gone = stored(gone.select(F.col("doc_id").cast("long").alias("_n_id")).distinct(), "gone")
    return bloom.anti_join(docs.withColumn("_n_id", F.col("doc_id").cast("long")), gone, "_n_id").drop("_n_id")


#: for small tables (all pairs that share a shingle)
OP4_SQL_SMALL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
q AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, q.b FROM r JOIN q ON r.b = q.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept
FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.s)
"""
