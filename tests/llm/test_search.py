"""Near duplicates and repeated passages against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from hydrolake.llm import common, neardup, passages
from tests.llm.helpers import brute_links, components, frame, messy_rows, near, prose, shingles, words


def family_rows():
    rows = messy_rows()
    for f in range(6):
        base = prose(100 + f, 60 + 40 * f)
        rows += [(1000 + 50 * f + i, near(base, 31 * f + i, i), "en", "a", 1) for i in range(14)]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = family_rows()
    got = {r.doc_id: r for r in neardup.link(frame(spark, rows), shingle=k).filter("doc_id is not null").collect()}
    want = components([r[0] for r in rows if r[0] is not None], brute_links([(r[0], r[1]) for r in rows], k))
    assert {i: r.component_id for i, r in got.items()} == want
    for i, text, *_ in rows:
        if i is not None:
            assert got[i].n_shingles == len(shingles(text, k)) and got[i].kept == (want[i] == i)


def test_near_duplicates_large_family(spark, monkeypatch):
    """A family far beyond a leaf, with stragglers that only some members link."""
    monkeypatch.setattr(neardup, "LEAF", 6)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    base = prose(7, 90)
    rows = [(i, near(base, i, 1 + i % 7), "en", "a", 1) for i in range(150)]
    rows += [(500 + i, near(near(base, i, 4), 900 + i, 5), "en", "a", 1) for i in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.link(frame(spark, rows)).collect()}
    assert got == components([r[0] for r in rows], brute_links([(r[0], r[1]) for r in rows], 2))


def test_near_duplicates_nulls_repeats_empty(spark):
    base = prose(5, 80)
    docs = frame(spark, [(None, base, "", "", 1), (None, None, "", "", 1), (3, base, "", "", 1), (3, base, "", "", 1), (2, near(base, 1, 1), "", "", 1)])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.link(docs).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    assert neardup.link(frame(spark, [])).count() == 0
    kept = neardup.one_of_each(docs)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2] and kept.columns == docs.columns


def test_near_duplicates_deep_trees_meet_the_stated_chance():
    """Pairs of similarity 0.8 share a node at every depth that stays open, not only at the first."""
    rng = np.random.default_rng(3)
    n = 4000
    a = rng.integers(0, 1 << 32, (n, neardup.COORDS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    sigs = pa.ListArray.from_arrays(pa.array(np.arange(2 * n + 1, dtype=np.int32) * neardup.COORDS), pa.array(np.r_[a, b].reshape(-1).view(np.int32)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(n), np.arange(n)]), sigs], names=["d", "sig"])
    for depth in (4, neardup.LAST):
        met, trees = np.zeros(n, bool), neardup.trees_at(depth)
        assert neardup.miss_chance(trees, depth) <= neardup.MISS < neardup.miss_chance(neardup.TREES, depth)
        for out in neardup._grow(0, trees, depth)([batch]):
            _, at, size = np.unique(np.c_[out.column(0).to_numpy(), out.column(1).to_numpy()], axis=0, return_index=True, return_counts=True)
            met[out.column(1).to_numpy()[at[size > 1]]] = True
        assert (~met).sum() <= 1


def test_near_duplicates_grow_trees_with_the_depth(spark, monkeypatch):
    """Sets around one common passage stay in large nodes: each depth gets the trees it needs."""
    grown = []
    grow = neardup._grow
    monkeypatch.setattr(neardup, "_grow", lambda *a: grown.append(a) or grow(*a))
    monkeypatch.setattr(neardup, "LEAF", 3)
    monkeypatch.setattr(neardup, "LAST", 4)
    common = prose(8, 30)
    rows = [(2 * i + j, near(common + " " + prose(3000 + i, 60), j, j), "", "", 1) for i in range(25) for j in range(2)]
    got = {r.doc_id: r.component_id for r in neardup.link(frame(spark, rows)).collect()}
    assert got == components([r[0] for r in rows], brute_links([(r[0], r[1]) for r in rows], 2))
    assert [a[1:] for a in grown] == [(neardup.trees_at(d), d) for d in (2, 3, 4)]


def test_near_duplicates_leaf_with_repeated_ids():
    """A leaf of few ids may hold more than ``LEAF`` rows: the first and the last are still compared."""
    n = 3 * neardup.LEAF
    sig = np.random.default_rng(4).integers(0, 1 << 32, (n, neardup.COORDS), dtype=np.uint32)
    sig[-1] = sig[0]
    d = np.r_[1, np.repeat(2, n - 2), 3]
    got = [p for b in neardup._pairs_of(np.zeros(n, np.int64), d, sig) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [(1, 3)]


def test_components(spark):
    import random

    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if i in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows_equal_cartesian_tree():
    rng = np.random.default_rng(2)
    for n, width in ((5, 3), (60, 8), (200, 15), (37, 37)):
        x = rng.integers(1, 40, n).astype(np.uint64)
        x[rng.random(n) < 0.03] = 0

        want = []

        def tree(lo, hi):
            if hi - lo < width:
                return
            c = lo + int(np.argmin(x[lo:hi]))
            if x[c]:
                want.append((c, lo, hi - 1))
            tree(lo, c), tree(c + 1, hi)

        tree(0, n)
        got = sorted(zip(*(v.tolist() for v in passages.compact_windows(x, width))))
        assert got == sorted(want)


def passage_rows():
    shared, other = prose(50, 70), prose(51, 55)
    rows = messy_rows()
    rows += [(100, prose(60, 200) + " " + shared + " " + prose(61, 30), "", "", 1), (101, shared + " " + prose(62, 400), "", "", 1),
             (102, prose(63, 90) + " " + near(shared, 5, 1), "", "", 1), (103, prose(64, 300), "", "", 1),
             (104, other + " " + other, "", "", 1), (105, prose(65, 40) + " " + other, "", "", 1),
             (106, prose(66, 60) + " " + " ".join(shared.split()[:30]) + " " + prose(67, 60), "", "", 1)]
    return rows


def test_passages(spark):
    rows = passage_rows()
    text = {i: words(t) for i, t, *_ in rows if i is not None}
    got = passages.repeated_passages(frame(spark, rows)).collect()
    pairs = {(r.doc_id, r.match_doc_id) for r in got}
    assert {(101, 100), (105, 104), (1, 0), (2, 0), (3, 0)} <= pairs
    assert 102 in {i for p in pairs for i in p}
    assert not {103, 106, 10, 16} & {i for p in pairs for i in p}
    for r in got:
        a = shingles(" ".join(text[r.doc_id][r.start_word:r.start_word + r.n_words]), 5)
        b = shingles(" ".join(text[r.match_doc_id][r.match_start_word:r.match_start_word + r.match_n_words]), 5)
        assert r.n_words >= 50 and len(a & b) >= 0.8 * len(a | b)
        assert abs(r.similarity - len(a & b) / len(a | b)) < 1e-9


def test_passages_find_all_exact_repeats(spark):
    from collections import defaultdict

    pool = [prose(500 + i, 60) for i in range(5)]
    rows = [(i, prose(i, 20 + i % 90) + " " + (pool[i % 5] + " " if i % 3 else "") + prose(1000 + i, 30), "", "", 1) for i in range(120)]
    where = defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        for p in range(len(w) - 49):
            where[tuple(w[p:p + 50])].add(i)
    want = set().union(*[s for s in where.values() if len(s) > 1])
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {x for r in got for x in (r.doc_id, r.match_doc_id)} == want


def test_passages_of_many_versions_of_one_notice(spark):
    """Each version stands in two documents; the smallest ids of a group mostly hold other versions."""
    import random

    r = random.Random(11)
    ids = r.sample(range(1000), 240)
    rows, notice = [], prose(70, 50).split()
    for v in range(120):
        text = list(notice)
        text[16], text[33] = f"name{v}", f"place{v}"
        rows += [(i, prose(5000 + i, 60) + " " + " ".join(text) + " " + prose(7000 + i, 60), "", "", 1) for i in ids[2 * v:2 * v + 2]]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {i for r in got for i in (r.doc_id, r.match_doc_id)} == set(ids)


@pytest.mark.parametrize("swapped", [False, True])
def test_passages_of_unequal_sides(spark, swapped):
    """52 words and the same without two neighbouring ones: 42 common shingles of 48 and 46."""
    whole = [f"word{i}" for i in range(52)]
    sides = [prose(180 + len(w), 40) + " " + " ".join(w) + " " + prose(81 + len(w), 40) for w in (whole, whole[:24] + whole[26:])]
    rows = [(i, t, "", "", 1) for i, t in zip((2, 1) if swapped else (1, 2), sides)]
    got = passages.repeated_passages(frame(spark, rows), hashes=24).collect()
    assert {(r.doc_id, r.match_doc_id) for r in got} == {(2, 1)}


def test_passages_recall_of_near_passages(spark):
    """100 pairs of 50-word passages with one word changed (41 of 51 shingles agree)."""
    rows = []
    for i in range(100):
        p = prose(20_000 + i, 50).split()
        q = [*p[:20], f"changed{i}", *p[21:]]
        rows += [(2 * i + j, prose(30_000 + 2 * i + j, 20) + " " + " ".join(w) + " " + prose(40_000 + 2 * i + j, 20), "", "", 1) for j, w in enumerate((p, q))]
    got = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert {(2 * i + 1, 2 * i) for i in range(100)} <= got


def test_passages_at_a_second_place(spark):
    """The smallest document holds half of the passage earlier, and the other one holds it twice, far apart."""
    shared = prose(90, 60)
    half = " ".join(shared.split()[:45])
    rows = [(1, half + " " + prose(91, 80) + " " + shared + " " + prose(92, 50), "", "", 1),
            (2, shared + " " + prose(93, 110) + " " + shared + " " + prose(94, 30), "", "", 1)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {r.start_word for r in got if r.n_words >= 58 and 120 <= r.match_start_word <= 127} >= {0, 170}


def test_agreements_of_a_repeated_passage():
    """One side holds the passage twice, more than 1.5 lengths apart."""
    a, far = np.arange(1, 51), np.arange(500, 600)
    got = passages.agreements(a, np.r_[a, far, a], 46, 80)
    assert {(lo, hi, lo2, hi2) for lo, hi, lo2, hi2, _ in got} == {(0, 50, 0, 50), (0, 50, 150, 200)}


def test_agreements_trim_what_fails():
    """A passage with strays behind it on one side is found without them; on both sides alike."""
    a = np.arange(1, 61)
    b = np.r_[a[:50], np.arange(900, 915), a[50:52], np.arange(950, 990)]
    x = np.r_[a, np.arange(500, 540)]
    for one, two in ((x, b), (b, x)):
        (lo, hi, lo2, hi2, similarity), = passages.agreements(one, two, 46, 80)
        assert (lo, lo2) == (0, 0) and min(hi, hi2) >= 50 and similarity >= 0.8


def _regions(n):
    """Pairs of shingle sequences, half of them sharing a stretch with some of it replaced, some of few distinct shingles."""
    rng = np.random.default_rng(7)
    pool = rng.integers(-2**63, 2**63 - 1, 4000)
    for i in range(n):
        known = pool[:rng.choice([20, 60, 4000])]
        x, y = (rng.choice(known, k) for k in rng.integers(1, 300, 2))
        k = min(len(x), len(y), int(rng.integers(40, 200)))
        if i % 2:
            a, b = rng.integers(0, len(x) - k + 1), rng.integers(0, len(y) - k + 1)
            y[b:b + k] = np.where(rng.random(k) < rng.choice([0, .05, .1, .2]), rng.choice(known, k), x[a:a + k])
        yield x, y


def test_rows_not_worth_comparing_hold_no_passage():
    """Looking at many regions at once leaves out none that holds a passage, and most that hold none."""
    rows = list(_regions(400))
    ox, oy = (np.r_[0, np.cumsum([len(r[i]) for r in rows])] for i in (0, 1))
    worth = passages.worth_comparing(*(np.concatenate([r[0] for r in rows]), ox), *(np.concatenate([r[1] for r in rows]), oy), 46, 80)
    found = np.array([bool(passages.agreements(x, y, 46, 80)) for x, y in rows])
    assert found.sum() > 50 and not (found & ~worth).any() and (~found & ~worth).sum() > 0.6 * (~found).sum()
    none = np.zeros(0, np.int64)
    assert passages.worth_comparing(none, np.zeros(3, int), np.arange(50), np.array([0, 0, 50]), 46, 80).tolist() == [False, False]


def test_passages_of_an_id_with_a_copy_and_another_text(spark):
    """Only the copy is set aside; the id's other text is searched, whichever of the two hashes is smaller."""
    rows = []
    for i in range(0, 40, 4):
        same, shared = prose(600 + i, 80), prose(700 + i, 60)
        rows += [(i, same, "", "", 1), (i + 2, same, "", "", 1), (i + 2, prose(800 + i, 30) + " " + shared, "", "", 1),
                 (i + 1, shared + " " + prose(900 + i, 30), "", "", 1)]
    got = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert got == {p for i in range(0, 40, 4) for p in ((i + 2, i), (i + 2, i + 1))}


def test_passages_empty(spark):
    assert passages.repeated_passages(frame(spark, [])).count() == 0
    assert passages.repeated_passages(frame(spark, [(None, prose(1, 90), "", "", 1), (1, None, "", "", 1), (None, prose(1, 90), "", "", 1)])).count() == 0


def test_text_joins_beyond_broadcast(spark, monkeypatch):
    from hydrolake.llm import bloom

    rows = spark.range(2000).withColumnRenamed("id", "d").selectExpr("d", "cast(d as string) AS x")
    keys = spark.range(0, 2000, 7).withColumnRenamed("id", "d")
    for small in (10**6, 0):
        monkeypatch.setattr(bloom, "SMALL_KEYS", small)
        assert {r.d for r in bloom.semi_join(rows, keys, "d").collect()} == set(range(0, 2000, 7))
        assert {r.d for r in bloom.anti_join(rows, keys, "d").collect()} == set(range(2000)) - set(range(0, 2000, 7))
