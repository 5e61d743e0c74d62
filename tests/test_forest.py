"""Forests of unlimited depth: growth against a plain tree, routing, blocks, SQL walk, determinism."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolake.ml import forest as FO
from hydrolake.ml import isolation as ISO
from hydrolake.session import scratch_path


def plain_tree(x, y, w):
    """Best split over all features and thresholds, recursively, to purity; returns a predictor."""
    if (y == y[0]).all():
        return lambda r: y[0]
    best = None
    mean = np.average(y, weights=w)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for a, b in zip(v[:-1], v[1:]):
            left = x[:, f] <= a
            gain = sum(w[s].sum() * (np.average(y[s], weights=w[s]) - mean) ** 2 for s in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2, left)
    if best is None:
        return lambda r: mean
    _, f, t, left = best
    lo, hi = plain_tree(x[left], y[left], w[left]), plain_tree(x[~left], y[~left], w[~left])
    return lambda r: lo(r) if r[f] <= t else hi(r)


def test_growth_equals_a_plain_recursive_tree():
    rng = np.random.default_rng(3)
    for trial in range(20):
        n = int(rng.integers(1, 60))
        x = rng.integers(0, 6, (n, 3)).astype(float)
        y = np.round(rng.normal(size=n), 2)
        w = rng.integers(1, 4, n).astype(float)
        t = FO.grow(x, y, w)
        want = plain_tree(x, y, w)
        probe = rng.uniform(-1, 7, (200, 3))
        got = t.threshold[FO.descend(t, probe)]
        # equal gains may be split in another order: compare on the training rows, where every order agrees
        assert np.allclose(t.threshold[FO.descend(t, x)], [want(r) for r in x])
        assert np.isfinite(got).all()
        assert t.size[0] == w.sum() and t.size[t.feature < 0].sum() == w.sum()


def test_unique_gains_give_the_same_splits():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(80, 2)), rng.normal(size=80)
    t = FO.grow(x, y, np.ones(80))
    want = plain_tree(x, y, np.ones(80))
    probe = rng.normal(size=(500, 2))
    assert np.allclose(t.threshold[FO.descend(t, probe)], [want(r) for r in probe])


def test_labels_that_differ_by_rounding_only_are_not_split():
    """One quotient computed for many rows: its last bits are no reason to grow chains of nodes."""
    rng = np.random.default_rng(5)
    demand, step = rng.uniform(1, 400, 6000), rng.integers(0, 3, 6000)
    ratio = 0.3 + step / 100.0
    y = demand * ratio / demand * 100.0
    assert len(np.unique(y)) > 3
    t = FO.grow(np.column_stack([step.astype(float), demand]), y, np.ones(6000))
    assert t.depth <= 2 and len(t.feature) == 5
    x = np.column_stack([demand, demand * ratio])
    t = FO.grow(x, y, np.ones(6000))
    assert len(t.feature) < 1200        # 887; 2519 where rounding is split as well
    assert np.allclose(t.threshold[FO.descend(t, x)], y, rtol=1e-14, atol=0)


def test_a_node_of_close_labels_is_split_as_well_as_any_other():
    """The best cut is found however far the labels are from zero and however close to each other."""
    x = np.arange(64, dtype=float)[:, None]
    for scale, shift in ((1.0, 0.0), (2.0**-40, 50.0), (2.0**40, -3.0)):
        t = FO.grow(x, (x[:, 0] >= 32) * scale + shift, np.ones(64))
        assert (t.depth, len(t.feature), t.threshold[0]) == (1, 3, 31.5)
    # beside a node of far labels
    y = np.where(x[:, 0] < 32, (x[:, 0] >= 16) * 2.0**-40 + 1.0, (x[:, 0] >= 48) * 1e6 + 1e7)
    t = FO.grow(x, y, np.ones(64))
    assert t.depth == 2 and sorted(t.threshold[t.feature >= 0]) == [15.5, 31.5, 47.5]


def test_features_that_follow_an_earlier_one_are_not_sorted_and_change_no_tree():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 40, 500).astype(float), rng.normal(size=500)
    x = np.column_stack([a, b, a * 3 - 1, np.minimum(a, 7.0), np.full(500, 2.0), -b, np.where(a == 9, b, a)])
    y = np.round(a % 5 + b, 3)
    w = rng.integers(1, 4, 500)
    order = FO._orders([np.ascontiguousarray(c) for c in x.T], None)
    assert [o is None for o in order] == [False, False, True, True, True, False, False]
    assert not any(o is None for o in FO._orders([np.ascontiguousarray(c) for c in x.T], 2))
    t, u = FO.grow(x, y, w), FO.grow(x[:, [0, 1, 5, 6]], y, w)
    assert np.array_equal(np.r_[0, 1, 5, 6][u.feature[u.feature >= 0]], t.feature[t.feature >= 0])
    assert np.array_equal(t.threshold, u.threshold) and np.array_equal(t.child, u.child)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(6000, 3)), 2)
    y = np.round(np.sin(x[:, 0] * 2) * 10 + x[:, 1] ** 2 + rng.normal(size=6000) * 0.1, 2)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3).checkpoint()


COLS = ["a", "b", "c"]


def test_purity_without_bootstrap_by_both_routes(spark, table):
    """Broadcast rows and routed parts: a row's prediction is the mean label of the rows equal to it."""
    want = {r["id"]: r["m"] for r in table.selectExpr("id", "avg(y) OVER (PARTITION BY a, b, c) AS m").collect()}
    for small in (10_000, 300):
        m = FO.fit_forest(table, COLS, "y", 4, 7, key=["id"], small=small, bootstrap=False)
        assert bool(m.tops) == (small == 300)
        got = {r["id"]: r["p"] for r in FO.score_forest(table, m, "p").collect()}
        assert got.keys() == want.keys()
        assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_forest_does_not_depend_on_the_layout(spark, table):
    a = FO.fit_forest(table, COLS, "y", 5, 7, key=["id"], small=500)
    b = FO.fit_forest(table.repartition(7, "c"), COLS, "y", 5, 7, key=["id"], small=500)
    cols = ["tree", "part", "node", "feature", "threshold", "left", "size"]
    assert sorted(map(tuple, a.nodes(spark).select(cols).collect())) == sorted(map(tuple, b.nodes(spark).select(cols).collect()))


def test_blocks_give_the_same_scores(spark, table):
    m = FO.fit_forest(table, COLS, "y", 6, 7, key=["id"], small=700)
    whole = {r["id"]: r["p"] for r in FO.score_forest(table, m, "p").collect()}
    tiny = {r["id"]: r["p"] for r in FO.score_forest(table, m, "p", limit=40_000).collect()}
    assert len(FO._blocks(m, spark, 40_000)) > 3
    assert max(abs(whole[i] - tiny[i]) for i in whole) < 1e-9


def test_rows_routed_to_parts_score_like_blocks_and_like_one_broadcast(spark, table):
    """Trees with and without a top, by all three ways; odd rows and equal rows keep their number."""
    odd = table.unionByName(table.limit(50)).unionByName(spark.createDataFrame(
        [(-1, None, 0.5, float("nan"), 0.0), (-2, float("inf"), None, 1.0, 0.0)], table.schema))
    for small in (700, 10_000):
        m = FO.fit_forest(table, COLS, "y", 6, 7, key=["id"], small=small)
        want = sorted((r["id"], r["s"]) for r in FO._finish(FO._score_blocks(odd, m, "t", FO._blocks(m, spark, 1 << 30)), m, "t", "s").collect())
        parts = FO._blocks(m, spark, 40_000)
        path = scratch_path(spark, "odd")
        odd.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        routed = FO._score_routed(spark.read.parquet(path), m, "t")
        assert routed.columns == [*odd.columns, "t"]
        for got in (FO._score_blocks(odd, m, "t", parts), routed):
            have = sorted((r["id"], r["s"]) for r in FO._finish(got, m, "t", "s").collect())
            assert [i for i, _ in have] == [i for i, _ in want] and len(have) == 6052
            assert max(abs(a - b) for (_, a), (_, b) in zip(have, want)) < 1e-9


def test_a_large_forest_is_scored_without_passing_its_rows_once_a_block(spark, table, monkeypatch):
    m = FO.fit_forest(table, COLS, "y", 6, 7, key=["id"], small=700)
    assert len(FO._blocks(m, spark, 40_000)) > 3
    monkeypatch.setattr(FO, "_load", None)      # no block is loaded
    assert FO.score_forest(table, m, "p", limit=40_000).count() == 6000


def test_a_walk_over_many_parts_is_as_one_tree(spark, table):
    """Rows walk down all parts of a tree together, not part by part."""
    m = FO.fit_forest(table, COLS, "y", 1, 7, key=["id"], small=300)
    trees = FO._load(m, spark, FO._blocks(m, spark, 1 << 30)[0])
    assert len(trees) == 1 and (trees[0][1] >= 0).sum() > 10
    # what is broadcast names no class of this package: workers need no copy of it
    assert b"hydrolake" not in __import__("pickle").dumps((trees, FO._plain(m.tops)))


def test_scores_equal_a_walk_over_the_node_table_in_sql(spark, table, tmp_path):
    """Exported nodes, walked by a recursive query, give every row's prediction."""
    m = FO.fit_forest(table, COLS, "y", 5, 7, key=["id"], small=900)
    got = {r["id"]: r["p"] for r in FO.score_forest(table, m, "p").collect()}
    m.nodes(spark).toPandas().to_parquet(tmp_path / "nodes.parquet")
    table.toPandas().to_parquet(tmp_path / "rows.parquet")
    rows = duckdb.sql(f"""
      WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes.parquet'), r AS (SELECT * FROM '{tmp_path}/rows.parquet'),
      walk AS (
        SELECT id, a, b, c, tree, 0 AS part, 0 AS node FROM r, (SELECT DISTINCT tree FROM n)
        UNION ALL
        SELECT w.id, w.a, w.b, w.c, w.tree, CASE WHEN n.feature = -2 THEN n."left" ELSE w.part END,
          CASE WHEN n.feature = -2 THEN 0 WHEN [w.a, w.b, w.c][n.feature + 1] <= n.threshold THEN n."left" ELSE n."right" END
        FROM walk w JOIN n ON n.tree = w.tree AND n.part = w.part AND n.node = w.node WHERE n.feature <> -1)
      SELECT id, avg(n.value) FROM walk w JOIN n ON n.tree = w.tree AND n.part = w.part AND n.node = w.node
      WHERE n.feature = -1 GROUP BY id""").fetchall()
    assert len(rows) == 6000
    assert max(abs(got[i] - v) for i, v in rows) < 1e-9


def test_depth_limit_holds_through_the_parts(spark, table):
    m = FO.fit_forest(table, COLS, "y", 2, 7, key=["id"], small=300, max_depth=5)
    assert m.nodes(spark).filter("feature = -1").groupBy("tree").count().agg(F.max("count")).first()[0] <= 32


def test_classes_and_rows_without_features(spark):
    rows = [(i, float(i % 10), float(i % 3), float(i % 10 >= 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    m = FO.fit_forest(df, ["a", "b"], "y", 9, 1, key=["id"], tries=1, classes=True)
    assert FO.score_forest(df, m, "p").filter("p <> y").count() == 0
    odd = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (None, None)], "a double, b double")
    assert FO.score_forest(odd, m, "p").filter("p IN (0, 1)").count() == 3
    with pytest.raises(ValueError):
        FO.fit_forest(df.filter("id < 0"), ["a", "b"], "y", 2, 1)


def test_saved_forest_scores_alike(spark, table):
    m = FO.fit_forest(table, COLS, "y", 3, 7, key=["id"], small=1500)
    path = scratch_path(spark, "forest-save")
    FO.save(spark, m, path)
    again = FO.load(spark, path)
    a = FO.score_forest(table, m, "p").select("id", "p").collect()
    b = FO.score_forest(table, again, "p").select("id", "p").collect()
    assert sorted(a) == sorted(b) and again.num_trees == 3


def test_isolation_forest_is_drawn_map_side_and_by_key(spark, table):
    tagged = ISO._tree_sample(table, COLS, ISO.record_key(table, ["id"]), 6000, 50, 256, 42)
    assert "Exchange" not in tagged._jdf.queryExecution().executedPlan().toString()
    per_tree = {r["tree_id"]: r["count"] for r in tagged.groupBy("tree_id").count().collect()}
    assert len(per_tree) == 50 and min(per_tree.values()) >= 230
    a = ISO.fit_isolation_forest(table, COLS, n_trees=20, key=["id"])
    b = ISO.fit_isolation_forest(table.repartition(9, "b"), COLS, n_trees=20, key=["id"])
    order = ["tree_id", "node_id"]
    assert a.cut == b.cut
    assert a.nodes.sort_values(order).reset_index(drop=True).equals(b.nodes.sort_values(order).reset_index(drop=True))


def _walk(spark, m, tree):
    """A tree from its root on, left before right, however it is cut into parts."""
    parts = {r["part"]: FO._unpack(r) for r in m.parts(spark).filter(F.col("tree") == tree).collect()}
    out, todo = [], [(0, 0)]
    while todo:
        p, i = todo.pop()
        t = parts[p]
        if t.feature[i] == FO.HANDED:
            todo.append((int(t.child[i]), 0))
            continue
        out.append((int(t.feature[i]), int(t.size[i]), t.threshold[i], t.value[i]))
        if t.feature[i] >= 0:
            todo += [(p, int(t.child[i]) + 1), (p, int(t.child[i]))]
    return out


@pytest.mark.parametrize("kw", [{}, {"tries": 2}, {"max_depth": 7}, {"bootstrap": False}], ids=str)
def test_trees_do_not_depend_on_the_size_of_the_table(spark, table, kw):
    """Whole trees, trees in parts and splits over sorted chunks: every node is the same, none stands on a sample."""
    wide = table.withColumn("d", F.col("a") * 3 - 1).withColumn("e", F.least("b", F.lit(0.5)))      # followers of a and b
    cols = ["a", "d", "b", "c", "e"]
    ways = ({}, {"small": 300}, {"small": 100, "whole": 0, "chunk": 700})
    whole, cut, sent = (FO.fit_forest(wide, cols, "y", 2, 7, key=["id"], **kw, **way) for way in ways)
    assert not whole.tops and len(cut.tops) == len(sent.tops) == 2
    for tree in range(2):
        want = _walk(spark, whole, tree)
        for m in (cut, sent):
            got = _walk(spark, m, tree)
            assert [n[:2] for n in got] == [n[:2] for n in want] and len(got) > 100
            assert np.allclose([n[2:] for n in got], [n[2:] for n in want], rtol=1e-12, atol=1e-12)


def test_splits_over_sorted_chunks_of_odd_columns(spark):
    """One value in a third of the rows, infinite values, a constant, equal keys and labels that hardly differ."""
    rng = np.random.default_rng(2)
    n = 3000
    a = np.where(rng.random(n) < 0.33, 1.5, np.round(rng.normal(size=n), 1))
    b = rng.choice([-np.inf, -1.0, 0.0, 2.0, np.inf], n)
    y = np.round(a * 3, 2) + (b > 0) * 2.0**-38
    rows = [(int(i // 2), float(p), float(q), 4.0, float(v)) for i, (p, q, v) in enumerate(zip(a, b, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    whole = FO.fit_forest(df, ["a", "b", "c"], "y", 2, 3, key=["id"])
    sent = FO.fit_forest(df, ["a", "b", "c"], "y", 2, 3, key=["id"], small=20, whole=0, chunk=256)
    assert len(sent.tops) == 2
    for tree in range(2):
        got, want = (_walk(spark, m, tree) for m in (sent, whole))
        assert [n[:2] for n in got] == [n[:2] for n in want]
        assert np.allclose([n[2:] for n in got], [n[2:] for n in want], rtol=1e-14, atol=0)


def test_only_features_that_follow_an_earlier_one_everywhere_are_left_out(spark):
    rows = [(i, float(i % 40), float(-(i % 40)), float(i % 40 // 3), float(i % 40 if i != 1999 else -5), float(i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "_key long, u double, down double, up double, almost double, other double")
    assert FO._independent(df, ["u", "down", "up", "almost", "other"]) == [0, 1, 3, 4]
