"""Top products and hard negatives against plain loops; bounds, ties, copies and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconfold.llm import hard_negatives as hn, mtree, queries, vectors
from differential import assert_same, connect

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def integers(v):
    return [math.floor(256 * x) for x in v]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))  # of the shorter length: the rest is zeros


def in_order(pairs):
    return sorted(pairs, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def top_products(rows, every, k=5):
    have, out = [(i, integers(v)) for i, v, _ in rows if usable(v)], []
    for i, q in have:
        if i is not None and i % every == 0:
            best = in_order((product(q, v), j) for j, v in have if j != i)[:k]
            out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def negatives(rows, every, k=5):
    have, out = [(i, integers(v), l) for i, v, l in rows if usable(v) and l is not None], []
    for i, q, label in have:
        if i is None or i % every:
            continue
        scored = [(product(q, v), j, l) for j, v, l in have if j != i]
        for ps, p in in_order((s, j) for s, j, l in scored if l == label)[:k]:
            fit = in_order((s, j) for s, j, l in scored if l != label and 80 * ps <= 100 * s <= 100 * ps)[:k]
            out += [(i, p, rank + 1, j, ps, s) for rank, (s, j) in enumerate(fit)]
    return sorted(out, key=str)


def table(seed, n=400, dim=6, copies=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)) / 2
    x[: n // 3] = x[0]  # one vector holds a third of all rows
    if seed % 2:
        x = np.round(x, 1)  # ties
    labels = rnd.integers(0, 4, n)
    return [(int(i), [float(np.float32(c)) for c in v], int(l)) for i, v, l in zip(rnd.permutation(n), x, labels)]


AWKWARD = [
    (None, [1.0] * 6, 1), (None, None, 1), (5, None, 2), (10, [0.5, None, 1.0, 1.0, 1.0, 1.0], 1), (20, [float("nan")] * 6, 1), (30, [float("inf")] * 6, 1),
    (40, [], 1), (50, [2.0, 1.0], 0), (60, [0.25] * 9, 0), (60, [0.25] * 9, 0), (100, [0.1] * 6, None), (-20, [0.3] * 6, 3),
]


@pytest.mark.parametrize("seed", range(4))
def test_top_products(spark, seed):
    rows = table(seed) + (AWKWARD if seed > 1 else [])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rank", "1 as score", "2 as tree", "3 as q").repartition(3)
    index = mtree.build_index(df, tree_rows=60)
    assert index.trees.count() > 3 and index.trees.agg(F.max(F.size("ids"))).first()[0] < 130  # a third of the rows are copies
    got = mtree.search(index, df.where("vec_id % 10 = 0"), 5, block=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == top_products(rows, 10)


@pytest.mark.parametrize("seed", range(4))
def test_hard_negatives(spark, seed):
    rows = table(seed) + (AWKWARD if seed > 1 else [])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as n", "1 as anchor", "2 as score").repartition(3)
    got = hn.mine_hard_negatives(df, F.col("vec_id") % 20 == 0, block=8)
    assert sorted(map(tuple, got.collect()), key=str) == negatives(rows, 20)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mtree.search(mtree.build_index(none), none, 5).count() == 0
    assert hn.mine_hard_negatives(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], SCHEMA)
    assert [tuple(r) for r in mtree.search(mtree.build_index(one), one.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 131072)]
    assert hn.mine_hard_negatives(one, F.lit(True)).count() == 0  # positives, but no other label


def test_products_beyond_doubles(spark):
    rows = [(i, [float(1 << 19) * (i + 1), 3.0 + i, -1.0], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = mtree.build_index(df)
    assert not index.exact
    assert sorted(map(tuple, mtree.search(index, df, 5).collect()), key=str) == top_products(rows, 1)
    assert sorted(map(tuple, hn.mine_hard_negatives(df, F.lit(True)).collect()), key=str) == negatives(rows, 1)


def tree_of(rows, **sizes):
    norm = float(np.square(rows).sum(1).max())
    return mtree.build_tree(rows, np.arange(len(rows)), norm, **sizes), norm


def test_tree_keeps_its_bounds():
    rnd = np.random.default_rng(4)
    rows = np.concatenate([rnd.integers(-300, 300, (700, 5)), np.full((300, 5), 7)])
    t, _ = tree_of(rows, leaf=16, fanout=4)
    assert sorted(t.ids.tolist()) == list(range(1000))
    full = np.concatenate([t.rows, t.lift[:, None]], 1)

    def below(node):
        if t.leaf[node]:
            assert 0 < t.last[node] - t.first[node] <= 16
            here = np.arange(t.first[node], t.last[node])
            assert np.allclose(t.to_route[here], np.linalg.norm(full[here] - full[t.routes[node]], axis=1))
            return here
        children = t.entries[t.first[node] : t.last[node]]
        assert 1 < len(children) <= 4
        for c in children:
            assert t.to_parent[c] == pytest.approx(np.linalg.norm(full[t.routes[c]] - full[t.routes[node]]))
        here = np.concatenate([below(c) for c in children])
        assert t.radius[node] == pytest.approx(np.linalg.norm(full[here] - full[t.routes[node]], axis=1).max())
        return here

    assert len(below(0)) == 1000


def test_bounds_spare_products():
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-2000, 2000, (40, 16))
    rows = (centres[rnd.integers(0, 40, 8000)] + rnd.integers(-20, 20, (8000, 16))).astype(np.int64)
    t, norm = tree_of(rows)
    find = mtree.Search(t, norm, True)
    for q in rows[::400]:
        scores, ids = find.nearest(q, -1, 5, None)
        want = mtree.top(rows @ q, np.arange(8000), 5)
        assert ids == want.tolist() and scores == (rows @ q)[want].tolist()
    assert find.products < 20 * 8000 / 4  # most are ruled out
    bounded = mtree.Search(t, norm, True)
    for q in rows[::400]:
        bounded.nearest(q, -1, 5, int(np.sort(rows @ q)[-5]))
    assert bounded.products <= find.products


def test_discards_lose_nothing():
    rnd = np.random.default_rng(6)
    spread = np.diag([400, 200, 90, 40, 20, 10, 5, 2])
    rows, asked = (rnd.normal(size=(500, 8)) @ spread).astype(np.int64), (rnd.normal(size=(30, 8)) @ spread).astype(np.int64)
    turn, steps = np.linalg.qr(rnd.normal(size=(8, 8)))[0], hn.steps_of(8)
    true = asked @ rows.T
    for share in (0.5, 0.9, 0.99, 1.0):
        reach = np.quantile(true, share, axis=1)
        a, b, scores = hn.survivors(hn.Rotated.of(asked, turn, steps), hn.Rotated.of(rows, turn, steps), reach, steps, np.ones_like(true, bool), hn._slack(asked, 1e4))
        assert (scores == true[a, b]).all()
        assert set(zip(*np.nonzero(true >= reach[:, None]))) <= set(zip(a.tolist(), b.tolist()))


def test_rotation_is_orthogonal_and_leads_with_the_largest(spark):
    rows = spark.createDataFrame([([i * 9 % 100 - 50, i % 7, 0, i % 3 - 1],) for i in range(200)], "q array<bigint>").repartition(3)
    turn = hn.rotation(rows, 4)
    assert np.allclose(turn.T @ turn, np.eye(4))
    energy = np.square(np.array([r.q for r in rows.collect()]) @ turn).sum(0)
    assert (np.diff(energy) <= 1e-6 * energy[0]).all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert_same(queries.queries()[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), queries.oracle_sql()[name])


def test_blocks_have_every_row_once(spark):
    rows = spark.range(1000)
    parts = [[r.id for r in b.collect()] for b in vectors.blocks(rows, 100)]
    assert sorted(x for p in parts for x in p) == list(range(1000)) and max(map(len, parts)) < 160
