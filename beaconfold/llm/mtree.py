"""Exact top-k search by inner product with M-trees, best node first.

The highest inner product is the nearest neighbour in a metric space: with one
more component ``sqrt(M - |x|^2)`` for rows (``M``: the greatest squared norm)
and 0 for queries, ``d(q, x)^2 = |q|^2 + M - 2 q.x``.

Rows are dealt to the nearest of some pivots, and pivots with many rows (copies,
hot groups) are split by a hash of row numbers, so a *tree* has about
``TREE_ROWS`` rows, whatever the data.  Each tree is an M-tree in pages: a node
has up to ``FANOUT`` entries, each a routing row with its covering radius, its
distance to the node's own routing row and a child page; a leaf has up to
``LEAF`` rows with their distances to its routing row.  A stored row holds the
pages of a tree.

A query visits pages by their least possible distance, with a queue.  Before any
product with an entry is computed, the triangle inequality with the stored
distance to the parent has to leave it open; after it, the covering radius.
Bounds carry a slack for rounding, so ties are found.  Scores are products of
integers.  In a first round a query asks the trees whose root is nearest, and
its k-th score there bounds the search in all others.  Queries go in blocks of
bounded size, each a broadcast; trees stay where they are read.  Where rows have
no structure (random directions in many dimensions) bounds rule little out, and
the work is that of all queries with all rows.

The index is fitted on all rows; pivots are a bounded sample (``PIVOTS`` at most).
Rows without a vector, or with a null or non-finite component, take no part;
vectors of other lengths count as filled up with zeros.  Rows with the query's
id are the query itself.  Repeated query rows ask each for itself; a row without
an id is a candidate (last among ties) and no query.  An empty table gives an
empty result, fewer candidates than k all of them.  Only the id and vector
columns are read.  Scores and squared norms have to stay within 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .vectors import NO_ID, as_text, best, blocks, bounded_bytes, facts, floored, ids_of, integer_products, is_finite, matrix, top

TREE_ROWS = 8192
PIVOTS = 1024
LEAF = 128
FANOUT = 16
BLOCK = 8192  #: queries of one broadcast

TREE = "tree int, dim int, norm double, ids array<string>, vectors binary, leaves array<int>, nodes binary"


@dataclass
class Tree:
    """An M-tree of rows in the order of its leaves.

    ``entries`` has a line for each entry of an inner node: the row that routes,
    the child node, the covering radius, the distance to the parent's routing row.
    """

    rows: np.ndarray  # integers
    lift: np.ndarray  # the added component of each row
    ids: np.ndarray
    first: np.ndarray  # of each node: its first entry (inner) or row (leaf)
    last: np.ndarray
    leaf: np.ndarray
    routes: np.ndarray  # of each node: its routing row
    to_route: np.ndarray  # of each row: distance to its leaf's routing row
    entries: np.ndarray  # node numbers of the children of inner nodes
    radius: np.ndarray  # of each node
    to_parent: np.ndarray  # of each node: distance between its routing row and its parent's


def _distances(a: np.ndarray, a_lift, b: np.ndarray, b_lift) -> np.ndarray:
    """Between lifted rows ``a`` and one lifted row ``b``."""
    return np.sqrt(np.square((a - b).astype(np.float64)).sum(1) + np.square(a_lift - b_lift))


def _halves(rows: np.ndarray, lift: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``at``, by which of two far rows is nearer."""
    far = at[int(_distances(rows[at], lift[at], rows[at[0]], lift[at[0]]).argmax())]
    to_far = _distances(rows[at], lift[at], rows[far], lift[far])
    other = at[int(to_far.argmax())]
    order = np.argsort(to_far - _distances(rows[at], lift[at], rows[other], lift[other]), kind="stable")
    half = len(at) // 2
    return at[order[:half]], at[order[half:]]


def build_tree(rows: np.ndarray, ids: np.ndarray, norm: float, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
    """Bulk-loads a tree of equally full pages; equal rows are split like others."""
    lift = np.sqrt(np.maximum(0.0, norm - np.square(rows.astype(np.float64)).sum(1)))
    order: list[np.ndarray] = []
    first, last, is_leaf, routes, radius, to_parent, entries = [], [], [], [], [], [], []
    to_route = np.zeros(len(rows))
    placed = 0

    def add(at: np.ndarray, parent: int) -> int:
        """Makes the node of the rows ``at`` and those below it; ``parent`` is a routing row, -1 at the root."""
        nonlocal placed
        middle = rows[at].astype(np.float64).mean(0)
        route = at[int((np.square(rows[at] - middle).sum(1) + np.square(lift[at] - lift[at].mean())).argmin())]
        away = _distances(rows[at], lift[at], rows[route], lift[route])
        node = len(first)
        for column, value in ((first, 0), (last, 0), (is_leaf, len(at) <= leaf), (routes, route), (radius, float(away.max())), (to_parent, 0.0)):
            column.append(value)
        if parent >= 0:
            to_parent[node] = float(_distances(rows[route][None], lift[route], rows[parent], lift[parent])[0])
        if len(at) <= leaf:
            order.append(at)
            to_route[at] = away
            first[node], last[node] = placed, placed + len(at)
            placed += len(at)
            return node
        groups = [at]
        while len(groups) < fanout and max(map(len, groups)) > leaf:
            groups = [h for g in groups for h in (_halves(rows, lift, g) if len(g) > leaf else (g,))]
        children = [add(g, int(route)) for g in groups]
        first[node], last[node] = len(entries), len(entries) + len(children)
        entries.extend(children)
        return node

    add(np.arange(len(rows)), -1)
    at = np.concatenate(order)
    place = np.empty(len(rows), np.int64)
    place[at] = np.arange(len(rows))
    numbers = lambda x, kind=np.int64: np.array(x, kind)
    return Tree(rows[at], lift[at], ids[at], numbers(first), numbers(last), numbers(is_leaf, bool), place[numbers(routes)], to_route[at], numbers(entries), numbers(radius, float), numbers(to_parent, float))


@dataclass
class Search:
    """Best-first search in one tree; counts the products that it computes."""

    tree: Tree
    norm: float
    exact: bool
    products: int = 0

    def __post_init__(self):
        t = self.tree
        self.floats = t.rows.astype(np.float64) if self.exact else t.rows

    def _scores(self, at: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
        rows = self.floats[at]
        self.products += len(rows)
        return rows @ q

    def nearest(self, query: np.ndarray, own: int, k: int, least: int | None) -> tuple[list[int], list[int]]:
        """Scores and ids of the ``k`` best rows with another id than ``own``, and a score of ``least`` or more."""
        t, q = self.tree, query.astype(np.float64) if self.exact else query
        size = float(np.square(query.astype(np.float64)).sum()) + self.norm
        slack = 2 * np.sqrt(1e-13 * len(query) * (size + 1))
        distance = lambda s: np.sqrt(np.maximum(0.0, size - 2.0 * s))
        reach = np.inf if least is None else float(distance(float(least))) + slack
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        to_root = float(distance(self._scores(t.routes[:1], q))[0])
        queue = [(max(0.0, to_root - t.radius[0]), 0, to_root)]
        while queue:
            bound, node, to_route = heapq.heappop(queue)
            if bound > reach:
                break
            a, b = t.first[node], t.last[node]
            if t.leaf[node]:
                near = a + np.flatnonzero(np.abs(to_route - t.to_route[a:b]) <= reach)
                found = self._scores(near, q).astype(np.int64)
                others = t.ids[near] != own
                if least is not None:
                    others &= found >= least
                scores, ids = np.concatenate([scores, found[others]]), np.concatenate([ids, t.ids[near][others]])
                if len(scores) > k:
                    kept = top(scores, ids, k)
                    scores, ids = scores[kept], ids[kept]
                if len(scores) == k:
                    reach = min(reach, float(distance(float(scores.min()))) + slack)
                continue
            children = t.entries[a:b]
            children = children[np.abs(to_route - t.to_parent[children]) - t.radius[children] <= reach]
            away = distance(self._scores(t.routes[children], q).astype(np.float64))
            for child, d, low in zip(children.tolist(), away.tolist(), np.maximum(0.0, away - t.radius[children]).tolist()):
                if low <= reach:
                    heapq.heappush(queue, (low, child, d))
        order = top(scores, ids, k)
        return scores[order].tolist(), ids[order].tolist()


def _packed(number: int, tree: Tree, norm: float) -> dict:
    nodes = np.stack([tree.first, tree.last, tree.leaf, tree.routes]).astype("<f8")
    body = np.concatenate([nodes.ravel(), tree.radius, tree.to_parent, tree.to_route, tree.lift])
    return {"tree": number, "dim": tree.rows.shape[1], "norm": norm, "ids": as_text(tree.ids), "vectors": tree.rows.astype("<i8").tobytes(), "leaves": tree.entries.tolist(), "nodes": body.astype("<f8").tobytes()}


def _unpacked(row) -> Tree:
    rows = np.frombuffer(row.vectors, "<i8").reshape(-1, row.dim)
    body, n = np.frombuffer(row.nodes, "<f8"), len(rows)
    m = (len(body) - 2 * n) // 6
    first, last, leaf, routes = body[: 4 * m].reshape(4, m).astype(np.int64)
    radius, to_parent = body[4 * m : 6 * m].reshape(2, m)
    to_route, lift = body[6 * m :].reshape(2, n)
    return Tree(rows, lift, ids_of(row.ids), first, last, leaf.astype(bool), routes, to_route, np.array(row.leaves, np.int64), radius, to_parent)


@dataclass
class VectorIndex:
    """The stored trees of a table of vectors."""

    trees: DataFrame
    count: int
    dim: int
    exact: bool
    norm: float


def _dealt(rows: DataFrame, n: int, dim: int, exact: bool, tree_rows: int) -> DataFrame:
    """``rows`` with the number of their ``tree``: the nearest pivot's, split where it has many rows."""
    wanted = min(PIVOTS, -(-n // tree_rows))
    if wanted <= 1:
        return rows.withColumn("tree", F.lit(0))
    picked = rows.select("q", F.xxhash64("vec_id", "q").alias("h")).orderBy("h").limit(wanted).collect()
    pivots = matrix([r.q for r in picked], dim)
    half = np.square(pivots.astype(np.float64)).sum(1) / 2

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        away = half - matrix(vectors, dim).astype(np.float64) @ pivots.astype(np.float64).T
        return pd.Series(away.argmin(1).astype(np.int32))

    assigned = stored(bounded_bytes(rows).withColumn("pivot", nearest("q")), "assigned")
    parts = {r.pivot: -(-r.c // tree_rows) for r in assigned.groupBy("pivot").agg(F.count("*").alias("c")).collect()}
    first = np.zeros(wanted, np.int64)
    share = np.array([parts.get(p, 1) for p in range(wanted)], np.int64)
    first[1:] = np.cumsum(share)[:-1]
    pick = lambda values: F.get(F.lit(values.astype(np.int32)), F.col("pivot"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), pick(share).cast("long")).cast("int")
    return assigned.withColumn("tree", pick(first) + part).drop("pivot")


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", tree_rows: int = TREE_ROWS) -> VectorIndex:
    """The M-trees of all rows of ``vectors`` that take part; vectors are integers (:func:`floored`)."""
    rows = stored(vectors.where(is_finite(vector)).select(F.col(key).cast("string").alias("vec_id"), floored(vector).alias("q")), "vectors")
    n, dim, exact = facts(rows)
    norm = float(rows.agg(F.max(F.expr("aggregate(q, 0D, (s, x) -> s + cast(x as double) * x)")).alias("m")).first().m or 0.0)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(matrix(pdf["q"], dim), ids_of(pdf["vec_id"]), norm)
        return pd.DataFrame([_packed(int(key[0]), tree, norm)])

    dealt = bounded_bytes(_dealt(rows, n, dim, exact, tree_rows))
    trees = stored(dealt.groupBy("tree").applyInPandas(build, TREE), "trees")
    forget(rows)
    return VectorIndex(trees, n, dim, exact, norm)


def search(index: VectorIndex, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows with the highest products with each row of ``queries``."""
    asked = stored(queries.where(is_finite(vector) & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("vec_id"), floored(vector).alias("q")), "queries")
    dim, norm, exact = index.dim, index.norm, index.exact
    exact = exact and facts(asked)[2]
    parts = [_found(index, part, k, dim, norm, exact) for part in blocks(asked, max(1, block * 64 // dim))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    forget(asked)
    return out


def _found(index: VectorIndex, part: DataFrame, k: int, dim: int, norm: float, exact: bool) -> DataFrame:
    """The results of one block of queries, stored."""
    spark, rows = part.sparkSession, part.collect()  # bounded by the block
    ids = ids_of(pd.Series([r.vec_id for r in rows], dtype=object))
    shared = spark.sparkContext.broadcast((ids, matrix([r.q[:dim] for r in rows], dim)))

    def run(bounds: np.ndarray | None):
        """Searches every tree; ``bounds`` has a score for each query that k rows reach, else only the nearest tree is asked."""

        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, asked = shared.value
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    tree = _unpacked(row)
                    find = Search(tree, norm, exact)
                    n, found = [], ([], [])
                    for i in range(len(own)):
                        if bounds is None and i not in near[row.tree]:
                            continue
                        scores, hits = find.nearest(asked[i], int(own[i]), k, None if bounds is None or bounds[i] == _NONE else int(bounds[i]))
                        n.extend([i] * len(hits))
                        found[0].extend(scores)
                        found[1].extend(hits)
                    if n:
                        yield pd.DataFrame({"n": np.array(n, np.int64), "query_id": as_text(own[n]), "vec_id": as_text(found[1]), "score": np.array(found[0], np.int64)})

        hits = bounded_bytes(index.trees).mapInPandas(over, "n long, query_id string, vec_id string, score long")
        return best(hits.withColumn("vec_id", F.col("vec_id").cast("long")), ["n", "query_id"], k)

    near = _nearest_trees(index, shared, dim)
    first = run(None).groupBy("n").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") == k).collect()
    bounds = np.full(len(rows), _NONE, np.int64)
    for r in first:
        bounds[r.n] = r.least
    return stored(run(bounds).select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")


_NONE = -(1 << 63)


def _nearest_trees(index: VectorIndex, shared, dim: int) -> dict[int, set[int]]:
    """For each tree the queries to whose vector its root's routing row is nearest."""

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, asked = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                tree = _unpacked(row)
                root = tree.rows[tree.routes[0]]
                yield pd.DataFrame({"n": np.arange(len(asked)), "tree": row.tree, "at": (asked.astype(np.float64) @ root.astype(np.float64))})

    closest = bounded_bytes(index.trees).mapInPandas(roots, "n long, tree int, at double").groupBy("n").agg(F.max_by("tree", F.struct("at", "tree")).alias("tree")).collect()
    out: dict[int, set[int]] = {}
    for r in closest:
        out.setdefault(r.tree, set()).add(r.n)
    for r in index.trees.select("tree").collect():
        out.setdefault(r.tree, set())
    return out
