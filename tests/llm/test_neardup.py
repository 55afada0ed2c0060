import random

import pytest

from beaconfold.llm import neardup, queries
from beaconfold.llm.components import connected_components


def brute(rows, shingle, percent):
    """Component of each document by comparing all pairs of sets."""
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        n = min(shingle, len(w))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_copies(seed, groups, largest):
    rnd = random.Random(seed)
    rows, k = [(0, None), (1, ""), (2, "  "), (3, "a"), (4, "A"), (5, "b c"), (6, "word " * 5000)], 7
    common = [f"c{i}" for i in range(60)]
    for _ in range(groups):
        base = [f"{rnd.randint(0, 400)}x" for _ in range(rnd.randint(5, 120))] + (common if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(1, largest)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 9)}"
            rows.append((k, " ".join(words)))
            k += 1
    return rows


@pytest.mark.parametrize("seed, leaf, levels", [(1, 256, 10), (2, 8, 3)])
def test_components_equal_brute_force(spark, seed, leaf, levels):
    rows = near_copies(seed, 25, 20)
    p = neardup.NearDupParameters(shingle=3, percent=85, leaf=leaf, levels=levels)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, node string, key string")
    got = neardup.near_duplicates(docs, p).collect()
    want = brute(rows, 3, 85)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "A b c D"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = neardup.near_duplicates(docs, neardup.NearDupParameters(shingle=3, percent=85)).collect()
    assert len(got) == 5 and [r.component_id for r in got if r.doc_id == 2] == [1]
    assert neardup.near_duplicates(docs.where("false")).count() == 0
    kept = neardup.without_near_duplicates(docs, neardup.NearDupParameters(shingle=3, percent=85))
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) in ([(0, ""), (1, "a b c d")], [(0, ""), (0, "a b c d"), (1, "a b c d")])


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op9_near_duplicates(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    n = 120
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(50, n), rnd.randint(50, n)) for _ in range(60)]
    parent = list(range(n + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in range(n + 1) if find(i) != i}
