"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct runs of ``shingle`` words.  Equal sets are
one *node*.  Nodes descend several independent trees: at each tree node one or
two coordinates of the MinHash signature are chosen by a hash of the tree node,
and documents that agree on the value go to the same child.  Children of at most
``leaf`` members are compared exhaustively inside a task; larger ones branch
again.

Only components are wanted, so links inside a component needn't be found.  Large
tree nodes are therefore linked while the trees grow: their members meet in
chunks dealt anew in each tree node, and a maximum spanning forest of each chunk
is confirmed on full sets.  A tree node whose members are one component by then
ends.  One with at most ``few`` members outside its largest component ends too:
these are compared with all other members, ``few`` at a time, so that no member
makes more than a few rows.  All others branch on; what still can't be split (its members
outside the largest component didn't fall below the share ``stuck`` of those
above, or ``levels`` are used up) is compared chunk against chunk, so nothing is
capped.

Links are confirmed on full sets.  In the ended tree nodes two rounds suffice:
the first confirms a maximum spanning forest by estimated similarity, the second
compares exhaustively what the first left in different components.  Full sets
are made only for documents that likely are near another one.

Recall: a tree node passes a pair at the threshold on to ``spare`` children on
average, so that pairs don't die out with depth.  All ten trees lose such a pair
with a chance of 1e-8 in the first level, 7e-5 in the fifth and 7e-4 in the
tenth.  Estimates of similarity (96 values) are cut ``margin`` below the
threshold, 3.2 standard deviations.

Sets are of lower-case (A-Z) words; fewer words than ``shingle`` make one
shingle.  Null texts and texts without words have empty sets and are linked with
nothing.  Rows that repeat a document are copies of it.  A row with a null id
takes part like any other and joins what it is near to, but names no component:
its component is the least id of its group, null if no row of the group has an
id, and only in that case it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, forget, slices, stored, with_long_id, with_text_id
from .components import connected_components


@dataclass(frozen=True)
class NearDupParameters:
    shingle: int = 5
    percent: int = 80  #: least similarity of linked documents, in hundredths
    trees: int = 10
    signature: int = 96
    leaf: int = 256
    levels: int = 12
    few: int = 512  #: members outside the largest component that are compared with all others of their tree node
    stuck: float = 0.9  #: share of those above from which their number counts as not falling
    spare: float = 1.1  #: children, on average, that a pair at the threshold shares
    margin: float = 0.13
    seed: int = 1

    @property
    def cut(self) -> float:
        return self.percent / 100 - self.margin


# -- sets and signatures ----------------------------------------------------------------------

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str], shingle: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    if len(hashes) > 500_000:
        hashes.clear()
    for t in texts:
        words = t.encode("utf-8", "replace").lower().split()
        n = len(words)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        width = min(shingle, n)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        s = np.full(n - width + 1, np.uint64(width))
        for k in range(width):
            s = _mix(s * _P[k % len(_P)] + h[k : n - width + 1 + k])
        out.append(np.unique(s))
    return out


def multipliers(p: NearDupParameters) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(p.seed))
    return rng.integers(0, 1 << 32, p.signature, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, p.signature, np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    low = None
    for i in range(0, len(x), 4096):  # bounded work space for very long texts
        y = x[i : i + 4096, None] * a + b
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        m = y.min(0)
        low = m if low is None else np.minimum(low, m)
    return low


def text_hash() -> Column:
    """Names a row's text, so that rows with a null id can be told apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame, p: NearDupParameters) -> DataFrame:
    """``doc_id, at`` (hash of the text), ``n_shingles, node`` (digest of the set, null if empty), ``sig`` and its low bytes ``low`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = multipliers(p)
        hashes = WordHashes()
        for pdf in batches:
            texts = filled(pdf["text"])
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], p.shingle, hashes)
                sigs = [signature(s, a, b) if len(s) else None for s in sets]
                yield pdf.iloc[i:j][["doc_id", "at"]].assign(
                    n_shingles=[len(s) for s in sets],
                    node=[xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    sig=[s if s is None else s.tobytes() for s in sigs],
                    low=[s if s is None else s.astype(np.uint8).tobytes() for s in sigs],
                )

    rows = with_text_id(docs).select("doc_id", text_hash().alias("at"), "text")
    return with_long_id(rows.mapInPandas(run, "doc_id string, at long, n_shingles long, node binary, sig binary, low binary"))


def full_sets(docs: DataFrame, p: NearDupParameters) -> DataFrame:
    """``node, shingles`` (in the order of unsigned integers) of ``docs(text)``; a task gives each node once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for pdf in batches:
            texts = filled(pdf["text"])
            for i, j in slices(texts, 300_000):
                sets = shingle_sets(texts[i:j], p.shingle, hashes)
                named = [(xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64)) for s in sets]
                fresh = [(n, s) for n, s in named if n not in seen and not seen.add(n)]
                yield pd.DataFrame({"node": [n for n, _ in fresh], "shingles": [s for _, s in fresh]})

    return docs.select("text").mapInPandas(run, "node binary, shingles array<bigint>")


#: Names of documents (two integers each) that are broadcast, 16 MB at most.
NAMES_TO_BROADCAST = 500_000

#: Nodes (digests of 16 bytes) that are broadcast, 8 MB at most.
NODES_TO_BROADCAST = 250_000


def picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows(node, ...)`` of the stored ``wanted(node)``; few of these are broadcast, so that other rows needn't be shuffled."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= NODES_TO_BROADCAST else wanted, "node", "left_semi")


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, p: NearDupParameters) -> DataFrame:
    """Stored sets of the ``wanted(node)``, one row each, made anew from one document of each.

    The names of these documents are stored and counted first: up to
    ``NAMES_TO_BROADCAST`` are broadcast, and texts needn't be shuffled; more are
    joined by a shuffle.
    """
    rows = nodes.select("node", "doc_id", "at").join(wanted.distinct(), "node", "left_semi")
    rows = stored(rows.select(F.col("doc_id").alias("id"), F.col("at").alias("hashed")), "wanted")
    rows = F.broadcast(rows) if rows.count() <= NAMES_TO_BROADCAST else rows
    texts = docs.join(rows, docs["doc_id"].eqNullSafe(F.col("id")) & (text_hash() == F.col("hashed")), "left_semi")
    sets = stored(full_sets(texts, p), "sets")
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    return stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # rows that repeat id and text


# -- trees ------------------------------------------------------------------------------------


def _children(keys: np.ndarray, sigs: np.ndarray, p: NearDupParameters) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child keys: each tree node chooses one coordinate, and a second with the chance that keeps pairs at the threshold alive."""
    first = (_mix(keys * _P[0] + np.uint64(1)) % np.uint64(p.signature)).astype(np.int64)
    draw = _mix(keys * _P[1] + np.uint64(2))
    second = np.where(first == (s := (draw >> np.uint64(20)) % np.uint64(p.signature)).astype(np.int64), (first + 1) % p.signature, s.astype(np.int64))
    more = (draw % np.uint64(1000)).astype(float) < 1000 * (p.spare * 100 / p.percent - 1)
    row = np.arange(len(keys))
    rows = np.concatenate([row, row[more]])
    coordinate = np.concatenate([first, second[more]])
    child = _mix(_mix(keys[rows] * _P[2] + coordinate.astype(np.uint64)) + sigs[rows, coordinate].astype(np.uint64) * _P[3])
    return rows, child


def _descend(rows: DataFrame, p: NearDupParameters) -> DataFrame:
    """``key, node, above`` of the children of ``rows(key, node, sig, above)``; a null key is the root of all trees.

    ``above`` is the number of the parent's members outside its largest component.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sigs = np.frombuffer(b"".join(map(bytes, pdf["sig"])), np.uint32).reshape(len(pdf), -1)
            nodes, above = pdf["node"].to_numpy(), pdf["above"].to_numpy(np.int64)
            if pdf["key"].isna().any():
                roots = _mix(np.arange(1, p.trees + 1, dtype=np.uint64) * _P[4] + np.uint64(p.seed))
                at, keys = np.repeat(np.arange(len(pdf)), p.trees), np.tile(roots, len(pdf))
            else:
                at, keys = np.arange(len(pdf)), pdf["key"].to_numpy(np.int64).view(np.uint64)
            got, child = _children(keys, sigs[at], p)
            yield pd.DataFrame({"key": child.view(np.int64), "node": nodes[at[got]], "above": above[at[got]]})

    return rows.select("key", "node", "sig", "above").mapInPandas(run, "key long, node binary, above long")


def dealt_into(large: DataFrame, chunk: int) -> DataFrame:
    """``key, node`` of the members of ``large(key, node, count)``, dealt into chunks of about ``chunk`` members.

    Each tree node deals its members anew, so the chunks of several trees overlap.
    """
    own = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("count") / chunk).cast("int"))
    return large.select(F.xxhash64("key", own).alias("key"), "node")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """``key, major`` (its largest component), ``most`` (members of that), ``others``, ``above`` of tree nodes in more than one component."""
    roots = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), F.first("above").alias("above"))
    sizes = roots.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n"), F.first("above").alias("above"))
    return sizes.select("key", "major", "most", (F.col("n") - F.col("most")).alias("others"), "above").where("others > 0")


def cells(large: DataFrame, chunk: int) -> DataFrame:
    """``key, node`` of cells in which all pairs of ``large(key, node, root, major, most, others)`` meet that are in different components.

    Members of a tree node's largest component needn't meet one another: they
    are dealt into chunks that only meet chunks of the other members.  Where
    these fit into one chunk, a chunk's members stand in one cell and only the
    others are repeated.
    """
    chunks = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    others, majors = chunks("others"), chunks("most")
    own = F.when(F.col("root") == F.col("major"), others + F.pmod(F.xxhash64("node"), majors)).otherwise(F.pmod(F.xxhash64("node"), others)).cast("int")
    dealt = large.withColumn("own", own)
    first = F.when((F.col("own") < others) & (others == 1), 1).otherwise(0)  # cells with a major chunk hold the only other one
    last = F.when(F.col("own") < others, others + majors - 1).otherwise(others - 1)
    met = dealt.withColumn("other", F.explode(F.sequence(first, last)))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")


# -- comparison inside leaves -----------------------------------------------------------------


def _forest(estimate: np.ndarray, cut: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over similarities of ``cut`` or more."""
    n = len(estimate)
    out, best, parent = [], estimate[0].copy(), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    inside[0] = True
    best[0] = -1
    for _ in range(n - 1):
        at = int(best.argmax())
        if best[at] >= cut:
            out.append((int(parent[at]), at))
        elif best[at] < 0:
            break
        inside[at] = True
        closer = (estimate[at] > best) & ~inside
        best[closer], parent[closer] = estimate[at][closer], at
        best[at] = -1
    return out


def _estimates(low: pd.Series) -> np.ndarray:
    """Estimated similarity of all pairs; -1 of a member with itself."""
    rows = np.frombuffer(b"".join(map(bytes, low)), np.uint8).reshape(len(low), -1)
    out = (np.stack([(rows == r).mean(1) for r in rows]) - 1 / 256) / (1 - 1 / 256)
    np.fill_diagonal(out, -1)
    return out


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows with the same key, from batches sorted by key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        keys = pdf["key"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        if held and len(keys) and held[-1]["key"].iat[-1] != keys[0]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[a:b]
            if b < len(keys):
                yield pd.concat([*held, part]) if held else part
                held = []
            elif b > a:
                held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def candidates(members: DataFrame, p: NearDupParameters) -> DataFrame:
    """``key, u, v``: links, to be confirmed, that likely join each group of ``members(key, node, root, low, n)`` as far as it can be.

    They are the edges of a maximum spanning forest that join different
    components (``root``).  Every member that has a likely partner in another
    component stands in a row without ``v`` as well, where ``key`` names the
    members that likely are joined: trees that bring the same documents together
    give the same rows.  Similarity is estimated by
    the low bytes of the signatures, less what agrees by chance; sets of ``n``
    shingles whose sizes alone rule the threshold out count as unlike.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _grouped(batches):
            if len(group) < 2:
                continue
            estimate = _estimates(group["low"])
            codes = pd.factorize(group["root"])[0]
            same = codes[:, None] == codes[None, :]
            n = group["n"].to_numpy(np.int64)
            estimate[100 * np.minimum.outer(n, n) < p.percent * np.maximum.outer(n, n)] = 0
            likely = ((estimate >= p.cut) & ~same).any(1)
            if not likely.any():
                continue
            estimate[same] = 2
            np.fill_diagonal(estimate, -1)
            nodes, forest = group["node"].to_numpy(), _forest(estimate, p.cut)
            out += [(None, max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in forest if codes[i] != codes[j]]
            for part in _parts(forest, likely):
                own = sorted(nodes[part])
                key = xxhash.xxh3_64_intdigest(b"".join(own))
                out += [(key - (1 << 63), n, None) for n in own]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["key", "u", "v"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "u", "v"])

    sorted_groups = members.select("key", "node", "root", "low", "n").repartition("key").sortWithinPartitions("key")
    return sorted_groups.mapInPandas(run, "key long, u binary, v binary")


def _parts(forest: list[tuple[int, int]], likely: np.ndarray) -> list[list[int]]:
    """The members of ``likely``, parted by the trees of the forest."""
    parent = list(range(len(likely)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in forest:
        parent[find(i)] = find(j)
    parts: dict[int, list[int]] = {}
    for i in np.flatnonzero(likely):
        parts.setdefault(find(int(i)), []).append(int(i))
    return list(parts.values())


def likely_links(found: DataFrame) -> DataFrame:
    return found.where("v is not null and u <> v").select("u", "v").distinct()


def _similar(one: np.ndarray, sets: list[np.ndarray], percent: int, cells: int = 1_000_000) -> np.ndarray:
    """Which of ``sets`` reach the threshold with ``one``, by their exact intersections; all are sorted as unsigned integers."""
    out, at = np.zeros(len(sets), bool), 0
    while at < len(sets):
        to = at + max(1, cells // max(1, len(sets[at])))
        part = sets[at:to]
        size = np.fromiter(map(len, part), np.int64, len(part))
        flat = np.concatenate(part)
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        out[at:to] = 100 * both >= percent * (len(one) + size - both)
        at = to
    return out


def links_across(members: DataFrame, p: NearDupParameters) -> DataFrame:
    """``u, v``: links between components, from ``members(key, node, root, low, shingles)``.

    All pairs of different ``root`` in a group whose estimate reaches the cut
    are compared on their full sets; pairs whose components a found link has
    joined by then need no comparison.  A group so gives fewer rows than it has
    members.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches):
            roots = group["root"].to_numpy()
            parent = {r: r for r in roots}
            if len(parent) < 2:
                continue
            estimate, codes = _estimates(group["low"]), pd.factorize(roots)[0]
            likely = np.triu(estimate >= p.cut, 1) & (codes[:, None] != codes[None, :])

            def find(x: bytes) -> bytes:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            sets, out = [np.asarray(x, np.int64).view(np.uint64) for x in group["shingles"]], []
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            for i in np.flatnonzero(likely.any(1)):
                own = find(roots[i])
                others = [j for j in np.flatnonzero(likely[i] & (100 * np.minimum(size, size[i]) >= p.percent * np.maximum(size, size[i]))) if find(roots[j]) != own]
                for j in np.array(others, np.int64)[_similar(sets[i], [sets[j] for j in others], p.percent)]:
                    x, y = find(roots[i]), find(roots[j])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((max(x, y), min(x, y)))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])

    sorted_groups = members.select("key", "node", "root", "low", "shingles").repartition("key").sortWithinPartitions("key")
    return sorted_groups.mapInPandas(run, "u binary, v binary").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, p: NearDupParameters) -> DataFrame:
    """The stored ``pairs(u, v)`` whose full sets reach the threshold, by array functions; only sets in pairs move."""
    left = picked(sets, pairs.select(F.col("u").alias("node"))).select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = picked(sets, pairs.select(F.col("v").alias("node"))).select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    joined = pairs.join(left, "u").join(right, "v").withColumn("both", both)
    return joined.where(100 * F.col("both") >= p.percent * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v")


def labelled_by(members: DataFrame, root: DataFrame | None) -> DataFrame:
    """``members(node, ...)`` with the ``root`` of their component so far."""
    if root is None:
        return members.withColumn("root", F.col("node"))
    return members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def unsettled(members: DataFrame, root: DataFrame | None) -> DataFrame:
    """``key, node, root`` of the tree nodes of ``members(key, node)`` that are in more than one component."""
    labelled = stored(labelled_by(members, root).select("key", "node", "root"), "labelled")
    split = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return labelled.join(stored(split, "split"), "key", "left_semi")


# -- the operation ----------------------------------------------------------------------------


def roots_of(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(u, v)`` that isn't the root of its component."""
    return connected_components(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))


def as_edges(root: DataFrame | None) -> list[DataFrame]:
    return [] if root is None else [root.select(F.col("node").alias("u"), F.col("root").alias("v"))]


def grown(docs: DataFrame, nodes: DataFrame, p: NearDupParameters) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Grow all trees: ``key, node`` of leaves and of cells of ended large tree nodes, components so far, and sets fetched so far."""
    low, groups = nodes.select("node", "low", "n"), []
    sets = root = None
    rows = nodes.select(F.lit(None).cast("long").alias("key"), "node", "sig", F.lit(1 << 62).alias("above"))
    for level in range(p.levels):
        keyed = stored(_descend(rows, p), "tree")
        counts = stored(keyed.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"), "tree-counts")
        shared = stored(keyed.join(counts, "key"), "tree-shared")
        forget(keyed)
        groups.append(shared.where(F.col("count") <= p.leaf).select("key", "node"))
        if counts.where(F.col("count") > p.leaf).isEmpty():
            break
        large = shared.where(F.col("count") > p.leaf)

        # Link what meets in chunks, then look which tree nodes are one component.
        # Texts are read once for that; pairs without sets by then wait for the end.
        chunks = labelled_by(dealt_into(large, p.leaf), root)
        pairs = stored(likely_links(candidates(chunks.join(low, "node"), p)), "pairs")
        if sets is None:
            sets = sets_of(docs, nodes, ends_of(pairs), p)
        root = roots_of(reduce(DataFrame.union, [*as_edges(root), confirmed(pairs, sets, p)]))
        forget(pairs)
        labelled = stored(labelled_by(large, root).select("key", "node", "root", "above"), "labelled")
        sizes = stored(component_sizes(labelled), "tree-sizes")
        going = (F.col("others") > p.few) & (F.col("others") < p.stuck * F.col("above")) & F.lit(level + 1 < p.levels)
        open_ = stored(labelled.drop("above").join(sizes, "key"), "tree-open")
        forget(labelled)
        groups.append(cells(open_.where(~going), p.few))
        if sizes.where(going).isEmpty():
            break
        going_on = open_.where(going).select("key", "node", F.col("others").alias("above"))
        going_nodes = stored(going_on.select("node").distinct(), "tree-going")
        rows = going_on.join(picked(nodes.select("node", "sig"), going_nodes), "node")
    return reduce(DataFrame.union, groups), root, sets


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))


def with_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, sets: DataFrame | None, p: NearDupParameters) -> DataFrame:
    """``sets`` and those of the ``wanted(node)`` that it lacks."""
    if sets is None:
        return sets_of(docs, nodes, wanted, p)
    return sets.union(sets_of(docs, nodes, wanted.join(sets.select("node"), "node", "left_anti"), p))


def near_groups(docs: DataFrame, p: NearDupParameters) -> tuple[DataFrame, DataFrame]:
    """Stored rows (``doc_id, at, n_shingles, node``) and the stored component of each ``node``.

    ``first`` names a component's first document: ``no_id, doc_id, at``.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(signatures(docs, p), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(first).alias("first"), F.first("sig").alias("sig"), F.first("low").alias("low"), F.first("n_shingles").alias("n"))
    nodes = stored(nodes.select("node", "first", "first.doc_id", "first.at", "sig", "low", "n"), "nodes")
    low = nodes.select("node", "low", "n")
    groups, root, sets = grown(docs, nodes, p)

    found = stored(candidates(labelled_by(groups, root).join(low, "node"), p), "candidates")
    likely = stored(found.where("v is null").select("key", F.col("u").alias("node")).distinct(), "likely")
    sets = with_sets(docs, nodes, likely.select("node"), sets, p)
    root = roots_of(reduce(DataFrame.union, [*as_edges(root), confirmed(stored(likely_links(found), "pairs"), sets, p)]))

    # What likely is near but in another component still is compared exhaustively.
    members = stored(unsettled(likely, root), "members")
    near = picked(sets, stored(members.select("node").distinct(), "near"))
    more = stored(links_across(members.join(low, "node").join(near, "node"), p), "links")
    if not more.isEmpty():
        root = roots_of(reduce(DataFrame.union, [*as_edges(root), more]))

    placed = stored(labelled_by(nodes.select("node", "first"), root), "placed")
    least = stored(placed.groupBy("root").agg(F.min("first").alias("first")), "least")
    return rows.select("doc_id", "at", "n_shingles", "node"), stored(placed.select("node", "root").join(least, "root").select("node", "first"), "node-components")


def near_duplicates(docs: DataFrame, p: NearDupParameters = NearDupParameters()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``."""
    rows, component = near_groups(docs, p)
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    own = rows.join(component, "node", "left").select("doc_id", "n_shingles", component_id.alias("component_id"))
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, p: NearDupParameters = NearDupParameters()) -> DataFrame:
    """The rows of ``docs`` without their near duplicates: the first of each group by id; all columns stay.

    Rows with an id come first.  Rows that repeat id and text are one document,
    of which one row stays (also if the text is null); so a group without any id
    leaves one row as well.
    """
    rows, component = near_groups(docs, p)
    placed = rows.join(component, "node", "left")
    stays = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    kept = stored(placed.where(stays).groupBy("doc_id", "at").agg(F.count("*").alias("rows")).select(F.col("doc_id").alias("kept_id"), F.col("at").alias("kept_at"), "rows"), "kept")
    same: Column = docs["doc_id"].eqNullSafe(F.col("kept_id")) & (text_hash() == F.col("kept_at"))
    out = docs.join(kept.select("kept_id", "kept_at"), same, "left_semi")
    return out if kept.where("rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])
