"""Hard negatives by inner product, with early discards in an orthogonal PCA rotation.

The rotation (eigenvectors of the rows' second moments, summed over all rows)
keeps inner products and puts the largest components first.  A row's product
with an anchor is summed over the leading components in steps; what is left is
at most the product of both residual norms (Cauchy-Schwarz), and with a slack for
rounding the sum bounds the score from above.  A pair whose bound is below the
score that it has to reach is discarded; survivors are verified by products of
the integers, and these alone give scores.

Three passes for each block of anchors, which is broadcast and of bounded size:
the best rows of the anchor's label (positives), then the best rows of other
labels inside each positive's band of scores.  A task holds the best few of each
anchor, so what is shuffled is bounded by tasks and not by rows of a label; rows
stay where they are read, and no label is gathered anywhere.

An anchor's positives are the ``k`` best rows of its label; a positive's
negatives are the ``k`` best rows of other labels with ``low / 100`` of its score
or more, and not more than its score.  Ties go to the smaller id (nulls last).
Rows with a null label, without a vector, or with a null or non-finite component
take no part; vectors of other lengths count as filled up with zeros.  Rows with
the anchor's id are the anchor itself.  Repeated anchors ask each for itself; a
row without an id is a candidate and no anchor.  An empty table gives an empty
result; an anchor without positives, and a positive without negatives, gives no
row.  Other columns than id, vector and label are ignored.  Scores have to stay
within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .vectors import NO_ID, as_text, best, blocks, bounded_bytes, facts, floored, ids_of, integer_products, is_finite, matrix, top

BLOCK = 2048  #: anchors of one broadcast
ROWS = 1024  #: rows that are compared at once
STEPS = (1 / 4, 1 / 2, 3 / 4, 1)  #: shares of the components after which pairs are discarded


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal columns, eigenvectors of the second moments of column ``q`` in order of their eigenvalues."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            x = matrix(pdf["q"], dim).astype(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(dim * dim), "value": total.ravel()})

    cells = bounded_bytes(rows.select("q")).mapInPandas(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(dim * dim)
    for r in cells:
        total[r.cell] = r.value
    total = total.reshape(dim, dim) / max(1.0, np.abs(total).max())
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


@dataclass
class Rotated:
    """Integer vectors with their rotated components, and the norms of what follows each step."""

    rows: np.ndarray
    turned: np.ndarray
    rest: np.ndarray  # (step, row)

    @classmethod
    def of(cls, rows: np.ndarray, turn: np.ndarray, steps: list[int]) -> "Rotated":
        turned = rows.astype(np.float64) @ turn
        squares = np.cumsum(np.square(turned[:, ::-1]), 1)[:, ::-1]  # of all components from one on
        rest = np.stack([np.sqrt(squares[:, s]) if s < turned.shape[1] else np.zeros(len(rows)) for s in steps])
        return cls(rows, turned, rest)


def steps_of(dim: int) -> list[int]:
    return sorted({max(1, round(dim * s)) for s in STEPS})


def survivors(anchors: Rotated, rows: Rotated, reach: np.ndarray, steps: list[int], open_: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of ``open_`` ones whose score may be ``reach`` or more, with their integer products.

    While many pairs are open, a step is a product of matrices, later one of the open pairs only.
    """
    sums, before = None, 0
    a = b = None
    for k, step in enumerate(steps):
        cut = slice(before, step)
        if a is None:
            part = anchors.turned[:, cut] @ rows.turned[:, cut].T
            sums = part if sums is None else sums + part
            open_ = open_ & (sums + np.outer(anchors.rest[k], rows.rest[k]) + slack[:, None] >= reach[:, None])
            if np.count_nonzero(open_) < open_.size / 16:
                a, b = np.nonzero(open_)
                sums = sums[a, b]
        else:
            sums = sums + np.einsum("ij,ij->i", anchors.turned[a, cut], rows.turned[b, cut])
            ok = sums + anchors.rest[k][a] * rows.rest[k][b] + slack[a] >= reach[a]
            a, b, sums = a[ok], b[ok], sums[ok]
        before = step
    if a is None:
        a, b = np.nonzero(open_)
    return a, b, np.einsum("ij,ij->i", anchors.rows[a], rows.rows[b])


def _slack(anchors: np.ndarray, largest: float) -> np.ndarray:
    """What rounding can add to a bound, for each anchor: a few units of the last place of the norms' product for each component."""
    norms = np.sqrt(np.square(anchors.astype(np.float64)).sum(1))
    return 1.0 + 1e-14 * anchors.shape[1] ** 2 * norms * largest


class Kept:
    """The best ``k`` scores of each of many groups so far, ties to the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * groups, [np.zeros(0, np.int64)] * groups

    def add(self, group: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[group], scores]), np.concatenate([self.ids[group], ids])
        order = top(scores, ids, self.k)
        self.scores[group], self.ids[group] = scores[order], ids[order]

    def least(self, group: int) -> float:
        return float(self.scores[group][-1]) if len(self.scores[group]) == self.k else -np.inf

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        return n, np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0, np.int64)])


@dataclass
class _Block:
    """Anchors of one broadcast; ``positives`` are (anchor, positive id, score, lowest score of a negative) lines."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    turn: np.ndarray
    largest: float
    positives: list[tuple[int, int, int, int]] | None = None


def _searched(shared: Broadcast, dim: int, k: int):
    """A function for mapInPandas: the best candidates of each task for the block's anchors, or for their positives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: _Block = shared.value
        steps = steps_of(dim)
        anchors, slack = Rotated.of(block.rows, block.turn, steps), _slack(block.rows, block.largest)
        n = len(block.ids)
        bands: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for g, (a, _, high, low) in enumerate(block.positives or []):
            bands[a].append((g, low, high))
        kept = Kept(n if block.positives is None else len(block.positives), k)
        reach = np.full(n, -np.inf) if block.positives is None else np.array([min((low for _, low, _ in b), default=np.inf) for b in bands], np.float64)
        for pdf in batches:
            for start in range(0, len(pdf), ROWS):
                part = pdf.iloc[start : start + ROWS]
                rows, ids, labels = Rotated.of(matrix(part["q"], dim), block.turn, steps), ids_of(part["vec_id"]), part["label"].to_numpy(np.int64)
                same = block.labels[:, None] == labels[None, :]
                open_ = (same if block.positives is None else ~same) & (block.ids[:, None] != ids[None, :])
                a, b, scores = survivors(anchors, rows, reach, steps, open_, slack)
                cuts = np.searchsorted(a, np.arange(n + 1))
                for i in np.unique(a).tolist():
                    own, own_ids = scores[cuts[i] : cuts[i + 1]], ids[b[cuts[i] : cuts[i + 1]]]
                    if block.positives is None:
                        kept.add(i, own, own_ids)
                        reach[i] = kept.least(i)
                        continue
                    needed = np.inf
                    for g, low, high in bands[i]:
                        inside = (own >= low) & (own <= high)
                        if inside.any():
                            kept.add(g, own[inside], own_ids[inside])
                        needed = min(needed, max(low, kept.least(g)))
                    reach[i] = needed
        groups, ids, scores = kept.table()
        if len(groups):
            yield pd.DataFrame({"n": groups, "vec_id": as_text(ids), "score": scores})

    return run


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, k: int = 5, low: int = 80, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``is_anchor`` holds."""
    taken = rows.where(is_finite(vector) & F.col(label).isNotNull())
    table = stored(taken.select(F.col(key).cast("string").alias("vec_id"), F.col(label).cast("long").alias("label"), floored(vector).alias("q"), (F.coalesce(is_anchor, F.lit(False)) & F.col(key).isNotNull()).alias("anchor")), "rows")
    _, dim, _ = facts(table)
    turn = rotation(table, dim)
    largest = float(table.agg(F.max(F.expr("aggregate(q, 0D, (s, x) -> s + cast(x as double) * x)")).alias("m")).first().m or 0.0) ** 0.5
    anchors = stored(table.where("anchor"), "anchors")
    parts = [_mined(table, part, k, low, dim, turn, largest) for part in blocks(anchors, max(1, block * 64 // dim))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    forget(table)
    forget(anchors)
    return out


def _mined(table: DataFrame, part: DataFrame, k: int, low: int, dim: int, turn: np.ndarray, largest: float) -> DataFrame:
    """The results of one block of anchors, stored."""
    spark, asked = table.sparkSession, part.collect()  # bounded by the block
    candidates = bounded_bytes(table.select("vec_id", "label", "q"))
    block = _Block(ids_of(pd.Series([r.vec_id for r in asked], dtype=object)), np.array([r.label for r in asked], np.int64), matrix([r.q for r in asked], dim), turn, largest)

    def found() -> DataFrame:
        hits = candidates.mapInPandas(_searched(spark.sparkContext.broadcast(block), dim, k), "n int, vec_id string, score long")
        return best(hits.withColumn("vec_id", F.col("vec_id").cast("long")), ["n"], k)

    positives = sorted((r.n, -r.score, NO_ID if r.vec_id is None else r.vec_id) for r in found().collect())  # k for each anchor of the block
    block.positives = [(a, p, -s, -(-low * -s // 100)) for a, s, p in positives]
    lines = [(g, int(block.ids[a]), None if p == NO_ID else p, s) for g, (a, p, s, _) in enumerate(block.positives)]
    named = spark.createDataFrame(lines, "n int, anchor_id long, positive_id long, positive_score long")
    out = found().join(F.broadcast(named), "n")
    return stored(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
