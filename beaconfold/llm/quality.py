"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - w.x)``: one weight vector over hashed
text is shared by all grades, and the thresholds are kept in order by fitting
the logarithms of their gaps.  Predictions are the expected grade and the
probability of a grade of ``tail`` or more, which decides what is kept.

``x`` holds the shares of a text's tokens by hashed word and by token shape, and
a few style measures (repeated neighbours, distinct tokens, length).  The fit
uses at most ``sample`` rated rows, in the order of a hash of their id; a text
that is empty or null has style measures only.  With one grade in the sample
(or none) every document has that grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, filled, slices, with_long_id, with_text_id
from .hashed_text import Sparse, TokenCodes, adam, sampled_rows, sigmoid, sparse_rows, token_and_shape

BUCKETS = 1 << 16
STYLE = 4
SAMPLE = 4096


def _tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    tokens, ends = [], [0]
    for t in texts:
        tokens += t.encode("utf-8", "replace").split()
        ends.append(len(tokens))
    return tokens, np.array(ends, np.int64)


def _style(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Constant, share of tokens equal to the one before, share of distinct tokens, length."""
    n = np.diff(ends)
    out = np.zeros((len(n), STYLE))
    size = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(codes))
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        keys = np.unique(doc * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1)
        out[:, 2] = np.bincount(keys, minlength=len(n)) / size
    else:
        out[:, 2] = n / size
    out[:, 0] = 1
    out[:, 1] = np.bincount(doc, same, len(n)) / size if len(codes) else 0
    out[:, 3] = np.log1p(n) / 10
    return out


def _segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray  # buckets, then style measures
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) of every grade but the least."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(x: Sparse, grade: np.ndarray, grades: list[int], steps: int = 250, rate: float = 0.3, ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood of ordered grades, with a ridge on the weights."""
    level = np.searchsorted(grades, grade)
    k, d = len(grades) - 1, x.columns
    if k < 1:
        return OrdinalModel(list(grades), np.zeros(d), np.zeros(0))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))

    def gradient(p: np.ndarray) -> np.ndarray:
        score, t = x.times(p[:d]), np.concatenate([[-np.inf], thresholds(p), [np.inf]])
        above, below = sigmoid(t[level + 1] - score), sigmoid(t[level] - score)
        inside = np.maximum(above - below, 1e-12)
        da, db = above * (1 - above) / inside / x.n, below * (1 - below) / inside / x.n
        out = np.empty_like(p)
        out[:d] = x.transposed(da - db) + ridge * p[:d]
        by_threshold = np.bincount(level, -da, k + 1)[:k] + np.bincount(np.maximum(level - 1, 0), np.where(level > 0, db, 0), k + 1)[:k]
        tail = np.cumsum(by_threshold[::-1])[::-1]
        out[d], out[d + 1 :] = tail[0], tail[1:] * np.exp(p[d + 1 :])
        return out

    start = np.zeros(d + k)
    p = adam(start, gradient, steps, rate)
    return OrdinalModel(list(grades), p[:d], thresholds(p))


def _rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    store = TokenCodes(token_and_shape, BUCKETS)
    tokens, ends = _tokens(texts)
    codes = store.of(tokens)
    style, out = _style(codes, ends), []
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        flat = np.array([f for c in codes[a:b] for f in store.runs[c]], np.int64)
        idx, count = np.unique(flat, return_counts=True)
        out.append((np.concatenate([idx, BUCKETS + np.arange(STYLE)]), np.concatenate([count / max(1, b - a), style[i]])))
    return out


def fit_quality(ratings: DataFrame, docs: DataFrame, grade: str = "grade", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rows of ``ratings(doc_id, <grade>)``; of repeated ids the highest grade counts."""
    rows = sparse_rows(sampled_rows(ratings, docs, [grade], sample), [grade], _rows)
    x = Sparse(list(rows["idx"]), list(rows["val"]), BUCKETS + STYLE)
    y = rows[grade].to_numpy().astype(np.int64)
    return fit_ordinal(x, y, sorted(set(y.tolist())) or [0])


class _Scorer:
    """Expected grade and tail probability of lists of texts, with the scores of tokens met so far."""

    def __init__(self, model: OrdinalModel, tail: int):
        self.model, self.level = model, sum(g < tail for g in model.grades)
        self.grades = np.array(model.grades, float)
        self.store = TokenCodes(token_and_shape, BUCKETS)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m, store = self.model, self.store
        if len(store.codes) > store.keep:
            store.reset()
        tokens, ends = _tokens(texts)
        codes = store.of(tokens)
        score = _style(codes, ends) @ m.weights[BUCKETS:]
        if len(codes):
            score = score + _segment_sums(store.scored(m.weights[:BUCKETS, None])[:, 0][codes], ends) / np.maximum(1, np.diff(ends))
        tails, n = m.tails(score), len(texts)
        p = np.ones(n) if self.level == 0 else np.zeros(n) if self.level > tails.shape[1] else tails[:, self.level - 1]
        return self.grades[0] + tails @ np.diff(self.grades), p


def predict_quality(docs: DataFrame, model: OrdinalModel, tail: int, keep_at: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, p_tail, kept`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value, tail)
        for pdf in batches:
            texts = filled(pdf["text"])
            for a, b in slices(texts):
                grade, p = scorer.of(texts[a:b])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a:b], "expected_grade": grade, "p_tail": p, "kept": p >= keep_at})

    rows = with_text_id(docs.select("doc_id", "text"))
    return with_long_id(rows.mapInPandas(run, "doc_id string, expected_grade double, p_tail double, kept boolean"))


def selected(docs: DataFrame, model: OrdinalModel, tail: int, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps; all columns stay."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(shared.value, tail)
        for column in batches:
            texts = filled(column)
            parts = [scorer.of(texts[a:b])[1] >= keep_at for a, b in slices(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(good("text"))
