"""Toxicity by classifier chains.

Categories are predicted one after another by logistic models over hashed
words and stems; each model also sees the probabilities of all earlier
categories.  For fitting, those come from models that didn't see the row
(``folds`` folds by a hash of the id), so later models learn from
probabilities of the quality that they get in use.

A text's features are its distinct words and their prefixes, weighted by one
over the square root of their number.  The fit uses at most ``sample`` labelled
rows, in the order of a hash of their id.  Null and empty texts have no words:
their probabilities are those of the constants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import filled, slices, with_long_id, with_text_id
from .hashed_text import WORDS_ONLY, Sparse, TokenCodes, adam, sampled_rows, sigmoid, sparse_rows, word_features

BUCKETS = 1 << 18
SAMPLE = 8192
LEAST_TEXTS = 8  #: sampled texts that a feature must be in


def _words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    words, ends = [], [0]
    for t in texts:
        words += t.lower().encode("utf-8", "replace").translate(WORDS_ONLY).split()
        ends.append(len(words))
    return words, np.array(ends, np.int64)


def _distinct(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and code of every distinct word of each document."""
    if not len(codes):
        return codes, codes
    wide = int(codes.max()) + 1
    keys = np.unique(np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * wide + codes)
    return keys // wide, keys % wide


def _rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    store = TokenCodes(word_features, BUCKETS)
    words, ends = _words(texts)
    doc, code = _distinct(store.of(words), ends)
    cuts, out = np.searchsorted(doc, np.arange(len(texts) + 1)), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        idx, count = np.unique(np.array([f for c in code[a:b] for f in store.runs[c]], np.int64), return_counts=True)
        out.append((idx, count / np.sqrt(max(1, b - a))))
    return out


@dataclass
class ChainModel:
    categories: list[str]
    weights: np.ndarray  # buckets by categories
    bias: np.ndarray
    links: np.ndarray  # links[i, j]: weight of category i's probability in the model of category j

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros_like(sums)
        for j in range(len(self.categories)):
            out[:, j] = sigmoid(sums[:, j] + self.bias[j] + out[:, :j] @ self.links[:j, j])
        return out


def _contrast(x: Sparse, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Log ratio of a feature's rates in positive and negative texts; 0 for features of too few texts."""
    seen = use[x.row]  # a row has each feature once
    idx = x.idx[seen]
    texts = np.bincount(idx, minlength=x.columns)
    positive = np.bincount(idx, y[x.row[seen]], x.columns)
    del seen, idx
    n, p = use.sum(), (y * use).sum()
    ratio = np.log((positive + 1) / (p + 2)) - np.log((texts - positive + 1) / (n - p + 2))
    return np.where(texts >= LEAST_TEXTS, ratio, 0.0)


def _fit_one(x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 60, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights, bias and weights of earlier probabilities, by class-balanced logistic loss on the rows of ``use``.

    Features are scaled by their contrast between the classes, which keeps the
    many words of one text from fitting its label.
    """
    ratio = _contrast(x, y, use)
    keep = use[x.row] & (ratio[x.idx] != 0)
    columns, idx = np.unique(x.idx[keep], return_inverse=True)
    row, val, d = x.row[keep], x.val[keep] * ratio.astype(np.float32)[x.idx[keep]], len(columns)
    del keep
    # Both classes weigh the same, so that rare categories reach their threshold.
    positive = max(1.0, float((use & (y > 0)).sum()))
    negative = max(1.0, float((use & (y <= 0)).sum()))
    share = np.where(use, np.where(y > 0, 0.5 / positive, 0.5 / negative), 0)

    def gradient(p: np.ndarray) -> np.ndarray:
        g = (sigmoid(np.bincount(row, val * p[idx], x.n) + p[d] + extra @ p[d + 1 :]) - y) * share
        return np.concatenate([np.bincount(idx, val * g[row], d) + ridge * p[:d], [g.sum()], extra.T @ g + ridge * p[d + 1 :]])

    p = adam(np.zeros(d + 1 + extra.shape[1]), gradient, steps, rate)
    weights = np.zeros(x.columns)
    weights[columns] = p[:d] * ratio[columns]
    return np.concatenate([weights, p[d:]])


def fit_chain(x: Sparse, labels: dict[str, np.ndarray], fold: np.ndarray, folds: int) -> ChainModel:
    names = list(labels)
    weights, bias, links = np.zeros((x.columns, len(names)), np.float32), np.zeros(len(names)), np.zeros((len(names), len(names)))
    earlier = np.zeros((x.n, 0))
    for j, name in enumerate(names):
        y = labels[name].astype(float)
        p = _fit_one(x, earlier, y, np.ones(x.n, bool))
        weights[:, j], bias[j], links[:j, j] = p[: x.columns], p[x.columns], p[x.columns + 1 :]
        if j + 1 < len(names):
            out_of_fold = np.zeros(x.n)
            for f in range(folds):
                p = _fit_one(x, earlier, y, fold != f)
                own = fold == f
                out_of_fold[own] = sigmoid(x.times(p[: x.columns]) + p[x.columns] + earlier @ p[x.columns + 1 :])[own]
            earlier = np.column_stack([earlier, out_of_fold])
    return ChainModel(names, weights, bias, links)


def fit_toxicity(labels: DataFrame, docs: DataFrame, categories: list[str], sample: int = SAMPLE, folds: int = 3) -> ChainModel:
    """Fit on at most ``sample`` rows of ``labels(doc_id, <categories>)`` of 0 and 1; of repeated ids the highest counts."""
    rows = sparse_rows(sampled_rows(labels, docs, categories, sample), categories, _rows)
    x = Sparse(list(rows["idx"]), list(rows["val"]), BUCKETS)
    rows = rows.drop(columns=["idx", "val"])
    fold = (rows["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(folds) if len(rows) else np.zeros(0)
    return fit_chain(x, {c: rows[c].to_numpy() for c in categories}, fold, folds)


def predict_toxicity(docs: DataFrame, model: ChainModel, flag: str, flag_at: float = 0.5) -> DataFrame:
    """``doc_id``, ``p_<category>`` of each category, and ``flagged`` by category ``flag``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = model.categories.index(flag)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, store = shared.value, TokenCodes(word_features, BUCKETS)
        for pdf in batches:
            texts = filled(pdf["text"])
            for a, b in slices(texts):
                if len(store.codes) > store.keep:
                    store.reset()
                words, ends = _words(texts[a:b])
                doc, code = _distinct(store.of(words), ends)
                sums = np.zeros((b - a, len(m.categories)))
                if len(code):
                    scores = store.scored(m.weights)[code]
                    size = np.sqrt(np.maximum(1, np.bincount(doc, minlength=b - a)))
                    for j in range(sums.shape[1]):
                        sums[:, j] = np.bincount(doc, scores[:, j], b - a) / size
                p = m.probabilities(sums)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a:b]} | {f"p_{c}": p[:, j] for j, c in enumerate(m.categories)} | {"flagged": p[:, at] >= flag_at})

    schema = "doc_id string, " + ", ".join(f"p_{c} double" for c in model.categories) + ", flagged boolean"
    return with_long_id(with_text_id(docs.select("doc_id", "text")).mapInPandas(run, schema))
