"""Hashed token features for linear models, scored once for each distinct token.

A document's linear score is a sum over its tokens, so a task keeps the score
of every distinct token that it has met and adds up codes in numpy.  Models are
arrays of ``buckets`` weights; their size doesn't depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, slices

#: ASCII characters that aren't letters or digits become spaces.
WORDS_ONLY = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Letters and digits by kind, for token shapes.
SHAPES = bytes(97 if chr(b).islower() and b < 128 else 65 if chr(b).isupper() and b < 128 else 48 if chr(b).isdigit() and b < 128 else 97 if b >= 128 else b for b in range(256))


def bucket(feature: bytes, buckets: int) -> int:
    return xxhash.xxh32_intdigest(feature) % buckets


def word_features(token: bytes, buckets: int) -> list[int]:
    """A lower-case word and its prefixes of 4 and 5 characters, which stand for stems."""
    word = token.decode("utf-8", "replace")
    return [bucket(b"w" + token, buckets)] + [bucket(b"p" + word[:n].encode(), buckets) for n in (4, 5) if len(word) >= n]


def squeezed_shape(token: bytes) -> bytes:
    """Kinds of characters of a token, each run once: ``que&&&`` has shape ``a&``."""
    kinds = token.translate(SHAPES)
    return bytes(b for i, b in enumerate(kinds) if not i or kinds[i - 1] != b)


def token_and_shape(token: bytes, buckets: int) -> list[int]:
    """A token's lower-case word and its shape."""
    word = token.lower().translate(WORDS_ONLY).strip()
    return [bucket(b"w" + word, buckets), bucket(b"s" + squeezed_shape(token), buckets)]


class TokenCodes:
    """Numbers tokens and keeps their features in flat arrays."""

    def __init__(self, features: Callable[[bytes, int], list[int]], buckets: int, keep: int = 1_000_000):
        self.features, self.buckets, self.keep = features, buckets, keep
        self.reset()

    def reset(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.runs: list[list[int]] = []
        self.scores: np.ndarray | None = None

    def of(self, tokens: list[bytes]) -> np.ndarray:
        codes, runs = self.codes, self.runs

        def code(t: bytes) -> int:
            c = codes.get(t)
            if c is None:
                c = codes[t] = len(runs)
                runs.append(self.features(t, self.buckets))
            return c

        return np.fromiter(map(code, tokens), np.int64, len(tokens))

    def scored(self, weights: np.ndarray) -> np.ndarray:
        """Each code's sum of ``weights`` (buckets by outputs) over its features."""
        done = 0 if self.scores is None else len(self.scores)
        if done < len(self.runs):
            fresh = self.runs[done:]
            lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
            flat = np.fromiter((f for r in fresh for f in r), np.int64, int(lengths.sum()))
            new = np.add.reduceat(weights[flat], np.cumsum(lengths) - lengths, axis=0)
            self.scores = new if done == 0 else np.concatenate([self.scores, new])
        return self.scores


def sampled_rows(rated: DataFrame, docs: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One text of each of at most ``limit`` rated ids, taken in the order of a hash of the id.

    The ids are bounded, so they are broadcast; the documents aren't shuffled.
    Of the rows that repeat an id, the text with the least hash is taken, before
    anything leaves the cluster.
    """
    rated = rated.where(" and ".join(f"{k} is not null" for k in ["doc_id", *keys])).select("doc_id", *keys)
    sample = rated.groupBy("doc_id").agg(*(F.max(k).alias(k) for k in keys)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("one"), *(F.first(k).alias(k) for k in keys))
    return one.select("doc_id", "one.text", *keys)


def sparse_rows(sample: DataFrame, columns: list[str], rows: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]) -> pd.DataFrame:
    """Sparse features of a bounded sample on the driver, packed as bytes, in the order of the id."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = filled(pdf["text"])
            for a, b in slices(texts):
                got = rows(texts[a:b])
                yield pdf.iloc[a:b][["doc_id", *columns]].assign(idx=[i.astype("<i4").tobytes() for i, _ in got], val=[v.astype("<f4").tobytes() for _, v in got])

    kinds = dict(sample.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *columns]) + ", idx binary, val binary"
    return sample.mapInPandas(run, schema).toPandas().sort_values(["doc_id", *columns], kind="stable").reset_index(drop=True)


class Sparse:
    """Rows of a sparse matrix (packed 32-bit columns and values), for fitting on the driver."""

    def __init__(self, idx: list[bytes], val: list[bytes], columns: int):
        lengths = np.array([len(i) // 4 for i in idx], np.int64)
        self.n, self.columns = len(idx), columns
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        self.idx = np.frombuffer(b"".join(map(bytes, idx)), "<i4")
        self.val = np.frombuffer(b"".join(map(bytes, val)), "<f4")

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.idx], self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, self.val * g[self.row], self.columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def adam(start: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam with a linearly falling rate; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x
