"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
distinct character n-grams (one to four bytes of lower-case letters, hashed to
``BUCKETS``) that both have, over the geometric mean of their numbers.  Nyström
landmarks turn kernel ridge regression, one language against the rest, into one
``buckets x landmarks`` and one ``landmarks x languages`` matrix; texts are
scored in batches by products with these.

The model is fitted on at most ``per_language`` texts of each language, in the
order of a hash of id and text, of which ``landmarks`` become landmarks; rows
that repeat id and text count once.  The
score is the softmax of the regressions' values, so it lies between 0 and 1.
A text of a language that wasn't learnt has a highest score like any other, so
rows are recognised by the unnormalised value instead: it has to reach the value
that all but ``REJECTED`` of the learnt texts have in leave-one-out regression.
Texts that are null or have no letter are ``und`` with score 0; ties between
languages go to the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, filled, slices, with_long_id, with_text_id

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
LANDMARKS = 96
PER_LANGUAGE = 384
BATCH = 128
SHARPNESS = 6.0
REJECTED = 0.005  #: share of the learnt texts whose value is too low to be recognised
HASHES = 1 << 62  #: rows are sampled by a hash below this

#: ASCII characters that aren't letters become spaces.
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams each text has."""
    parts = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split()) + b" " for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    base = np.repeat(np.arange(len(parts), dtype=np.int64) * BUCKETS, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes left in the text
    out = np.zeros(len(parts) * BUCKETS, np.float32)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            mixed = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
            inside = left[: len(code)] >= n
            out[(base[: len(code)] + mixed)[inside]] = 1
    return out.reshape(len(parts), BUCKETS)


def has_letter(text) -> bool:
    return isinstance(text, str) and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # buckets by landmarks, each column over the root of its number of n-grams
    regression: np.ndarray  # landmarks by languages
    bias: np.ndarray
    least_value: float = -np.inf  #: what the highest value of a text of a learnt language reaches

    def values(self, x: np.ndarray) -> np.ndarray:
        kernel = (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return kernel @ self.regression + self.bias

    def text_values(self, texts: list[str]) -> np.ndarray:
        z = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(texts), BATCH):
            z[a : a + BATCH] = self.values(presence(texts[a : a + BATCH]))
        return z

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and score of each text."""
        z = self.text_values(texts)
        z = np.exp(SHARPNESS * (z - z.max(1, keepdims=True)))
        return z.argmax(1), (z / z.sum(1, keepdims=True)).max(1)


def fit_kernel_ridge(x: np.ndarray, language: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> LanguageModel:
    """Nyström features of the landmarks' kernel, then ridge regression to +1 and -1 for each language."""
    names = sorted(set(language))
    label = np.searchsorted(names, language)
    order = np.lexsort((np.arange(len(label)), np.concatenate([np.arange(n) for n in np.bincount(label)])[np.argsort(np.argsort(label, kind="stable"), kind="stable")]))
    chosen = order[: min(landmarks, len(order))]  # in turn from each language
    marks = (x[chosen] / np.sqrt(np.maximum(x[chosen].sum(1, keepdims=True), 1))).T.astype(np.float32)
    kernel = (x @ marks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1.0 / np.bincount(label))[label][:, None]  # languages weigh the same
    weight *= len(label) / weight.sum()
    centre, target = (phi * weight).mean(0), (y * weight).mean(0)
    a, b = (phi - centre) * np.sqrt(weight), (y - target) * np.sqrt(weight)
    gram = a.T @ a + ridge * len(label) / 100 * np.eye(a.shape[1])
    w = np.linalg.solve(gram, a.T @ b)
    # Each text's value for its own language by the regression of all others; landmarks are left out, as their kernels hold themselves.
    leverage = np.einsum("ij,ij->i", a, np.linalg.solve(gram, a.T).T) + weight[:, 0] / len(label)
    others = np.setdiff1d(np.arange(len(label)), chosen)
    fitted = (phi[others] - centre) @ w + target
    spared = (y[others] - (y[others] - fitted) / np.maximum(1e-6, 1 - leverage[others, None]))[np.arange(len(others)), label[others]]
    least = float(np.quantile(spared, REJECTED, method="lower")) if len(others) else -np.inf
    return LanguageModel(names, marks, (root @ w).astype(np.float32), (target - centre @ w).astype(np.float32), least)


def fit_language_model(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Fit on rows of ``docs(doc_id, text, lang)`` that ``learn`` allows; None if there are none.

    Executors send each sampled text as bits, and what the driver gets is
    bounded by ``per_language`` and the number of languages however often an id
    (null as well) or a row repeats.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("at", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(HASHES - 1)))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()}
    if not counts:
        return None

    def up_to(limits: dict[str, int]) -> DataFrame:
        """The rows whose hash is at most their language's limit."""
        limit = F.create_map(*(F.lit(v) for lang, n in sorted(limits.items()) for v in (lang, n)))
        return rows.where(F.col("at") <= limit[F.col("lang")])

    # Twice the target share of each language's distinct hashes holds the first ones; the last of these is the limit.
    wide = up_to({lang: int(min(1.0, (2.0 * per_language + 8.0) / n) * (HASHES - 1)) for lang, n in counts.items()})
    first = wide.select("lang", "at").distinct().toPandas().sort_values("at").groupby("lang").head(per_language)
    sample = up_to({lang: int(n) for lang, n in first.groupby("lang")["at"].max().items()}).select("at", "lang", "text")

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()  # bounded as the sample is
        for pdf in batches:
            fresh = [k not in seen and not seen.add(k) for k in zip(pdf["lang"], pdf["at"])]
            pdf = pdf[np.array(fresh, bool)]
            texts = filled(pdf["text"])
            for a in range(0, len(texts), BATCH):
                packed = np.packbits(presence(texts[a : a + BATCH]).astype(np.uint8), axis=1)
                yield pdf.iloc[a : a + BATCH][["at", "lang"]].assign(bits=[r.tobytes() for r in packed])

    got = sample.mapInPandas(bits, "at long, lang string, bits binary").groupBy("lang", "at").agg(F.min("bits").alias("bits")).toPandas()
    got = got.sort_values(["lang", "at"])
    x = np.unpackbits(np.frombuffer(b"".join(map(bytes, got["bits"])), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    return fit_kernel_ridge(x, got["lang"].tolist(), landmarks)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            known = np.array([m is not None and has_letter(t) for t in pdf["text"]], bool)
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            texts = [t for t, k in zip(pdf["text"], known) if k]
            at = np.flatnonzero(known)
            for a, b in slices(texts):
                best, s = m.predict(texts[a:b])
                lang[at[a:b]], score[at[a:b]] = np.array(m.languages, object)[best], s
            yield pdf[["doc_id"]].assign(lang_pred=lang, score=score)

    rows = with_text_id(docs.select("doc_id", "text"))
    return with_long_id(rows.mapInPandas(run, "doc_id string, lang_pred string, score double"))


def recognised(docs: DataFrame, model: LanguageModel | None, least_value: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a learnt language; all columns stay.

    Its value has to reach ``least_value`` (the model's own, where none is
    given).  Texts that are null or have no letter go, and all do without a model.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        least = -np.inf if m is None else m.least_value if least_value is None else least_value
        for texts in batches:
            keep = np.array([m is not None and has_letter(t) for t in texts], bool)
            at = np.flatnonzero(keep)
            some = [texts.iat[i] for i in at]
            for a, b in slices(some):
                keep[at[a:b]] = m.text_values(some[a:b]).max(1) >= least
            yield pd.Series(keep)

    return docs.where(known("text"))
