"""Integer vectors: rounding down to 1/256, blocks of queries, and best rows of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrow batches hold about this many bytes, since a row may hold a vector or a page of them.
BATCH_BYTES = 32 << 20
#: Integers below this are exact as doubles, in any order of summing.
EXACT = 1 << 53


def bounded_bytes(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``, after the session's Arrow batches were bounded by bytes; a smaller bound of the session stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key).rstrip("bB")) <= most:
        conf.set(key, str(most))
    return df


def is_finite(vector: str) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    return F.expr(f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def floored(vector: str, scale: int = 256) -> Column:
    """Each component ``x`` as ``floor(scale * x)``, with ``x`` as double."""
    return F.expr(f"transform({vector}, x -> floor({scale} * cast(x as double)))")


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def integer_products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """``a @ b.T`` of integer rows, in doubles where these are ``exact`` (then fast), else in 64-bit integers."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


def facts(rows: DataFrame, vector: str = "q") -> tuple[int, int, bool]:
    """Number of rows, greatest length of a vector, and whether inner products are exact in doubles."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"), F.max(F.expr(f"aggregate({vector}, 0D, (m, x) -> greatest(m, abs(cast(x as double))))")).alias("m")).first()
    return r.n, max(1, r.d or 1), (r.d or 1) * (r.m or 0.0) ** 2 < EXACT / 4


def blocks(rows: DataFrame, size: int) -> Iterator[DataFrame]:
    """``rows`` (a stored table) in blocks of about ``size``, by a hash of row numbers, so repeated ids spread as well."""
    n = -(-rows.count() // size)
    if n <= 1:
        yield rows
        return
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    for b in range(n):
        yield dealt.where(F.col("__block") == b).drop("__block")


def best(rows: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """The ``k`` rows of each group with the highest score, ties to the smaller id (nulls last), with their ``rank``.

    ``rows`` hold a few candidates from each task that searched; groups are reduced to ``k`` before they are shuffled.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


#: Null ids inside tasks: they come after all others.
NO_ID = (1 << 63) - 1


def ids_of(column: pd.Series) -> np.ndarray:
    """Ids that were sent as text, as integers; a null is ``NO_ID``."""
    return np.array([NO_ID if k is None or k != k else int(k) for k in column], np.int64)


def as_text(ids) -> list[str | None]:
    return [None if k == NO_ID else str(k) for k in np.asarray(ids).tolist()]
