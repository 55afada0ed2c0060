"""Best-fit-decreasing packing of documents into sequences.

Documents are cut into full windows and one remainder.  Full windows are
sequences of their own; remainders are dealt by a hash into shards of about
``SHARD`` pieces, and each shard is packed on its own: longest piece first, each
into the open sequence with the least room that still holds it.  A segment tree
over the remaining capacity finds that sequence.  Shards bound the memory of a
task at every input size; each wastes a part of its last sequences only.

Null and empty texts are one piece, the end id alone.  Repeated rows are packed
one by one; ties in length are taken in the order of ``doc_id`` (as text, nulls last) and
``start``.  A null id is carried like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_long_id, with_text_id
from .tokens import encoder

WINDOW = 2048
SHARD = 2048


class CapacityTree:
    """Open sequences by remaining capacity; finds the smallest capacity that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = capacity + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) with the least capacity of ``need`` or more."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each length; ``lengths`` are in descending order."""
    tree, sequences, offsets, made = CapacityTree(window), [], [], 0
    for n in lengths:
        found = tree.take(n)
        room, sequence = found or (window, made)
        made += found is None
        sequences.append(sequence)
        offsets.append(window - room)
        if room > n:
            tree.put(room - n, sequence)
    return sequences, offsets


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` of the pieces of ``docs(doc_id, text)``.

    Ids are little-endian unsigned 32-bit integers; ``end_id`` closes each document.
    """
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            keys = pdf["doc_id"].to_numpy()
            for first, ids, bounds in enc.sliced(pdf["text"]):
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                total = np.diff(bounds)
                parts = -(-total // window)
                doc = np.repeat(np.arange(len(total)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, total[doc] - start)
                at = bounds[doc] + start
                yield pd.DataFrame(
                    {
                        "doc_id": keys[first + doc],
                        "start": start,
                        "length": length,
                        "doc_tokens": total[doc],
                        "ids": [ids[a : a + n].tobytes() for a, n in zip(at, length)],
                    }
                )

    rows = with_text_id(docs.select("doc_id", "text"))
    return with_long_id(rows.mapInPandas(pieces, "doc_id string, start long, length long, doc_tokens long, ids binary"))


def pack_pieces(pieces: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; other columns are carried along.

    ``pieces`` is read twice (once for its count), so it should be a stored
    table.  Its rows are dealt by their numbers, so that repeated or null ids
    spread as well.
    """
    shards = max(1, -(-pieces.count() // shard))
    fields = pieces.columns
    dealt = with_text_id(pieces).withColumn("__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = with_text_id(pieces).schema.add("sequence_id", "long").add("offset", "long")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        sequences, offsets = best_fit(pdf["length"].tolist(), window)
        out = pdf[fields].copy()
        out["sequence_id"] = (int(key[0]) << 31) + np.array(sequences, np.int64)
        out["offset"] = np.array(offsets, np.int64)
        return out

    return with_long_id(dealt.groupBy("__shard").applyInPandas(packed, schema))
