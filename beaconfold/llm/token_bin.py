"""Token-id files with fixed-width bit packing.

A file set is a table of *blocks* written by Spark.  A block holds whole
documents in ascending document order, ``block_ids`` ids or a little more; its
``payload`` stores every id in ``bits`` bits (the fewest that hold the largest
vocabulary id), least significant bit first, so that id ``i`` starts at bit
``i * bits`` and any range can be unpacked without reading what lies before it.
``before`` counts the ids of the part that precede the block.

Empty and null texts are documents of the end id alone.  Rows that repeat an id
stay apart, ordered by a hash of their text, and may lie in several parts.  A null
``doc_id`` sorts first.  A task holds a slice of texts, or one text where it is
longer.  An empty table has no blocks and gives no rows.  Only ``doc_id`` and
``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_long_id, with_text_id
from .tokens import encoder

BLOCK_IDS = 1 << 16
BLOCKS = "part int, block int, before long, n_ids long, bits int, doc_ids array<bigint>, doc_lengths array<bigint>, payload binary"


def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each; eight spare bytes let readers load whole words."""
    if bits == 16:
        body = ids.astype("<u2").tobytes()
    else:
        lanes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        body = np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return body + b"\0" * 8


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """The ``n`` ids from number ``start`` on, by vectorised shifts of 64-bit loads."""
    if bits == 16:
        return np.frombuffer(payload, "<u2", n, 2 * start).astype("<u4")
    raw = np.frombuffer(payload, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 7,), (1,), writeable=False)
    at = np.arange(start, start + n, dtype=np.int64) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write the block files to the shared folder, return their table.

    Documents are dealt by ranges of ``doc_id``, so part numbers follow the
    order of ids and every text is shuffled and encoded once.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        bits = bits_for(max(enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id))
        part, block, before = TaskContext.get().partitionId(), 0, 0
        runs: list[np.ndarray] = []  # ids of whole documents, a run for each stretch of a slice
        keys: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal block, before, runs, keys, lengths, held
            row = pd.DataFrame([{"part": part, "block": block, "before": before, "n_ids": held, "bits": bits, "doc_ids": keys, "doc_lengths": lengths, "payload": pack(np.concatenate(runs), bits)}])
            block, before = block + 1, before + held
            runs, keys, lengths, held = [], [], [], 0
            return row

        for pdf in batches:
            own = [None if k is None else int(k) for k in pdf["doc_id"]]
            for first, ids, bounds in enc.sliced(pdf["text"]):
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                at, n = 0, len(bounds) - 1
                while at < n:
                    # As many documents as fill the block, one at least.
                    to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + block_ids - held))))
                    runs.append(ids[bounds[at] : bounds[to]])
                    keys += own[first + at : first + to]
                    lengths += np.diff(bounds[at : to + 1]).tolist()
                    held += len(runs[-1])
                    if held >= block_ids:
                        yield flush()
                    at = to
        if held:
            yield flush()

    # Rows of one id are dealt by their text's hash, equal ones by their place, so many of them spread over parts as well.
    place = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = docs.select("doc_id", "text", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(place))).alias("place"))
    ordered = dealt.repartitionByRange("place").sortWithinPartitions("place").drop("place")
    return stored(with_text_id(ordered).mapInPandas(blocks, BLOCKS), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ids as little-endian unsigned 32-bit integers.

    ``start`` adds the ids of earlier parts, of earlier blocks and of earlier
    documents.  The table of parts has one row for each task that wrote, so it is
    broadcast and the payloads stay where they are read.
    """
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    starts = sums.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("part_start"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples():
                lengths = np.asarray(b.doc_lengths, np.int64)
                ends = np.cumsum(lengths)
                ids = unpack(b.payload, b.bits, 0, b.n_ids)
                yield pd.DataFrame(
                    {
                        "doc_id": list(b.doc_ids),
                        "start": b.part_start + b.before + ends - lengths,
                        "n_tokens": lengths,
                        "ids": [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)],
                    }
                )

    placed = files.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).join(F.broadcast(starts), "part")
    return with_long_id(placed.mapInPandas(documents, "doc_id string, start long, n_tokens long, ids binary"))
