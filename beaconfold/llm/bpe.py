"""BPE encoding and decoding with a memory-mapped lexicon automaton.

Frequent chunks (runs without white space) of the corpus are compiled into a
minimal acyclic automaton over their bytes.  Equal suffixes share states; every
edge carries an output, the sum of the outputs on a chunk's path is the chunk's
number, and that number points to its ids.  The automaton is one flat buffer
that tasks map into memory; lookups step all chunks of a slice at once.  Chunks
that the lexicon lacks are encoded by the exact merge rules.

Null texts count as empty and have no ids.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, slices, stored, with_long_id, with_text_id
from .tokens import ChunkStore, numbered_chunks, tail

LEXICON_SIZE = 50_000
LONGEST = 48  #: bytes of the longest chunk that enters the lexicon


# -- exact merges -----------------------------------------------------------------------------


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeRules:
    """Normalisation, splitting and merges of a word-end BPE vocabulary file."""

    def __init__(self, path: str, keep: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.spaces = regex.compile(r"\s+")
        self.symbols = byte_symbols()
        self.memo: dict[str, list[int]] = {}
        self.keep = keep
        strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.strings = np.array([strings.get(i, "") for i in range(max(strings) + 1)], object)

    def word_ids(self, word: str) -> list[int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= self.keep:
                self.memo.clear()
            parts = [self.symbols[b] for b in word.encode()]
            parts[-1] += self.end
            got = self.memo[word] = [self.vocab[p] for p in (self._merge(parts) if len(parts) <= 64 else self._merge_long(parts)) if p in self.vocab]
        return got

    def _merge(self, parts: list[str]) -> list[str]:
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, none), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same order of merges by a heap over a linked list, for words of any length."""
        ranks, n = self.ranks, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := ranks.get((parts[p], parts[q]))) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return [p for p in parts if p is not None]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text, exact for every string."""
        out: list[int] = []
        for piece in self.special.split(chunk) if "<" in chunk else [chunk]:
            if piece in self.added:
                out.append(self.added[piece])
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
            piece = self.spaces.sub(" ", piece)
            piece = "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()
            for word in self.words.findall(piece):
                out += self.word_ids(word)
        return out


# -- lexicon automaton ------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of ``entries`` as one buffer of little-endian integers.

    Words are added in byte order; once a branch can't grow any more, its
    states are merged with equal ones from the bottom up, so suffixes are shared.
    """
    words = sorted(entries)
    registry: dict[tuple, int] = {}
    reach: list[int] = []  # words that can be read from a finished state
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # open states: (final, [(byte, state)])
    labels: list[int] = []

    def close(depth: int) -> int:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            state = registry.get(key)
            if state is None:
                state = registry[key] = len(finished)
                finished.append(key)
                reach.append(final + sum(reach[t] for _, t in edges))
            path[-1][1].append((labels.pop(), state))
        return depth

    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        close(common)
        for b in w[common:]:
            path.append([False, []])
            labels.append(b)
        path[-1][0] = True
        last = w
    close(0)
    root = len(finished)
    finished.append((path[0][0], tuple(path[0][1])))
    keys, targets, outputs = [], [], []
    for state, (final, edges) in enumerate(finished):
        before = int(final)
        for b, t in edges:
            keys.append(state * 256 + b)
            targets.append(t)
            outputs.append(before)
            before += reach[t]
    finals = np.array([f for f, _ in finished], np.int64)
    runs = [entries[w] for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64) if runs else np.zeros(1, np.int64)
    ids = np.array([i for r in runs for i in r], np.int64)
    head = np.array([root, len(keys), len(finals), len(offsets), len(ids)], np.int64)
    return b"".join(np.asarray(a, "<i8").tobytes() for a in (head, keys, targets, outputs, finals, offsets, ids))


class Lexicon:
    """A compiled automaton, mapped from a file."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i8", "r")
        self.root, *sizes = (int(x) for x in data[:5])
        e, s, o, i = sizes
        at = np.cumsum([5, e, e, e, s, o, i])
        self.keys, self.targets, self.outputs, self.finals, self.offsets, self.ids = (data[a:b] for a, b in zip(at[:-1], at[1:]))

    @classmethod
    def of(cls, buffer: bytes) -> Lexicon:
        """Map ``buffer`` from a file of this process, which goes once it is mapped."""
        with tempfile.NamedTemporaryFile(suffix=".lexicon") as f:
            f.write(buffer)
            f.flush()
            return cls(f.name)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if the lexicon lacks it; all words advance byte by byte together."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        if not len(self.keys):
            return out
        state, number, depth = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * 256 + text[starts[live] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            live, edge = live[ok], edge[ok]
            state, number = self.targets[edge], number[ok] + self.outputs[edge]
            depth += 1
            done = lengths[live] == depth
            hit = done & (self.finals[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~done], state[~done], number[~done]
        return out

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and joined ids of the words with these numbers."""
        lengths = self.offsets[numbers + 1] - self.offsets[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[numbers] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return lengths, self.ids[at]


# -- DataFrame operations ---------------------------------------------------------------------


def frequent_chunks(docs: DataFrame, size: int = LEXICON_SIZE) -> list[str]:
    """The most frequent chunks of all texts, of two occurrences or more: about ``size`` at most.

    Counted in the cluster with partial sums.  The driver gets how many chunks
    have each count, sets the least count from that, and then gets the chunks,
    short strings.  Where not all chunks of the least count fit, a share of them
    is taken by a hash, so that any number of ties fills the lexicon.
    """
    chunk = F.explode(F.split("text", "[ \\t\\r\\n]+")).alias("chunk")
    short = docs.select(chunk).where((F.col("chunk") != "") & (F.octet_length("chunk") <= LONGEST))
    counted = stored(short.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1"), "chunk-counts")
    least, share, total = 1 << 62, 0.0, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("chunks")).collect(), key=lambda r: -r.n):
        least, share = r.n, min(1.0, (size - total) / r.chunks)
        total += r.chunks
        if total >= size:
            break
    draw = F.pmod(F.xxhash64("chunk"), F.lit(1 << 30)) < int(share * (1 << 30))
    return sorted(r.chunk for r in counted.where((F.col("n") > least) | (F.col("n") == least) & draw).select("chunk").collect())


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON_SIZE) -> bytes:
    rules = MergeRules(vocabulary)
    return compile_lexicon({w.encode(): rules.chunk_ids(w) for w in frequent_chunks(docs, size)})


class _Worker:
    """A Python worker's rules, lexicon, and ids and decoded text of the chunks met so far."""

    def __init__(self, token: str, rules: MergeRules, lexicon: Lexicon, keep: int = 500_000):
        self.token, self.rules, self.lexicon, self.keep = token, rules, lexicon, keep
        self.reset()

    def reset(self) -> None:
        self.store, self.decoded = ChunkStore(), []

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Numbers of distinct chunks; new ones are looked up in the lexicon, or merged."""
        store = self.store
        codes = np.fromiter(map(store.codes.__getitem__, chunks), np.int64, len(chunks))
        fresh = tail(store.codes, store.known)
        if fresh:
            numbers = self.lexicon.numbers([w.encode("utf-8", "replace") for w in fresh])
            known = numbers >= 0
            merged = [self.rules.chunk_ids(fresh[i]) for i in np.flatnonzero(~known)]
            lengths = np.zeros(len(fresh), np.int64)
            hit_lengths, hit_ids = self.lexicon.runs(numbers[known])
            lengths[known], lengths[~known] = hit_lengths, [len(m) for m in merged]
            ids = np.zeros(int(lengths.sum()), np.uint32)
            from_lexicon = np.repeat(known, lengths)
            ids[from_lexicon], ids[~from_lexicon] = hit_ids, [i for m in merged for i in m]
            store.add(lengths, ids)
            strings, ends = self.rules.strings[ids].tolist(), np.cumsum(lengths).tolist()
            self.decoded += [" ".join(strings[a:b]) for a, b in zip([0, *ends], ends)]
        return codes


_WORKER: list[_Worker] = []


class BpeCodec:
    """Encodes and decodes text columns with a compiled lexicon (bounded by its size and longest chunk)."""

    def __init__(self, spark, vocabulary: str, lexicon: bytes):
        self.vocabulary = vocabulary
        self.lexicon = spark.sparkContext.broadcast(lexicon)

    def _worker(self) -> _Worker:
        token = f"{self.vocabulary}|{self.lexicon._path if hasattr(self.lexicon, '_path') else id(self.lexicon)}"
        if not _WORKER or _WORKER[0].token != token:
            rules = _WORKER[0].rules if _WORKER and _WORKER[0].token.split("|")[0] == self.vocabulary else MergeRules(self.vocabulary)
            _WORKER[:] = [_Worker(token, rules, Lexicon.of(self.lexicon.value))]
        return _WORKER[0]

    def encode_texts(self, texts: list[str], decode: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids joined, each text's bounds in them, and on demand the decoded texts."""
        worker = self._worker()
        if len(worker.store.codes) > worker.keep:
            worker.reset()
        distinct, place, ends = numbered_chunks(texts)
        codes = worker.codes(distinct.to_pylist())[place]
        ids, run = worker.store.gather(codes)
        decoded: list[str] = []
        if decode:
            # Ids decode one by one, so a text decodes to its chunks' texts; chunks without ids leave no space.
            some, strings = run > 0, worker.decoded
            at = np.concatenate([[0], np.cumsum(some)])[ends].tolist()
            parts = [strings[c] for c in codes[some].tolist()]
            decoded = [" ".join(parts[a:b]) for a, b in zip(at[:-1], at[1:])]
        return ids, np.concatenate([[0], np.cumsum(run)])[ends], decoded

    def decode_ids(self, ids: np.ndarray) -> str:
        """The library's decode for vocabularies without a decoder: token strings parted by spaces."""
        return " ".join(self._worker().rules.strings[ids])

    def encode(self, docs: DataFrame, decode: bool = False) -> DataFrame:
        """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) and, on demand, ``decoded`` text."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts = filled(pdf["text"])
                for a, b in slices(texts):
                    ids, bounds, decoded = self.encode_texts(texts[a:b], decode)
                    spans = list(zip(bounds[:-1], bounds[1:]))
                    out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a:b], "n_tokens": np.diff(bounds), "ids": [ids[s:e].astype("<u4").tobytes() for s, e in spans]})
                    if decode:
                        out["decoded"] = decoded
                    yield out

        rows = with_text_id(docs.select("doc_id", "text"))
        return with_long_id(rows.mapInPandas(run, "doc_id string, n_tokens long, ids binary" + ", decoded string" * decode))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """``doc_id, text`` of ``encoded(doc_id, ids)``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [self.decode_ids(np.frombuffer(b or b"", "<u4")) for b in pdf["ids"]]})

        return with_long_id(with_text_id(encoded.select("doc_id", "ids")).mapInPandas(run, "doc_id string, text string"))
