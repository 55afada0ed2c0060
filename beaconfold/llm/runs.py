"""Maximal periodic runs of words, by Lyndon words under both orders.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal) of at least ``2 * q`` words that no neighbouring word extends.  Every run
has a Lyndon root that is the longest Lyndon word at its start, under the order
of words or under the reversed one.  So the texts are scanned from right to left
with a stack of Lyndon words under each order; two suffixes are compared by
their longest common extension (LCE), found by halving on rolling hashes of
prefixes and then compared word by word.  Each longest Lyndon word is extended
to both sides by LCE; it is the root of a run if both sides add a period.  What
hashes say is never taken on trust: words decide, and a stretch that was once
compared on a diagonal isn't compared again.

Words are what ASCII white space parts.  A slice of texts is handled as one
sequence with a different separator after each text, smaller than every word;
no run or Lyndon word reaches over it.

Null and empty texts have no words, hence no runs and an empty collapsed text.
Rows are independent of each other: repeated rows (and null ids) give a row
each; equal words tie in both orders, where the shorter suffix is smaller.  Other
columns than ``doc_id`` and ``text`` are ignored, so their names may clash.  A
task's memory follows a slice of texts, or its longest text where one is longer.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filled, slices, with_long_id, with_text_id

LEAST_WORDS = 12  #: shorter runs don't count
_DIRECT = 8  #: words that are compared before hashes are asked
_BASE = 0x9E3779B97F4A7C15  # any odd multiplier
_FULL = (1 << 64) - 1

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each number, as if at random."""
    x = codes.astype(np.int64).view(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordSequence:
    """Numbered words with negative, pairwise different separators at both ends and between texts."""

    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)  # modulo 2 ** 64
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes) * self.power[:n], dtype=np.uint64, out=self.prefix[1:])
        #: By distance: the last extension that was compared; its words equal those so far on, the word after them doesn't.
        self.compared: dict[int, tuple[int, int]] = {}

    def hashes_agree(self, i: np.ndarray, j: np.ndarray, n) -> np.ndarray:
        """Whether the ``n`` words from ``i`` on may be those from ``j`` on (``i < j``); arrays of places inside the sequence."""
        return (self.prefix[i + n] - self.prefix[i]) * self.power[j - i] == self.prefix[j + n] - self.prefix[j]

    def _agree(self, i: int, j: int, n: int) -> bool:
        at = self.prefix
        return ((int(at[i + n]) - int(at[i])) * int(self.power[j - i]) - int(at[j + n]) + int(at[j])) & _FULL == 0

    def _compared(self, i: int, d: int, n: int) -> int:
        """How many of ``n`` words from ``i`` on equal those ``d`` further on, word by word where that isn't known."""
        lo, hi = self.compared.get(d, (0, 0))
        end = i + n
        parts = [(i, min(lo, end)), (hi, end)] if i <= lo <= end else [(i, end)]
        for a, b in parts:
            if a < b:
                same = self.codes[a:b] == self.codes[a + d : b + d]
                if not same.all():
                    end = a + int(same.argmin())
                    break
        self.compared[d] = (i, max(hi, end) if i <= lo <= end else end)
        return end - i

    def lce(self, i: int, j: int, words: list[int]) -> int:
        """Length of the longest common extension of places ``i < j``; ``words`` has the codes, or any numbers that part them alike."""
        lo, hi = self.compared.get(j - i, (0, 0))
        n = 0
        while n < _DIRECT:
            if lo <= i + n < hi:  # an extension on this diagonal that was found before ends where this one does
                self.compared[j - i] = min(lo, i), hi
                return hi - i
            if words[i + n] != words[j + n]:
                return n
            n += 1
        step = _DIRECT
        while j + n + step <= len(words) and self._agree(i + n, j + n, step):
            n += step
            step *= 2
        while step > 1:
            step //= 2
            if j + n + step <= len(words) and self._agree(i + n, j + n, step):
                n += step
        return self._compared(i, j - i, n)

    def extensions(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """LCE by hashes of many places at once: of suffixes, or (``back``) of prefixes that end before them."""
        n, size = np.zeros(len(i), np.int64), len(self.codes)
        failed = np.zeros(len(i), np.int64)  # the step at which doubling ended

        def agree(k: np.ndarray, step: int) -> np.ndarray:
            a, b = (i[k] - n[k] - step, j[k] - n[k] - step) if back else (i[k] + n[k], j[k] + n[k])
            inside = (a >= 0) & (b + step <= size)
            out = np.zeros(len(k), bool)
            out[inside] = self.hashes_agree(a[inside], b[inside], step)
            return out

        open_, step = np.arange(len(i)), 1
        while len(open_):
            ok = agree(open_, step)
            failed[open_[~ok]] = step
            open_ = open_[ok]
            n[open_] += step
            step *= 2
        while step > 1:
            step //= 2
            k = np.flatnonzero(failed > step)
            k = k[agree(k, step)]
            n[k] += step
        return n

    def exact(self, i: int, j: int, left: int, right: int) -> tuple[int, int]:
        """The claimed extensions of a word at ``i`` with the next one at ``j``, shortened to those that words bear out."""
        d = j - i
        same = self.codes[i - left : i + right] == self.codes[j - left : j + right]
        if same.all():
            return left, right
        wrong = np.flatnonzero(~same) - left
        return -1 - int(wrong[wrong < 0].max(initial=-left - 1)), int(wrong[wrong >= 0].min(initial=right))


def lyndon_ends(ranks: list[int], sequence: WordSequence) -> np.ndarray:
    """Where the longest Lyndon word at each place ends: the nearest place to the right whose suffix is smaller."""
    ends = [0] * len(ranks)
    stack: list[int] = []
    lce = sequence.lce
    for i in range(len(ranks) - 1, -1, -1):
        x = ranks[i]
        if x < 0:
            stack = [i]
            continue
        while True:
            j = stack[-1]
            y = ranks[j]
            if y < x:
                break
            if y == x:
                n = lce(i, j, ranks)
                if ranks[j + n] < ranks[i + n]:
                    break
            stack.pop()
        ends[i] = j
        stack.append(i)
    return np.array(ends, np.int64)


def sequence_runs(codes: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``least`` words or more, in order of start and period.

    ``codes`` are word numbers from 0 on; negative ones, all different, are
    separators, and one stands at either end.
    """
    sequence, top = WordSequence(codes), int(codes.max(initial=0))
    found: set[tuple[int, int, int]] = set()
    words = np.flatnonzero(codes >= 0)
    for ranks in (codes, np.where(codes < 0, codes, top - codes)):
        ends = lyndon_ends(ranks.tolist(), sequence)
        i, j = words, ends[words]
        near = (codes[i] == codes[j]) | (codes[i - 1] == codes[j - 1])
        i, j = i[near], j[near]
        period, right = j - i, sequence.extensions(i, j, back=False)
        left = sequence.extensions(i, j, back=True)
        run = left + right >= np.maximum(period, least - period)
        claims = np.stack([i - left, j + right, period, i], 1)[run]
        # Roots of one run make the same claim; one of them is enough.
        _, once = np.unique(claims[:, :3], axis=0, return_index=True)
        for a, b, p, at in claims[once].tolist():
            back, on = sequence.exact(at, at + p, at - a, b - at - p)
            if back + on >= max(p, least - p):
                found.add((at - back, back + on + p, p))
    out = np.array(sorted(found), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def text_runs(texts: list[list[bytes]], least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all ``texts`` (lists of words), by place in the sequence of all, and where each text starts in it."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    codes = np.empty(1 + int(lengths.sum()) + len(texts), np.int64)
    numbered = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    apart = np.ones(len(codes), bool)
    apart[0] = apart[starts + lengths] = False
    codes[apart] = numbered.indices.to_numpy()
    codes[~apart] = -1 - np.arange(len(texts) + 1)
    return sequence_runs(codes, least), starts


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs(doc_id, text)``.

    ``runs`` are in order of start and period, starts are word numbers from 0 on.
    ``collapsed`` has the words that no run contains after its first period,
    joined by a space.  Nothing is shuffled.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), filled(pdf["text"])
            for first, last in slices(texts):
                words = [t.encode().split() for t in texts[first:last]]
                runs, starts = text_runs(words, least)
                rows: list[list[dict]] = [[] for _ in words]
                dropped: dict[int, np.ndarray] = {}
                for k, (start, length, period) in zip((np.searchsorted(starts, runs[:, 0], "right") - 1).tolist(), runs.tolist()):
                    start -= int(starts[k])
                    rows[k].append({"start": start, "length": length, "period": period})
                    gone = dropped.setdefault(k, np.zeros(len(words[k]), bool))
                    gone[start + period : start + length] = True
                kept = [[w for w, g in zip(ws, dropped[k].tolist()) if not g] if k in dropped else ws for k, ws in enumerate(words)]
                yield pd.DataFrame({"doc_id": ids[first:last], "n_words": [len(w) for w in words], "runs": rows, "collapsed": [b" ".join(w).decode() for w in kept]})

    rows = with_text_id(docs.select("doc_id", "text"))
    return with_long_id(rows.mapInPandas(find, f"doc_id string, n_words long, runs array<{RUN}>, collapsed string"))
