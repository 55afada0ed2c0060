"""Token ids of whole texts by the ``tokenizers`` library, each distinct chunk encoded once.

The tokenizers used here drop white space and never join across it, so a text's
ids are those of its chunks between white space, one after another.  Chunks are
numbered in Arrow; a comma or full stop after a letter and the case of ASCII
letters are taken off (where the vocabulary's rules part and lower-case words
so), which leaves far fewer words.  A task keeps the ids of the words that it has
met and asks the library only for new ones, many at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import filled, slices

#: White space of the tokenizers' Unicode class that ``str.split`` treats the
#: same; these four separators split only in Python, so such texts take the
#: narrower pattern.
_PYTHON_ONLY = "\x1c\x1d\x1e\x1f"
_NARROW = re.compile("[ \t\r\n]+")
STOPS = ",."  #: characters that often end a chunk
#: A stop after a letter that stays one letter in lower case and in every normal form.
_STOPPED = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][,.]$"


def _separated(text: str) -> bool:
    return any(c in text for c in _PYTHON_ONLY)


def split_chunks(text: str) -> list[str]:
    if _separated(text):
        return [c for c in _NARROW.split(text) if c]
    return text.split()


def numbered_chunks(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct chunks of ``texts``, the number of each chunk in turn, and where each text's chunks start and end.

    An empty string, which has no ids, may stand among them.
    """
    if any(map(_separated, texts)):
        split = [split_chunks(t) for t in texts]
        values = pa.array([c for chunks in split for c in chunks], pa.string())
        ends = np.cumsum([0, *map(len, split)])
    else:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        values, ends = split.values, split.offsets.to_numpy().astype(np.int64)
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), ends


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class ChunkStore:
    """Integer runs (ids) by chunk code, appended to and gathered in bulk."""

    def __init__(self):
        self.codes = _Numbered()
        self.known = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1, np.int64)

    def add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        at, end = int(self.off[-1]), int(self.off[-1]) + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(max(end, 2 * len(self.flat)) - at, np.uint32)])
        self.flat[at:end] = ids
        self.off = np.concatenate([self.off, at + np.cumsum(lengths, dtype=np.int64)])
        self.known = len(self.off) - 1

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``codes`` joined, and each run's length."""
        lengths = (self.off[1:] - self.off[:-1])[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.off[codes] - (ends - lengths), lengths)
        at += np.arange(total)
        return self.flat[at], lengths


class LibraryEncoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, keep: int = 500_000, group: int = 500):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.group = keep, group
        #: An added token that the library cuts out of the raw text: it parts
        #: the chunks of one call.
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = special[-1] if special else None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normal, parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = normal is not None and normal.normalize_str("Az") == "az"
        self.parts_stops = parts is not None and all([p for p, _ in parts.pre_tokenize_str(f"az{c}")] == ["az", c] for c in STOPS)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: For each id whether it ends a word, in vocabularies that mark such ids.
        self.ends_word = None
        if suffix:
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.reset()

    def reset(self) -> None:
        self.words, self.older = ChunkStore(), ChunkStore()

    def renew(self) -> None:
        """Starts a new store; words that come up again are taken from the one before, so only rare ones are forgotten."""
        self.words, self.older = ChunkStore(), self.words

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def _between_marks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of ``words``, and all ids, from calls that join them by an added token."""
        if self.mark is None or self._special("\n".join(words)):
            runs = self._ids(words)
            return np.array([len(r) for r in runs], np.int64), np.concatenate([*runs, np.zeros(0, np.uint32)])
        number, mark = self.mark
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for run in self._ids([mark.content.join(words[i : i + self.group]) for i in range(0, len(words), self.group)]):
            cuts = np.flatnonzero(run == number)
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(run)]])) - 1)
            ids.append(run[run != number])
        return np.concatenate(lengths), np.concatenate(ids)

    def _between_spaces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, whose last ids end a word: these part them, and spaces cost less than marks."""
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        groups = [words[i : i + self.group] for i in range(0, len(words), self.group)]
        for group, run in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.ends_word[run]) + 1
            counts = np.diff(np.concatenate([[0], ends]))
            if len(ends) != len(group) or ends[-1] != len(run):  # a letter that the vocabulary's rules turn into something else
                counts, run = self._between_marks(group)
            lengths.append(counts)
            ids.append(run)
        return np.concatenate(lengths), np.concatenate(ids)

    def _learn_words(self, fresh: list[str]) -> None:
        """Adds the ids of words that are new to this store."""
        met = np.fromiter((self.older.codes.get(w, -1) for w in fresh), np.int64, len(fresh)) if self.older.known else np.full(len(fresh), -1)
        kinds = np.where(met >= 0, 0, 1 + np.fromiter(map(str.isalpha, fresh), bool, len(fresh)) * (self.ends_word is not None))
        lengths, found = np.zeros(len(fresh), np.int64), []
        for kind in range(3):
            own = np.flatnonzero(kinds == kind)
            if kind == 0:
                ids, lengths[own] = self.older.gather(met[own])
            else:
                ask = self._between_marks if kind == 1 else self._between_spaces
                lengths[own], ids = ask([fresh[i] for i in own])
            found.append(ids)
        ids, place = np.zeros(int(lengths.sum()), np.uint32), np.repeat(kinds, lengths)
        for kind in range(3):
            ids[place == kind] = found[kind]
        self.words.add(lengths, ids)

    def _codes(self, words: pa.StringArray) -> np.ndarray:
        """The store's numbers of ``words``, which it learns where it doesn't have them."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        codes = np.fromiter(map(self.words.codes.__getitem__, distinct), np.int64, len(distinct))
        if fresh := tail(self.words.codes, self.words.known):
            self._learn_words(fresh)
        return codes[coded.indices.to_numpy()]

    def _pieces(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the distinct ``chunks`` the number of its word, and of the stop after it (-1 if none)."""
        whole = np.zeros(len(chunks), bool)
        for special in self.specials:
            # In any case of letters: lower-cased, such a chunk would turn into the special token.
            whole |= pc.match_substring(chunks, special, ignore_case=True).to_numpy(zero_copy_only=False)
        stopped = np.zeros(len(chunks), bool)
        if self.parts_stops:
            stopped = pc.match_substring_regex(chunks, _STOPPED).to_numpy(zero_copy_only=False) & ~whole
        words = pc.if_else(pa.array(stopped), pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        if self.lowers:
            words = pc.if_else(pc.and_(pa.array(~whole), pc.string_is_ascii(words)), pc.ascii_lower(words), words)
        stops = pc.utf8_slice_codeunits(chunks.filter(pa.array(stopped)), -1)
        codes = self._codes(pa.concat_arrays([words, stops]))
        after = np.full(len(chunks), -1, np.int64)
        after[stopped] = codes[len(chunks) :]
        return codes[: len(chunks)], after

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` joined, and where each text's ids start and end (one more than texts)."""
        if len(self.words.codes) > self.keep:
            self.renew()
        distinct, at, ends = numbered_chunks(list(texts))
        words, stops = self._pieces(distinct)
        stopped = stops[at] >= 0
        place = np.arange(len(at)) + np.cumsum(stopped) - stopped  # of each chunk's word; its stop follows
        codes = np.empty(len(at) + int(stopped.sum()), np.int64)
        codes[place], codes[place[stopped] + 1] = words[at], stops[at[stopped]]
        ids, lengths = self.words.gather(codes)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.append(place, len(codes))[ends]]

    def sliced(self, texts) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, bounds) of slices of bounded size; nulls count as empty texts."""
        texts = filled(texts)
        for a, b in slices(texts):
            yield a, *self.encode(texts[a:b])


def tail(numbered: dict, known: int) -> list[str]:
    """The keys numbered from ``known`` on; a dict keeps the order of insertion."""
    return list(islice(numbered, known, None))


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """This worker's encoder for the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
