import hashlib
import random
import zlib

import numpy as np
import pytest

from beaconfold.llm import bpe, packing, token_bin
from beaconfold.llm.tokens import LibraryEncoder, vocabulary_path

SCHEMA = "doc_id long, text string, source string, n_tokens string, start string, ids string"
TEXTS = [
    "", None, "   ", "Hello, World's ñb", "a\x1cb \x1f c", "x<|endoftext|>y z<|startoftext|>", "Σας ΟΔΟΣ İstanbul é ́x",
    "a b c\x85d\x0be\x0cf", "word " * 5000, "z" * 3000, "don't WON'T 12³ 🙂🙂", "x", "x", "9 9 9",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns have names that the operations use themselves; the last two rows repeat an id.
    rows = [(i, t, "s", "q", "r", "u") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def expected(library, end=()):
    return {i: library.encode(t or "", add_special_tokens=False).ids + list(end) for i, t in enumerate(TEXTS)}


def test_chunks_give_the_library_ids(library):
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("aB'é́ñ 9\n\t\x1d\x85　,.-Σİ字ه<|>") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts = [t or "" for t in TEXTS] + odd
    ids, bounds = LibraryEncoder(vocabulary_path()).encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_special_tokens_in_any_case(library):
    """Marks in every case, alone, in a text, glued to letters and stops, give the library's ids."""
    rnd, specials = random.Random(8), [t.content for t in library.get_added_tokens_decoder().values()]
    cased = lambda t: "".join(rnd.choice([c.lower(), c.upper(), c]) for c in t)
    texts = [f(s) for s in specials for f in (str, str.upper, str.lower, str.title, str.swapcase)]
    for _ in range(1500):
        parts = [rnd.choice([cased(rnd.choice(specials)), rnd.choice(specials), "word", "Word.", ",", "<|", "|>", "x", "É", "9"]) for _ in range(rnd.randint(1, 6))]
        texts.append("".join(p + rnd.choice(["", " ", "\n", "."]) for p in parts))
    ids, bounds = LibraryEncoder(vocabulary_path()).encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_merge_rules_are_exact(library):
    rules, rnd = bpe.MergeRules(vocabulary_path()), random.Random(2)
    words = [t or "" for t in TEXTS] + ["".join(rnd.choice("etaoinéñ字'9!&") for _ in range(rnd.randint(1, 120))) for _ in range(500)]
    for w in words:
        assert rules.chunk_ids(w) == library.encode(w, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "walk", "é"])}
    lexicon = bpe.Lexicon.of(bpe.compile_lexicon(words))
    asked = [*words, b"wal", b"walks", b"", "è".encode(), b"x" * 100]
    numbers = lexicon.numbers(asked)
    assert (numbers[len(words) :] == -1).all()
    lengths, ids = lexicon.runs(numbers[: len(words)])
    assert lengths.tolist() == [2] * len(words) and ids.tolist() == [i for r in words.values() for i in r]
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    followed = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(lexicon.finals) == len(followed)  # a state for each set of endings, so none can be merged
    assert (bpe.Lexicon.of(bpe.compile_lexicon({})).numbers([b"a", b""]) == -1).all()


def test_codec(spark, docs, library):
    codec = bpe.BpeCodec(spark, vocabulary_path(), bpe.build_lexicon(docs, vocabulary_path(), size=5))
    rows, want = codec.encode(docs, decode=True).collect(), expected(library)
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and r.n_tokens == len(want[r.doc_id])
        assert r.decoded == library.decode(want[r.doc_id], skip_special_tokens=False)
    decoded = codec.decode(codec.encode(docs)).collect()
    assert all(r.text == library.decode(want[r.doc_id], skip_special_tokens=False) for r in decoded)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, np.uint64).astype(np.uint32)
    payload = token_bin.pack(ids, bits)
    assert len(payload) == -(-1001 * bits // 8) + 8
    assert (token_bin.unpack(payload, bits, 0, 1001) == ids).all()
    for start, n in ((0, 0), (5, 7), (1000, 1), (333, 600)):
        assert (token_bin.unpack(payload, bits, start, n) == ids[start : start + n]).all()


def test_token_files(spark, docs, library):
    files = token_bin.write_token_files(docs, vocabulary_path(), block_ids=50)
    rows = sorted(token_bin.read_token_files(files).collect(), key=lambda r: r.start)
    want, at = expected(library, [2]), 0
    assert len(rows) == len(TEXTS) + 1 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    for r in rows:
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        at += r.n_tokens


def test_packing(spark, docs, library):
    pieces = packing.cut_documents(docs, vocabulary_path()).toPandas()
    want = expected(library, [1])
    for r in pieces.itertuples():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part and r.doc_tokens == len(want[r.doc_id])
    packed = packing.pack_pieces(packing.cut_documents(docs, vocabulary_path()).drop("ids"), shard=6).toPandas()
    assert sorted(zip(packed.doc_id, packed.start, packed.length)) == sorted(zip(pieces.doc_id, pieces.start, pieces.length))
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048


def test_best_fit_takes_the_tightest_room():
    rnd = random.Random(3)
    for _ in range(50):
        lengths = sorted((rnd.randint(1, 100) for _ in range(rnd.randint(1, 80))), reverse=True)
        sequences, offsets = packing.best_fit(lengths, 100)
        rooms: list[int] = []
        for n, s, o in zip(lengths, sequences, offsets):
            fitting = [r for r in rooms if r >= n]
            if fitting:
                assert rooms[s] == min(fitting)
            else:
                assert s == len(rooms)
                rooms.append(100)
            assert o == 100 - rooms[s]
            rooms[s] -= n


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert packing.pack_pieces(packing.cut_documents(none, vocabulary_path()).drop("ids")).count() == 0
    assert token_bin.read_token_files(token_bin.write_token_files(none, vocabulary_path())).count() == 0
    assert bpe.BpeCodec(spark, vocabulary_path(), bpe.build_lexicon(none, vocabulary_path())).encode(none).count() == 0


def test_queries_on_the_table(spark, library):
    from beaconfold.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for r in queries.op2_bpe_codec(spark, sf).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(docs[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(docs[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    at = 0
    for r in sorted(queries.op10_token_files(spark, sf).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(docs[r.doc_id]) + 1, crc([*docs[r.doc_id], 2]))
        at += r.n_tokens
    pieces = queries.op8_packing(spark, sf).collect()
    assert all(r.ids_crc32 == crc([*docs[r.doc_id], 1][r.start : r.start + r.length]) for r in pieces)
    filled = sum(r.length for r in pieces) / (2048 * len({r.sequence_id for r in pieces}))
    assert filled > 0.97


def test_rows_of_one_id_spread_over_parts(spark, library):
    """Most rows have no id, half of these are equal; no part has them all, and all of them are there."""
    rows = [(None, "one two" if i % 2 else f"text {i}") for i in range(3000)] + [(i, f"w{i}") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one part
    try:
        files = token_bin.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), vocabulary_path(), block_ids=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in files.selectExpr("part", "size(doc_ids) as n").groupBy("part").sum("n").toDF("part", "n").collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * len(rows)
    got = token_bin.read_token_files(files).collect()
    sha = lambda k, ids: (str(k), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    want = sorted(sha(k, [*library.encode(t, add_special_tokens=False).ids, 2]) for k, t in rows)
    assert sorted((str(r.doc_id), hashlib.sha256(r.ids).hexdigest()) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [None] * 3000 + list(range(300))
