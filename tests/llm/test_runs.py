"""Runs against a table of all periods, on made texts and on the given documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from beaconfold.llm import queries, runs

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Every stretch with equal words p apart, for every p, less those that a smaller period explains."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            a, b = i, j + p
            if b - a >= max(least, 2 * p) and not any(all(words[x] == words[x + q] for x in range(a, b - q)) for q in range(1, p)):
                out.append((a, b - a, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_text(texts, least):
    found, starts = runs.text_runs(texts, least)
    out = [[] for _ in texts]
    for a, n, p in found.tolist():
        k = int(np.searchsorted(starts, a, "right")) - 1
        out[k].append((a - int(starts[k]), n, p))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            k, n = rnd.choice([1, 2, 2, 3, 5]), rnd.randint(0, 60)
            w = [bytes([97 + rnd.randrange(k)]) for _ in range(n)]
            if rnd.random() < 0.5 and n:
                a, p = rnd.randrange(n), rnd.randint(1, 9)
                w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
            texts.append(w)
        least = rnd.choice([2, 4, 12])
        assert by_text(texts, least) == [brute(w, least) for w in texts]


def test_words_decide_where_all_hashes_collide(monkeypatch):
    """With hashes that say nothing, extensions are what words bear out, and no false run comes about."""
    monkeypatch.setattr(runs, "_mixed", lambda codes: np.zeros(len(codes), np.uint64))
    rnd = random.Random(5)
    for _ in range(100):
        w = [bytes([97 + rnd.randrange(2)]) for _ in range(rnd.randint(0, 40))]
        got = by_text([w], 4)[0]
        assert set(got) <= set(brute(w, 4))


@pytest.mark.parametrize("words", [[b"x"] * 60_000, [b"a", b"b"] * 30_000, [b"w%d" % (i % 1000) for i in range(60_000)]])
def test_very_long_texts(words):
    period = len(set(words))
    assert by_text([words], 12) == [[(0, len(words), period)]]


def expected(doc_id, text):
    """A document's row by the contract of op12."""
    w = W.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {x for a, m, p in found for x in range(a + p, a + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        sha("".join(f"{a},{m},{p}\n" for a, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 6000]
    rnd = random.Random(2)
    junk = [(10_000 + i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 80)))) for i in range(60)]
    odd = [(-1, None), (-2, ""), (-3, " \t\n "), (None, None), (None, "x " * 20), (None, "x " * 20), (7, "é é " * 15), (7, "é é " * 15)]
    rows = docs + junk + odd
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as runs", "1 as start", "2 as w", "3 as g")
    table.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op12_periodic_runs(spark, str(tmp_path)))
    assert got == sorted((expected(k, t) for k, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_spans_and_texts_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "a " + "b c " * 8 + "d")], "doc_id long, text string")
    r = runs.periodic_runs(docs).first()
    assert [tuple(x) for x in r.runs] == [(1, 16, 2)] and r.collapsed == "a b c d" and r.n_words == 18
    assert runs.periodic_runs(docs.where("false")).count() == 0
